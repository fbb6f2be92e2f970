"""Best-fit packing into bins of several permitted sequence lengths.

Documents become byte-level token sequences (one token a UTF-8 byte and one end
token); a sequence longer than the largest length is cut into pieces, so every token
is packed. Pieces are dealt by hash to shards of bounded size and each shard is packed
on its own, longest piece first:

* a piece goes to the open bin that it fills best, whatever that bin's length;
* if none has room, every permitted length is filled on trial with the pieces that are
  left, largest first, and the bin is opened at the length that costs least for each
  token of its trial, downsized: lengths compete by what the shard can put into them;
* in the end every bin shrinks to the least permitted length that holds its contents.

The cost of a length c is ``c + c * c / QUADRATIC + OVERHEAD``: linear layers, attention
and a fixed charge for each sequence.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import required

LENGTHS = (2048, 8192, 32768)
QUADRATIC, OVERHEAD = 131072, 64
#: Pieces that a shard holds on average.
SHARD = 4096

SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, bin_id string, slot int, bin_tokens long, bin_length long"


def cost(length: int) -> float:
    return length + length * length / QUADRATIC + OVERHEAD


def _trial(sizes: list[int], i: int, length: int) -> int:
    """Tokens in a bin of ``length`` that begins with piece i of descending ``sizes`` and takes what fits of the rest."""
    used, k = sizes[i], i + 1
    while used < length:
        k = max(k, bisect_left(sizes, used - length, key=lambda n: -n))
        if k >= len(sizes):
            break
        used += sizes[k]
        k += 1
    return used


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """Bin of each size, and the final length of each bin. No size may exceed max(lengths)."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    used: list[int] = []
    where = [0] * len(sizes)

    def price(k: int, length: int) -> tuple[float, int]:
        held = _trial(falling, k, length)
        return cost(next(c for c in lengths if c >= held)) / held, length

    for k, i in enumerate(order):
        n = sizes[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((price(k, c) for c in lengths if c >= n))[1]
            b = len(used)
            used.append(0)
        where[i] = b
        used[b] += n
        if free - n:
            insort(room, (free - n, b))
    return where, [next(c for c in lengths if c >= u) for u in used]


def best_fit_packing(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD, content: bool = False) -> DataFrame:
    """One row a piece: which tokens of which document, and its bin, slot and bin length.

    With ``content`` a last column ``tokens`` holds the piece's bytes, the end token as 0xFF,
    which no UTF-8 text holds.

    ``docs(doc_id, text)``. Null and empty texts are one end token. Repeated rows are
    packed as often as they occur; null ids are packed and stay null. An empty table
    gives an empty result; other columns are ignored. ``first_token`` and ``n_tokens``
    count byte-level tokens, the end token included.
    """
    most = max(lengths)
    text = F.coalesce("text", F.lit(""))
    rows = required(docs, "doc_id", "text").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("total"), F.xxhash64("doc_id", "text").alias("deal"), *([F.concat(F.encode(text, "UTF-8"), F.lit(b"\xff")).alias("bytes")] if content else []))
    pieces = F.ceil(F.col("total") / most)
    count = rows.agg(F.sum(pieces)).first()[0] or 0
    shards = max(1, math.ceil(count / shard))
    cut = rows.select(*rows.columns, F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece"))
    first = F.col("piece").cast("long") * most
    dealt = cut.select(
        "doc_id", "piece", first.alias("first_token"), F.least(F.col("total") - first, F.lit(most)).alias("n_tokens"),
        F.pmod(F.xxhash64("deal", "piece"), F.lit(shards)).alias("shard"),
        *([F.expr(f"substring(bytes, piece * {most} + 1, {most})").alias("tokens")] if content else []),
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "n_tokens"], kind="stable", ignore_index=True)
        where, final = pack(rows["n_tokens"].tolist(), lengths)
        where = np.array(where, dtype=np.int64)
        rows["bin_id"] = [f"{s}-{b}" for s, b in zip(rows["shard"], where, strict=True)]
        rows["slot"] = rows.groupby(where).cumcount().astype("int32")
        rows["bin_tokens"] = rows["n_tokens"].groupby(where).transform("sum")
        rows["bin_length"] = np.array(final, dtype=np.int64)[where]
        return rows[names]

    schema = SCHEMA + (", tokens binary" if content else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.groupBy("shard").applyInPandas(run, schema)


def packed_sequences(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """One row a bin: bin_id, bin_length, its segments in order and their tokens as bytes.

    A bin holds at most the largest length, so what is gathered for it is bounded.
    """
    pieces = best_fit_packing(docs, lengths, shard, content=True)
    parts = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "first_token", "n_tokens", "tokens")))
    bins = pieces.groupBy("bin_id", "bin_length").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["tokens"]))
    return bins.select("bin_id", "bin_length", F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["first_token"].alias("first_token"), p["n_tokens"].alias("n_tokens"))).alias("segments"), joined.alias("tokens"))
