"""Removal of repeated byte strings by a distributed, sparse suffix array.

A string of ``length`` bytes that starts at p is a suffix prefix of that length; it is
repeated if an equal one starts earlier. Comparing every suffix with every other needs
their bytes to meet, so suffixes are grouped first by an anchor that depends on their
content alone: the smallest hash among the ``gram``-byte tokens that lie inside the
string, the leftmost of equals. Equal strings have equal anchors at equal offsets, and
consecutive suffixes of a document share one, so a run of some 35 suffixes is one row.

1. Anchors meet by hash, over all documents. A suffix whose anchor occurs once is unique.
   What occurs twice in one batch is known at once and sends one witness, so a common
   anchor has a row a batch there and no more.
2. Runs with a repeated anchor carry their bytes. Runs of equal bytes are folded to the
   earliest one with partial aggregation; all others are removed as a whole.
3. What is left of an anchor, runs that differ somewhere, is range-partitioned by the
   leading token between sampled splitters. Each bucket sorts its suffixes by multikey
   quicksort, a word of eight bytes at a time and only inside groups still equal, and
   keeps the earliest suffix of every group. Equal tokens never straddle a splitter.
4. An anchor with more than ``hot`` different runs would overload a bucket: its suffixes
   are written out, sorted and folded batch by batch, and range-partitioned by their whole
   bytes, so the anchor spreads over many buckets. The result does not depend on ``hot``.
5. Each document reads its removed suffixes and drops the bytes that they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, required

LENGTH, GRAM, HOT = 100, 32, 1024
#: Suffix positions handled at once, so texts may have any length; short texts are handled together.
STRETCH, SLAB = 1 << 22, 1 << 18

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_POSITION = np.uint64((1 << 23) - 1)


def _words(data: np.ndarray) -> np.ndarray:
    """At every byte but the last seven, the eight bytes from there as a big-endian number."""
    n = len(data) - 7
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= data[k : k + n]
    return out


def _tokens(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every position; gram is at least 8."""
    words = _words(data)
    n = len(data) - gram + 1
    out = np.zeros(n, dtype=np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        out ^= words[at : at + n]
        out *= _MIX[k % 4]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _cut(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of texts that lie one after the other in ``data`` and end at ``ends``."""
    if len(data) < length:
        return (np.zeros(0, dtype=np.int64),) * 5
    hashes = _tokens(data, gram)
    ranked = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_min(ranked, length - gram + 1) & _POSITION).astype(np.int64)
    over = np.zeros(len(data) + 1, dtype=np.int32)  # strings that reach over an end
    np.add.at(over, np.maximum(ends - length + 1, 0), 1)
    np.add.at(over, ends, -1)
    inside = np.cumsum(over[: len(anchor)]) == 0
    joined = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(inside & ~np.concatenate([joined, [False]]))
    mark = np.zeros(len(first), dtype=np.uint64)
    for k in range(0, 2 * length - gram, gram):  # tokens that cover the whole run
        mark = (mark ^ hashes[np.minimum(first + k, last + length - gram)]) * _MIX[0]
        mark ^= mark >> np.uint64(31)
    return hashes[anchor[first]].view(np.int64), anchor[first], first, last, mark.view(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor, first suffix, last suffix, mark) of every run, in order.

    The mark is a hash of the run's bytes: it tells rows apart that repeat a doc_id.
    """
    if len(data) <= STRETCH:
        return _cut(data, ends, length, gram)
    parts = []
    for at in range(0, len(data) - length + 1, STRETCH):  # one long text
        to = min(at + STRETCH + length - 1, len(data))
        h, anchor, first, last, mark = _cut(data[at:to], np.array([to - at]), length, gram)
        parts.append((h, anchor + at, first + at, last + at, mark))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and their bounds; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _slabs(batch: pa.RecordBatch, text: int):
    """(rows from, rows to, bytes, starts, ends): texts of about ``SLAB`` bytes, or one longer text."""
    data, bounds = _bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(bounds, bounds[at] + SLAB, side="right")) - 1, at + 1)
        own = bounds[at : to + 1] - bounds[at]
        yield at, to, data[bounds[at] : bounds[to]], own[:-1], own[1:]
        at = to


def _flags(lists: pa.ListArray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions that the lists of all texts name, as one array of booleans.

    Rows that repeat a doc_id share a list, so a position may lie beyond the own text.
    """
    out = np.zeros(ends[-1], dtype=bool)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    at = np.repeat(starts, counts) + lists.flatten().to_numpy()
    out[at[at < np.repeat(ends, counts)]] = True
    return out


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors (h, doc, at), of which those met twice in a batch are sure to be repeated.

    They are spread by ``k``; one row without a position stands for them at their hash,
    so a hash has at most one row a batch there, however common it is.
    """

    def run(batches):
        for batch in batches:
            docs_ = batch.column(0).to_numpy()
            for a, b, data, starts, ends in _slabs(batch, 1):
                h, anchor, first, _, _ = runs(data, ends, length, gram)
                own = np.searchsorted(ends, first, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs_[a:b][own]), pa.array(anchor - starts[own])], ["h", "doc", "at"])

    def dealt(batches):
        for batch in _packed(run, 1 << 18)(batches):
            h, doc, at = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(h)
            h, doc, at = h[order], doc[order], at[order]
            same = h[1:] == h[:-1]
            sure = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            k = np.where(sure, ((h + doc * 31 + at).view(np.uint64) * _MIX[2]).view(np.int64), h)
            witness = np.flatnonzero(sure & ~np.concatenate([[False], same]))
            none = np.full(len(witness), -1)
            cols = [np.concatenate(c) for c in ((k, h[witness]), (doc, none), (at, none), (sure, np.zeros(len(witness), dtype=bool)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "doc", "at", "sure"])

    return docs.mapInArrow(dealt, "k long, doc long, at long, sure boolean")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(doc, at) of anchors that are not alone with their hash; rows are met in order of it."""

    def run(batches):
        before, waits = None, None  # hash of the last row, and the row itself while it seems alone
        for batch in batches:
            k, doc, at = (batch.column(i).to_numpy() for i in range(3))
            sure = batch.column(3).to_numpy(zero_copy_only=False)
            out = [(doc[sure], at[sure])]
            k, doc, at = k[~sure], doc[~sure], at[~sure]
            if len(k):
                same = k[1:] == k[:-1]
                again = np.concatenate([[k[0] == before], same]) | np.concatenate([same, [False]])
                if waits is not None and k[0] == before:
                    out.append(waits)
                before, waits = k[-1], None if again[-1] else (doc[-1:].copy(), at[-1:].copy())
                out.append((doc[again], at[again]))
            doc, at = (np.concatenate(c) for c in zip(*out, strict=True))
            real = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[real]), pa.array(at[real])], ["doc", "at"])

    return anchors.repartition("k").sortWithinPartitions("k").mapInArrow(run, "doc long, at long")


def _packed(run, rows: int = 1 << 16):
    """Few large batches instead of one for each slab."""

    def packed(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return packed


def _contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs at repeated anchors with their bytes: ``docs(doc, text, at array)``."""

    def run(batches):
        for batch in batches:
            docs_ = batch.column(0).to_numpy()
            for a, b, data, starts, ends in _slabs(batch, 1):
                h, anchor, first, last, mark = runs(data, ends, length, gram)
                on = _flags(batch.column(2).slice(a, b - a), starts, ends)[anchor]
                h, anchor, first, last, mark = h[on], anchor[on], first[on], last[on], mark[on]
                raw = data.tobytes()
                strings = [raw[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                own = np.searchsorted(ends, first, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array((anchor - first).astype(np.int32)), pa.array(mark), pa.array(strings, pa.binary()), pa.array(docs_[a:b][own]), pa.array(first - starts[own])], ["h", "off", "mark", "data", "doc", "first"])

    return docs.mapInArrow(_packed(run, 1 << 14), "h long, off int, mark long, data binary, doc long, first long")


def multikey_groups(words: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Group numbers after sorting by ``length`` bytes, equal exactly for equal bytes and ``group``.

    Eight bytes at a time; suffixes alone in their group are not looked at again.
    """
    out = np.unique(group, return_inverse=True)[1].astype(np.int64)
    active = np.arange(len(starts))
    for at in [*range(0, length - 8, 8), length - 8]:
        size = np.bincount(out)
        active = active[size[out[active]] > 1]
        if not len(active):
            break
        key, own = words[starts[active] + at], out[active]
        order = np.lexsort((key, own))
        key, own = key[order], own[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        first = np.concatenate([[True], own[1:] != own[:-1]])
        number = np.cumsum(fresh) - 1
        # The first part of a group keeps its number, the others get new ones.
        head = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        out[active[order]] = np.where(number == number[head], own, out.max() + 1 + number)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _spread(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the runs: the bytes as words, and row, offset and start of each suffix."""
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(data)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return _words(np.frombuffer(b"".join(data), dtype=np.uint8)), row, offset, np.repeat(np.cumsum(sizes) - sizes, counts) + offset


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Kept suffixes of runs that share an anchor: sorted and compared bucket by bucket."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            h = table.column("h").to_numpy()
            starts = np.flatnonzero(h[1:] != h[:-1]) + 1
            cut = int(starts[-1]) if len(starts) else 0
            for at in range(0, cut, 4096):  # whole anchors only
                a = 0 if at == 0 else int(starts[np.searchsorted(starts, at)])
                b = cut if at + 4096 >= cut else int(starts[np.searchsorted(starts, at + 4096)])
                if a < b:
                    yield kept(table.slice(a, b - a))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield kept(rest)

    def kept(table):
        h, doc, first = (table.column(c).to_numpy() for c in ("h", "doc", "first"))
        words, row, offset, start = _spread(table.column("data").to_pylist(), length)
        group = multikey_groups(words, start, h[row], length)
        good = _earliest(group, doc[row], first[row] + offset)
        counts = np.bincount(row[good], minlength=len(h))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(offset[good].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), table.column("mark").combine_chunks(), lists], ["doc", "first", "mark", "kept"])

    return rows.select("h", "doc", "first", "mark", "data").mapInArrow(run, "doc long, first long, mark long, kept array<int>")


def _earliest(group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a suffix is the earliest of its group; rows of one document at one place tie."""
    order = np.lexsort((at, doc, group))
    g, d, p = group[order], doc[order], at[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
    out = np.zeros(len(group), dtype=bool)
    out[order] = (d == d[head]) & (p == p[head])
    return out


def _compare_dealt(rows: DataFrame, length: int) -> DataFrame:
    """Kept suffixes of anchors with very many runs: their suffixes are dealt, not their runs.

    Batches are sorted and folded first, so a suffix has a row a batch. Those rows are
    range-partitioned by their bytes between sampled splitters and sorted; the comparison
    runs on over the boundaries of batches.
    """
    shape = "suffix binary, doc long, at long, first long, mark long"

    def fold(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                doc, first, mark = (part.column(i).to_numpy() for i in range(3))
                data = part.column(3).to_pylist()
                words, row, offset, start = _spread(data, length)
                at = first[row] + offset
                good = _earliest(multikey_groups(words, start, np.zeros(len(row), dtype=np.int64), length), doc[row], at)
                row, at, start = row[good], at[good], start[good]
                joined = np.frombuffer(b"".join(data), dtype=np.uint8)
                suffix = np.lib.stride_tricks.sliding_window_view(joined, length)[start]
                bounds = np.arange(len(row) + 1, dtype=np.int32) * np.int32(length)
                strings = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(suffix)])
                yield pa.RecordBatch.from_arrays([strings, pa.array(doc[row]), pa.array(at), pa.array(first[row]), pa.array(mark[row])], ["suffix", "doc", "at", "first", "mark"])

    def keep(batches):
        before, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            suffix = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, length)
            doc, at = (batch.column(i).to_numpy() for i in (1, 2))
            fresh = np.concatenate([[before is None or (suffix[0] != before).any()], (suffix[1:] != suffix[:-1]).any(axis=1)])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
            if head is None:
                head = (doc[0], at[0])
            d, p = np.where(first < 0, head[0], doc[first]), np.where(first < 0, head[1], at[first])
            before, head = suffix[-1].copy(), (d[-1], p[-1])
            good = (doc == d) & (at == p)
            off = (at - batch.column(3).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc[good]), pa.array(batch.column(3).to_numpy()[good]), pa.array(batch.column(4).to_numpy()[good]), pa.array(off[good])], ["doc", "first", "mark", "off"])

    one = rows.select("doc", "first", "mark", "data").mapInArrow(fold, shape)
    dealt = one.repartitionByRange("suffix").sortWithinPartitions("suffix", "doc", "at")
    return dealt.mapInArrow(keep, "doc long, first long, mark long, off int").groupBy("doc", "first", "mark").agg(F.collect_list("off").alias("kept"))


def _finish(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, data, starts, ends in _slabs(batch, 2):
                part = batch.slice(a, b - a)
                counts = np.zeros(len(ends), dtype=np.int64)
                spans, covered = counts, np.zeros(len(data), dtype=bool)
                if part.column(3).null_count < len(part):
                    covered = _covered(data, starts, ends, part.column(3), part.column(4), length, gram)
                    begins = covered & ~np.concatenate([[False], covered])[: len(covered)]
                    begins[starts[ends > starts]] = covered[starts[ends > starts]]
                    counts, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([starts[:1], ends])]) for x in (covered, begins))
                digests = []
                for x, y, n in zip(starts.tolist(), ends.tolist(), counts.tolist(), strict=True):
                    left = data[x:y][~covered[x:y]] if n else data[x:y]
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - starts), pa.array(counts), pa.array(spans), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(_packed(run, 1 << 12), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _covered(data, starts, ends, flagged: pa.ListArray, lives: pa.ListArray, length: int, gram: int) -> np.ndarray:
    """Bytes under a removed string: all of a flagged run go but those that live."""
    _, anchor, first, last, mark = runs(data, ends, length, gram)
    on = _flags(flagged, starts, ends)[anchor]
    first, last, mark = first[on], last[on], mark[on]
    counts = pc.fill_null(pc.list_value_length(lives), 0).to_numpy()
    rows = lives.flatten()
    whole, alive = np.ones(len(first), dtype=bool), np.zeros(0, dtype=np.int64)
    if len(rows) and len(first):
        kept = rows.field("kept")
        start = np.repeat(starts, counts) + rows.field("first").to_numpy()
        at = np.minimum(np.searchsorted(first, start), len(first) - 1)
        own = (start < np.repeat(ends, counts)) & (first[at] == start) & (mark[at] == rows.field("mark").to_numpy())
        whole[at[own & kept.is_null().to_numpy(zero_copy_only=False)]] = False
        sizes = pc.fill_null(pc.list_value_length(kept), 0).to_numpy()
        alive = (np.repeat(start, sizes) + kept.flatten().to_numpy())[np.repeat(own, sizes)]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[first[whole]] += 1
    np.add.at(edge, last[whole] + 1, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gone[alive] = False
    total = np.concatenate([np.zeros(length, dtype=np.int64), np.cumsum(gone)])
    return total[length:] > total[:-length]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier:
    in a smaller doc_id, or in the same doc_id at a smaller position. Null texts are
    empty; texts shorter than ``length`` keep everything. A null doc_id counts as larger
    than all others. Rows that repeat a doc_id count as one document, so the same string
    at the same position of both is not repeated by that. An empty table gives an empty
    result; other columns are ignored.
    """
    base = required(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), "doc_id", "text")
    repeated = _repeated(_anchors(base.select("doc", "text"), length, gram))
    flagged = materialize(repeated.groupBy("doc").agg(F.collect_list("at").alias("at")), "flagged")
    contexts = _contexts(base.select("doc", "text").join(flagged, "doc"), length, gram)
    firsts = contexts.groupBy("h", "off", "mark", "data").agg(F.min(F.struct("doc", "first")).alias("e"))
    reps = materialize(firsts.select("h", "off", "mark", "e.doc", "e.first", "data"), "runs")
    sizes = reps.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    marked = materialize(reps.join(sizes, "h").select("h", "off", "doc", "first", "size", "mark", "data"), "marked")
    discard(reps)
    alone = marked.where("size = 1").select("doc", "first", "mark", F.lit(None).cast("array<int>").alias("kept"))
    some = marked.where(f"size > 1 AND size <= {hot}").withColumn("lead", F.expr("substring(data, off + 1, 16)"))
    bucketed = some.repartitionByRange("lead", "h").sortWithinPartitions("lead", "h")
    many = marked.where(f"size > {hot}")
    kept = alone.unionByName(_compare(bucketed, length)).unionByName(_compare_dealt(many, length))
    lists = kept.groupBy("doc").agg(F.collect_list(F.struct("first", "mark", "kept")).alias("kept"))
    plan = materialize(flagged.join(lists, "doc", "left").select("doc", "at", "kept"), "plan")
    discard(flagged, marked)
    joined = base.join(plan, "doc", "left").select("doc_id", "doc", "text", "at", "kept")
    return _finish(joined, length, gram)
