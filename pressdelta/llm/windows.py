"""Removal of repeated windows of words, by anchors at a difference cover.

Words have numbers in their document. Anchors are runs of ``window - period + 1`` words that
start at a number whose remainder by ``period`` is in ``COVER``. Every remainder is a
difference of two members of the cover, so two equal windows, wherever they stand, hold
equal anchors at one common offset: whatever is repeated meets at an anchor.

1. Anchors meet by hash over all documents; what occurs twice in a batch is known at once
   and sends one witness, so a common anchor has a row a batch.
2. A repeated anchor extends over all words that windows around it can reach. Equal
   extents fold to the earliest with partial aggregation: in all others every window around
   the anchor is a repeat.
3. Where one anchor has several extents, the earliest of each gives its windows, every
   window once; equal windows fold to the earliest, which lives.
4. A window goes if an anchor inside it is in an extent that is not the earliest, or in
   one of several extents and the window does not live. Documents read the lists of their
   own anchors, which are bounded by their length, and drop the words that windows cover.

Windows and extents are compared by two hashes of 64 bits with different seeds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, required
from .suffix_dedup import _bytes, _packed, _repeated

WINDOW, PERIOD = 20, 13
#: A perfect difference set of the period, whose differences are all remainders.
COVER = (0, 1, 3, 9)
#: Bytes of short texts that are handled together, and bytes from which a word is hashed on its own.
SLAB, LONG_WORD = 1 << 21, 128
#: Kinds of entries in a document's list: the only extent of an anchor, one of several, a window that lives.
ONLY, SEVERAL, LIVES = 0, 1, 2

_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other, and each text's first word."""
    out = _SPACE[data]
    begins = ~out
    begins[1:] &= out[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins[inner] = ~out[inner]
    stops = ~out
    stops[:-1] &= out[1:]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    stops[last] = ~out[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time; long words by XXH64."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    out = _mix(size.astype(np.uint64) ^ np.uint64(seed))
    active = np.flatnonzero(size < LONG_WORD)
    at = 0
    while len(active):
        left = np.minimum(size[active] - at, 8)
        piece = eight[starts[active] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        out[active] = _mix((out[active] ^ piece) + np.uint64(seed))
        active = active[size[active] > at + 8]
        at += 8
    raw = data.tobytes() if (size >= LONG_WORD).any() else b""
    for i in np.flatnonzero(size >= LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed)
    return out


def spans(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the ``width`` words from each on, from spans whose sizes are powers of two."""
    n, at, whole, block, size = max(len(words) - width + 1, 0), 0, np.full(max(len(words) - width + 1, 0), width, dtype=np.uint64), words, 1
    while True:
        if width & size:
            whole = _mix(whole * np.uint64(seed) + block[at : at + n])
            at += size
        if 2 * size > width:
            return whole
        block = _mix(block[: len(block) - size] * np.uint64(seed) + (block[size:] ^ np.uint64(size)))
        size *= 2


class _Texts:
    """Words of several texts of a batch: ``first`` has the number of each text's first word."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data = rows, data
        self.starts, self.ends, self.first = split(data, bounds)
        self.counts = np.diff(self.first)

    def place(self) -> np.ndarray:
        """The number of every word in its own text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def own(self, which: np.ndarray) -> np.ndarray:
        """The text of each of some words."""
        return np.searchsorted(self.first, which, side="right") - 1

    def hashes(self, lane: int) -> np.ndarray:
        return hashed(self.data, self.starts, self.ends, _SEEDS[lane])


def _texts(batch: pa.RecordBatch, column: int):
    data, bounds = _bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(bounds, bounds[at] + SLAB, side="right")) - 1, at + 1)
        yield _Texts(np.arange(at, to), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def _anchored(texts: _Texts, window: int, period: int) -> np.ndarray:
    """Words at which an anchor starts, in texts that have a window at all."""
    place, left = texts.place(), np.repeat(texts.counts, texts.counts)
    good = np.isin(place % period, COVER) & (left >= window) & (place + window - period + 1 <= left)
    return np.flatnonzero(good)


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """Anchors (k, doc, at, sure) of ``docs(key, text)``, those met twice in a batch spread by ``k``."""

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            for texts in _texts(batch, 1):
                at = _anchored(texts, window, period)
                h = spans(texts.hashes(0), window - period + 1, _SEEDS[0])[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[texts.rows[texts.own(at)]]), pa.array(texts.place()[at])], ["h", "doc", "at"])

    def dealt(batches):
        for batch in _packed(run, 1 << 18)(batches):
            h, doc, at = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(h)
            h, doc, at = h[order], doc[order], at[order]
            same = h[1:] == h[:-1]
            sure = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            spread = _mix((h + doc * 31 + at).view(np.uint64)).view(np.int64)
            witness = np.flatnonzero(sure & ~np.concatenate([[False], same]))
            none = np.full(len(witness), -1)
            columns = [(np.where(sure, spread, h), h[witness]), (doc, none), (at, none), (sure, np.zeros(len(witness), dtype=bool))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["k", "doc", "at", "sure"])

    return docs.mapInArrow(_packed(dealt, 1 << 16), "k long, doc long, at long, sure boolean")


def _listed(texts: _Texts, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of the lists of all texts of a slab; null is an empty list."""
    part = lists.slice(int(texts.rows[0]), len(texts.rows))
    sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
    return np.repeat(np.arange(len(texts.rows)), sizes), part.flatten().to_numpy()


def _extents(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(h, extent, doc, key, at): repeated anchors and a hash of all that windows around them reach.

    Beyond the ends of a text stand words that no text has.
    """
    before, width = period - 1, window + period - 1

    def run(batches):
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for texts in _texts(batch, 2):
                text, at = _listed(texts, batch.column(3))
                fits = at < texts.counts[text] - (window - period)  # lists of an equal key may be another text's
                text, at = text[fits], at[fits]
                if not len(at):
                    continue
                size = np.where(texts.counts > 0, texts.counts + width, 0)
                shift = np.cumsum(size) - size  # room before and after each text
                lane = np.full(size.sum() + width, 0xA5A5A5A5, dtype=np.uint64)
                own = np.repeat(shift + before - texts.first[:-1], texts.counts) + np.arange(len(texts.starts))
                lane[own] = texts.hashes(1)
                extent = spans(lane, width, _SEEDS[1])[shift[text] + at]
                h = spans(texts.hashes(0), window - period + 1, _SEEDS[0])[texts.first[:-1][text] + at]
                row = texts.rows[text]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(doc[row]), pa.array(key[row]), pa.array(at.astype(np.int32))], ["h", "extent", "doc", "key", "at"])

    return docs.mapInArrow(_packed(run), "h long, extent long, doc long, key long, at int")


def _reached(texts: _Texts, text: np.ndarray, at: np.ndarray, window: int, period: int) -> np.ndarray:
    """For every word whether one of some anchors lies in its window; windows end inside their text."""
    edge = np.zeros(len(texts.starts) + 1, dtype=np.int64)
    np.add.at(edge, texts.first[:-1][text] + np.maximum(at - period + 1, 0), 1)
    np.add.at(edge, texts.first[:-1][text] + at + 1, -1)
    whole = texts.place() + window <= np.repeat(texts.counts, texts.counts)
    return (np.cumsum(edge[:-1]) > 0) & whole


def _windows(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(a, b, doc, key, pos): windows around anchors with several extents, each once."""

    def run(batches):
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for texts in _texts(batch, 2):
                text, at = _listed(texts, batch.column(3))
                on = np.flatnonzero(_reached(texts, text, at.astype(np.int64), window, period))
                if not len(on):
                    continue
                a, b = (spans(texts.hashes(lane), window, _SEEDS[lane])[on].view(np.int64) for lane in (0, 1))
                row = texts.rows[texts.own(on)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(doc[row]), pa.array(key[row]), pa.array(texts.place()[on].astype(np.int32))], ["a", "b", "doc", "key", "pos"])

    return docs.mapInArrow(_packed(run), "a long, b long, doc long, key long, pos int")


def _finish(docs: DataFrame, window: int, period: int) -> DataFrame:
    """Counts and the digest of what is left: ``docs(doc_id, text, at, marks)``."""

    def gone(texts, anchors, marks):
        text, at = _listed(texts, anchors)
        own, code = _listed(texts, marks)
        fits = at < texts.counts[text]
        text, at = text[fits], at[fits].astype(np.int64)
        state = np.full(len(texts.starts), -1, dtype=np.int8)
        kind, place = code & 3, texts.first[:-1][own] + (code >> 2)
        for k in (ONLY, SEVERAL):
            state[place[kind == k]] = k
        lives = np.zeros(len(texts.starts), dtype=bool)
        lives[place[kind == LIVES]] = True
        found = state[texts.first[:-1][text] + at]
        out = _reached(texts, text[found < 0], at[found < 0], window, period)
        out |= _reached(texts, text[found == SEVERAL], at[found == SEVERAL], window, period) & ~lives
        total = np.concatenate([np.zeros(window, dtype=np.int64), np.cumsum(out)])
        return total[window:] > total[:-window]  # a window reaches no other text

    def run(batches):
        for batch in batches:
            for texts in _texts(batch, 1):
                raw, listed = texts.data.tobytes(), batch.column(2).slice(int(texts.rows[0]), len(texts.rows))
                removed = np.zeros(len(texts.starts), dtype=bool)
                if listed.null_count < len(listed):
                    removed = gone(texts, batch.column(2), batch.column(3))
                lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[texts.first])
                starts, ends = texts.starts[~removed].tolist(), texts.ends[~removed].tolist()
                bounds = np.concatenate([[0], np.cumsum(texts.counts - lost)]).tolist()
                digests = [hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)])).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(texts.rows[0]), len(texts.rows)), pa.array(texts.counts), pa.array(lost), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(_packed(run, 1 << 12), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words over it also starts earlier: in a smaller
    doc_id, or earlier in the same text. Null texts have no words; texts shorter than a
    window keep all. A null doc_id comes after all others. Rows that repeat a doc_id come in
    the order of a hash of their texts, and rows that repeat the text too are one document,
    so they take nothing from each other. An empty table gives an empty result; other
    columns are ignored. ``period`` must have ``COVER`` as a difference cover and be at most
    ``window``.
    """
    if {(x - y) % period for x in COVER for y in COVER} != set(range(period)) or period > window:
        raise ValueError("the cover must have every difference of the period, which is at most a window")
    base = required(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("key"), "text"
    )
    repeated = _repeated(_anchors(base.select("key", "text"), window, period))
    anchors = materialize(repeated.groupBy(F.col("doc").alias("key")).agg(F.sort_array(F.collect_set(F.col("at").cast("int"))).alias("at")), "anchors")
    extents = _extents(base.join(anchors, "key").select("doc", "key", "text", "at"), window, period)
    first = materialize(extents.groupBy("h", "extent").agg(F.min(F.struct("doc", "key", "at")).alias("e")).select("h", "extent", "e.*"), "extents")
    several = first.groupBy("h").agg(F.min("extent").alias("low"), F.max("extent").alias("high")).where("low <> high").select("h", F.lit(SEVERAL).alias("kind"))
    marks = materialize(first.join(several, "h", "left").select("doc", "key", (F.col("at").cast("long") * 4 + F.coalesce("kind", F.lit(ONLY))).alias("code")), "marks")
    discard(first)
    open_ = marks.where(F.col("code") % 4 == SEVERAL).groupBy("doc", "key").agg(F.collect_list(F.shiftright("code", 2).cast("int")).alias("at"))
    alike = _windows(base.join(open_, ["doc", "key"]).select("doc", "key", "text", "at"), window, period)
    lives = alike.groupBy("a", "b").agg(F.min(F.struct("doc", "key", "pos")).alias("e")).select("e.doc", "e.key", (F.col("e.pos").cast("long") * 4 + LIVES).alias("code"))
    lists = materialize(marks.unionByName(lives).groupBy("doc", "key").agg(F.collect_list("code").alias("marks")), "lists")
    discard(marks)
    told = base.join(anchors, "key", "left").join(lists, ["doc", "key"], "left")
    return _finish(told.select("doc_id", "text", "at", "marks"), window, period)
