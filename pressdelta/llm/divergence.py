"""How far the vocabularies of a language's sources lie apart, in exact integers.

1. A table of 256 entries says which bytes of the joined UTF-8 texts belong to terms, so
   boundaries are found at once; slices are lower-cased by another table, grouped by
   XXH3 and compared byte by byte with the first of their group. A task sends one row for
   each language, source and term of a stretch.
2. Counts are summed; one window a language and term finds documents and total, so terms
   of too few documents go.
3. With s(x) the terms that source x has, the divergence of a pair is a sum over s(a), over
   s(b), a constant for terms that neither has, and a correction for terms of both. The
   first two follow from how often each source has each count. The correction comes from
   rows of a CSR matrix, terms by sources: pairs of a row are valued at once and folded by
   ``reduceat``, so tasks send a row for each pair of sources.

Frequencies are billionths plus one, by long division in steps of 1,000: exact up to
9 * 10^15 occurrences a language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, required
from .suffix_dedup import _bytes, _packed

#: Documents that a kept term is in, and ranks of terms that are shown.
LEAST, TOP = 3, 200
#: Bytes looked at together, and pairs of a term's sources valued together.
STRETCH, PAIRS = 1 << 22, 1 << 19

_byte = np.arange(256)
_upper = (_byte >= 0x41) & (_byte <= 0x5A)
TERM = _upper | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where(_upper, _byte + 32, _byte).astype(np.uint8)


def slices(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in ``data``."""
    on = np.concatenate([[False], TERM[data], [False]])
    return np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(on[:-1] & ~on[1:])


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first slice of each group, group of each slice): groups are of equal bytes exactly.

    Slices meet by digest; one that differs from the first of its group sends the slices of
    that digest to be told apart by their bytes.
    """
    raw, n = data.tobytes(), len(starts)
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=n)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, lead = ends - starts, first[group]
    differ = size != size[lead]
    counts = np.where(differ, 0, size)
    shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    unlike = data[np.repeat(starts, counts) + shift] != data[np.repeat(starts[lead], counts) + shift]
    differ[np.repeat(np.arange(n), counts)[unlike]] = True
    if differ.any():
        names: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(group, group[differ])).tolist():
            group[i] = names.setdefault((group[i], raw[starts[i] : ends[i]]), len(first) + len(names))
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return first, group


def _pieces(batch: pa.RecordBatch):
    """(documents, lower-cased bytes, document of each byte's end): several texts, or part of one."""
    data, bounds = _bytes(batch.column(2))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(bounds, bounds[at] + STRETCH, side="right")) - 1, at + 1)
        own = LOWER[data[bounds[at] : bounds[to]]]
        yield np.arange(at, to), np.insert(own, bounds[at + 1 : to + 1] - bounds[at], 0x20), bounds[at + 1 : to + 1] - bounds[at] + np.arange(1, to - at + 1)
        at = to


def _long(data: np.ndarray) -> Counter:
    """Terms of one long text, a stretch at a time; stretches end between terms."""
    found, at = Counter(), 0
    while at < len(data):
        to = min(at + STRETCH, len(data))
        outside = np.flatnonzero(~TERM[data[at:to]])
        to = at + int(outside[-1]) + 1 if len(outside) else to
        while to < len(data) and not len(outside):  # one term, longer than a stretch
            more = np.flatnonzero(~TERM[data[to : to + STRETCH]])
            outside, to = more, to + (int(more[0]) + 1 if len(more) else min(STRETCH, len(data) - to))
        part = data[at:to]
        starts, ends = slices(part)
        first, group = grouped(part, starts, ends)
        raw = part.tobytes()
        found.update(dict(zip((raw[starts[i] : ends[i]] for i in first), np.bincount(group, minlength=len(first)).tolist(), strict=True)))
        at = to
    return found


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of ``docs(lang, source, text)``: occurrences and documents.

    Every language and source has a row of the empty term besides, so none is lost.
    """

    def run(batches):
        for batch in batches:
            names: dict[tuple[str, str], int] = {}
            of = np.array([names.setdefault(k, len(names)) for k in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)], dtype=np.int64)
            order = np.argsort(of, kind="stable")  # texts of one source together, so their terms fold
            of, batch = of[order], batch.take(pa.array(order))
            keys = list(names)
            yield rows(keys, np.arange(len(keys)), pa.array([""] * len(keys)), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
            for docs_, data, ends in _pieces(batch):
                if len(docs_) == 1 and len(data) > STRETCH:
                    found = _long(data)
                    terms = pa.array(list(found), pa.binary()).cast(pa.string())
                    yield rows(keys, np.full(len(found), of[docs_[0]]), terms, np.array(list(found.values()), dtype=np.int64), np.ones(len(found), dtype=np.int64))
                    continue
                starts, stops = slices(data)
                if not len(starts):
                    continue
                first, group = grouped(data, starts, stops)
                doc = np.searchsorted(ends, starts, side="right")
                pair, n = np.unique(group * len(docs_) + doc, return_counts=True)
                code = pair // len(docs_) * len(keys) + of[docs_[pair % len(docs_)]]
                order = np.argsort(code, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
                raw = data.tobytes()
                terms = pa.array([raw[starts[i] : stops[i]] for i in first], pa.binary()).cast(pa.string())
                code = code[order[heads]]
                yield rows(keys, code % len(keys), terms.take(pa.array(code // len(keys))), np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(order))))

    def rows(keys, which, terms, n, df):
        lang, source = (pa.array([k[i] for k in keys], pa.string()).take(pa.array(which)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

    seen = docs.mapInArrow(_packed(run), "lang string, source string, term string, n long, df long")
    return seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def frequency(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / whole) without overflow."""
    rest = n + 1
    out = _div(rest, whole)
    for _ in range(3):
        rest = (rest % whole) * 1000
        out = out * 1000 + _div(rest, whole)
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _both(entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): the correction for terms that two sources share.

    ``entries(lang, term, source, p, p0)`` sorted by language and term; whole terms of one
    language at a time become the rows of a CSR matrix.
    """

    def value(p, q):
        return (p - q) * (p - q) // q

    def folded(table):
        key = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source")]
        lang, term, source = (k.indices.to_numpy() for k in key)
        p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
        pointer = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        width = np.diff(np.append(pointer, len(term)))
        start, many = np.repeat(pointer, width), np.repeat(width, width)
        bounds = np.cumsum(many)
        at = 0
        while at < len(term):
            to = max(int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
            k = many[at:to]
            i = np.repeat(np.arange(at, to), k)
            j = np.repeat(start[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            i, j = i[i != j], j[i != j]
            at = to
            if not len(i):
                continue
            v = value(p[i], p[j]) - value(p[i], p0[j]) - value(p0[i], p[j]) + value(p0[i], p0[j])
            code = (lang[i].astype(np.int64) * len(key[2].dictionary) + source[i]) * len(key[2].dictionary) + source[j]
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            one = order[heads]
            names = [key[0].dictionary.take(pa.array(lang[i[one]])), key[2].dictionary.take(pa.array(source[i[one]])), key[2].dictionary.take(pa.array(source[j[one]]))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.add.reduceat(v[order], heads))], ["lang", "source", "item", "value"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = len(table) - 1
            lang, term = table.column("lang"), table.column("term")
            while last > 0 and term[last - 1] == term[last] and lang[last - 1] == lang[last]:
                last -= 1
            if last > 0:
                yield from folded(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield from folded(rest)

    dealt = entries.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``.

    Part ``pair``: how far each other source of the language lies from a source, over all
    kept terms. Part ``term``: the first ``top`` terms that a source has more often than
    its language. A term is kept in a language if at least ``least`` of its documents have
    it. Null text, lang and source count as empty; a source without terms has its pairs
    all the same, at 0 where the language keeps no term; a lone source has no pair. Rows
    that repeat are documents of their own. Ties go by the item's bytes. An empty table
    gives an empty result; other columns are ignored.
    """
    base = required(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    seen = materialize(counts(base), "counts")
    term = Window.partitionBy("lang", "term")
    whole = seen.where("term <> ''").withColumns({"docs": F.sum("df").over(term), "total": F.sum("n").over(term), "lead": F.row_number().over(term.orderBy("source")) == 1})
    kept = materialize(whole.where(F.col("docs") >= least).select("lang", "source", "term", "n", "total", "lead"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("has"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("own_n", "has", "lang_n", "v")}
    named = seen.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = materialize(named.withColumn("p0", F.when(F.col("v") > 0, frequency(F.lit(0).cast("long"), F.col("own_n") + F.col("v"))).otherwise(1)), "groups")
    entries = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", frequency(F.col("n"), F.col("own_n") + F.col("v")).alias("p"), "p0", frequency(F.col("total"), F.col("lang_n") + F.col("v")).alias("q"))

    high = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Each pair (a, b): the terms of a against b without them, of b against a without them, and neither's.
    often = entries.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.col("has").alias("other_has"))
    met = often.join(other, "lang").where("source <> other")
    alone = met.select("lang", "source", F.col("other").alias("item"), (F.col("times") * _f(F.col("p"), F.col("other_p0"))).alias("value"))
    lacked = met.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), (F.col("times") * _f(F.col("other_p0"), F.col("p"))).alias("value"))
    neither = groups.join(other, "lang").where("source <> other").select("lang", "source", F.col("other").alias("item"), ((F.col("v") - F.col("has") - F.col("other_has")) * _f(F.col("p0"), F.col("other_p0"))).alias("value"))
    parts = alone.unionByName(lacked).unionByName(neither).unionByName(_both(entries))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    out = materialize(pairs.unionByName(terms), "divergence")
    discard(seen, kept, groups)
    return out
