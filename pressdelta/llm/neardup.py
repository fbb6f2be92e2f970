"""The SimHash operator at a similarity of shingle sets instead of a number of bits.

Texts are near copies if the Jaccard similarity of their sets of word shingles is at
least ``SIMILARITY``. At 0.8 two SimHash fingerprints differ in about 15 % of their bits,
far too many for a pigeonhole of 64 bits, so a text gets ``WORDS`` fingerprints of 64 bits
and the search of ``simhash`` is carried over:

1. correlated bits of each fingerprint are grouped into partitions, by counts over all
   texts;
2. thresholds (-1 leaves a partition out) are unequal as well. A pair at the similarity
   meets in a partition of width w and threshold t with the probability of at most t
   differing bits; dynamic programming takes the thresholds of least expected candidates
   whose probabilities together miss at most 1 - ``RECALL`` of such pairs;
3. texts are probed under their partition values, and one more fingerprint drops the
   chance meetings;
4. whole fingerprints verify: three standard deviations inside the similarity a pair is
   linked, three outside it is not, and in between the whole shingle sets decide.

Buckets are cut into units of bounded size (see ``blocks``): texts that a few members of a
large bucket link are not compared with each other again. A unit gives a forest of its
links or the members that still wait for their sets, never its pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_sizes, first_units, later_units
from .common import discard, keep_one, materialize, required
from .graph import components
from .simhash import PAIR_COST, _ball, _shared_probes, _signed, correlated_groups, forest

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Fingerprints of 64 bits, and the share of pairs at the similarity that the probes shall meet.
WORDS, RECALL = 32, 0.98
#: Digests that different texts may share; some hundred would take 10^11 texts.
CLASHES = 10_000
#: Members of a bucket compared as one block, rows compared at once, shingles hashed at once.
BLOCK, ROWS, SLAB = 1024, 8192, 255
#: Standard deviations of the bit distance between what is sure and what the sets decide.
SURE = 3.0

KEY = ["part", "value", "i", "j"]
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    runs = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        runs = (runs ^ each[k : k + len(runs)]) * _MIX[0]
        runs ^= runs >> np.uint64(31)
    return np.unique(runs * _MIX[1])


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` SimHash fingerprints of 64 bits of a set of shingles; none: all zero."""
    ones = np.zeros((WORDS, 8, 8), dtype=np.int64)
    for at in range(0, len(hashes), SLAB):
        x = hashes[at : at + SLAB, None] * _TIMES + _PLUS
        x ^= x >> np.uint64(31)
        x *= _MIX[1]
        x ^= x >> np.uint64(29)
        for bit in range(8):  # eight counters a word, of eight bits each
            ones[:, :, bit] += ((x >> np.uint64(bit)) & _LANES).sum(axis=0).view(np.uint8).reshape(WORDS, 8)
    return np.packbits(ones.reshape(WORDS, 64) * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def apart(similarity: float) -> float:
    """Expected share of differing bits of two equally large sets of that similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limits(n: np.ndarray, m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits that sets of sizes n and m differ in at the similarity: expectation and deviation."""
    shared = similarity / (1 + similarity) * (n + m)
    cosine = np.minimum(shared / np.maximum(np.sqrt(n * m), 1e-9), 1)
    share = np.where((n == 0) & (m == 0), 0, np.arccos(cosine) / math.pi)
    bits = 64 * WORDS
    return share * bits, np.sqrt(share * (1 - share) * bits)


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, words) of every text: ``texts(id, text)``."""

    def run(batches):
        for batch in batches:
            sizes, out = [], np.zeros((batch.num_rows, WORDS), dtype=np.uint64)
            for row, t in enumerate(batch.column(1)):
                hashes = shingles(t.as_py())
                sizes.append(len(hashes))
                out[row] = fingerprint(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(out)], ["id", "n", "words"])

    return texts.mapInArrow(run, "id long, n long, words array<long>")


def _lists(words: np.ndarray) -> pa.ListArray:
    bounds = np.arange(len(words) + 1, dtype=np.int32) * np.int32(words.shape[1])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(words.view(np.int64).ravel()))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), WORDS)


def _sets(texts: DataFrame) -> DataFrame:
    """(id, hashes): the whole shingle set of every text."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    return texts.mapInArrow(run, "id long, hashes array<long>")


def bit_counts(sketches: DataFrame) -> np.ndarray:
    """How many texts set bits i and j of each fingerprint together: WORDS x 64 x 64, over all texts.

    A task sends one matrix a fingerprint; they are added up in two steps.
    """

    def run(batches):
        total = np.zeros((WORDS, 64, 64))
        for batch in batches:
            words = _matrix(batch.column(0))
            bits = np.unpackbits(words.view(np.uint8).reshape(len(words), WORDS, 8), axis=2, bitorder="little").astype(np.float32).transpose(1, 0, 2)
            total += bits.transpose(0, 2, 1) @ bits
        k = TaskContext.get().partitionId() % 16
        yield pa.RecordBatch.from_arrays([pa.array(range(WORDS)), pa.array([k] * WORDS), pa.array([t.tobytes() for t in total])], ["word", "k", "counts"])

    def add(table):
        total = sum(np.frombuffer(c.as_py()) for c in table.column("counts"))
        return pa.table({"word": table.column("word")[:1], "k": table.column("k")[:1], "counts": pa.array([total.tobytes()])})

    shape = "word long, k long, counts binary"
    parts = sketches.select("words").mapInArrow(run, shape).groupBy("word", "k").applyInArrow(add, shape)
    out = np.zeros((WORDS, 64, 64))
    for r in parts.withColumn("k", F.lit(0).cast("long")).groupBy("word", "k").applyInArrow(add, shape).collect():
        out[r.word] = np.frombuffer(r.counts).reshape(64, 64)
    return out


def allocate(widths: list[int], distances: list[np.ndarray], total: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[float, list[int]]:
    """Thresholds of least expected cost that together meet ``recall`` of pairs at the similarity.

    Dynamic programming over what the partitions take off the logarithm of the share
    missed; ``distances`` are those of random pairs in each partition.
    """
    steps = 2000
    goal = -math.log(1 - recall)
    p = apart(similarity)
    best = np.full(steps + 1, math.inf)
    best[0] = 0.0
    chosen = []
    for width, dist in zip(widths, distances, strict=True):
        step, pick = best.copy(), np.full(steps + 1, -1, dtype=np.int8)
        back = np.arange(steps + 1)
        for t in range(3):
            met = sum(math.comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(t + 1))
            gain = int(-math.log(1 - met) / goal * steps)
            if not gain:
                continue
            shared = sum(x * _shared_probes(width, t, d) for d, x in enumerate(dist[: 2 * t + 1]))
            cost = _ball(width, t) + PAIR_COST * total * shared
            to = np.minimum(np.arange(steps + 1) + gain, steps)
            for a in np.flatnonzero(np.isfinite(best)):
                if best[a] + cost < step[to[a]]:
                    step[to[a]], pick[to[a]], back[to[a]] = best[a] + cost, t, a
        chosen.append((pick, back))
        best = step
    at, out = steps, []
    for pick, back in reversed(chosen):
        out.append(int(pick[at]))
        at = back[at]
    return float(best[steps]), out[::-1]


def plan_partitions(sketches: DataFrame) -> list[tuple[int, list[int], int]]:
    """Partitions (fingerprint, bits, threshold) that are probed."""
    counts, total = bit_counts(sketches), sketches.count()
    plans = []
    for m in (2, 3, 4):
        parts = [(w, g) for w in range(WORDS) for g in correlated_groups(counts[w], total, m)]
        distances = []
        for w, g in parts:
            set_ = np.diag(counts[w])[g] / max(total, 1)
            dist = np.ones(1)
            for q in 2 * set_ * (1 - set_):
                dist = np.convolve(dist, [1 - q, q])
            distances.append(dist)
        cost, thresholds = allocate([len(g) for _, g in parts], distances, total)
        plans.append((cost, [(w, g, t) for (w, g), t in zip(parts, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _probes(partitions: list[tuple[int, list[int], int]]):
    """(part, value, check): own partition values within the threshold, and the fingerprint after."""
    word = lambda w: F.col("words")[w % WORDS]
    plain, flipped = [], []
    for k, (w, bits, t) in enumerate(partitions):
        mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
        shape = lambda value, k=k, w=w: F.struct(F.lit(k).alias("part"), value.alias("value"), word(w + 1).alias("check"))
        if t == 0:
            plain.append(shape(word(w).bitwiseAND(mask)))
        else:
            flips = [_signed(sum(1 << b for b in c)) for d in range(t + 1) for c in itertools.combinations(bits, d)]
            own = word(w).bitwiseAND(mask)
            flipped.append(F.transform(F.lit(flips).cast("array<bigint>"), lambda flip, own=own, shape=shape: shape(own.bitwiseXOR(flip))))
    every = ([F.array(*plain)] if plain else []) + flipped
    return F.explode(F.concat(*every) if len(every) > 1 else every[0])


def _by_unit(rows: DataFrame, one, schema: str) -> DataFrame:
    """``one(table, pairs)`` over whole units; pairs are index arrays of rows that meet."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cols = [table.column(k).to_numpy() for k in KEY]
            starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            at, last = 0, int(starts[-1]) if len(starts) else 0
            while at < last:
                to = int(starts[max(np.searchsorted(starts, at + ROWS, side="right") - 1, np.searchsorted(starts, at, side="right"))])
                yield from each(table.slice(at, to - at))
                at = to
            rest = table.slice(last)  # the last unit may go on in the next batch
        if rest is not None and rest.num_rows:
            yield from each(rest)

    def each(table):
        table = table.combine_chunks()
        cols = [table.column(k).to_numpy() for k in KEY]
        group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))])
        own, crossed = table.column("own").to_numpy(), cols[2] != cols[3]

        def pairs():
            at, shift = np.arange(len(group)), 1
            while len(at := at[at + shift < len(group)]) and len(at := at[group[at] == group[at + shift]]):
                meet = ~crossed[at] | (own[at] != own[at + shift])
                if meet.any():
                    yield at[meet], at[meet] + shift
                shift += 1

        out = one(table, pairs())
        if out is not None and out.num_rows:
            yield from out.to_batches()

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, schema)


def _fit(n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])


def _first_meeting(differ: np.ndarray, part: np.ndarray, partitions) -> np.ndarray:
    """Whether pairs with these differing bits meet in no partition before ``part``."""
    out = np.ones(len(part), dtype=bool)
    for k, (w, bits, t) in enumerate(partitions if len(part) else ()):
        mask = np.uint64(sum(1 << b for b in bits))
        out &= (part <= k) | (np.bitwise_count(differ[:, w] & mask) > 2 * t)
    return out


def near_components(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, clashing: list[int] | tuple = ()) -> DataFrame:
    """(id, root) of texts with near copies; ``id`` is ``text_id`` of the text, given the digests that clash."""
    texts = required(docs, "text").select(text_id(clashing).alias("id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(_sketches(texts).dropDuplicates(["id"]), "sketches")
    if sketches.isEmpty():
        return sketches.select("id", F.col("id").alias("root"))
    partitions = plan_partitions(sketches)
    key = "part int, value long, i int, j int"
    p = apart(similarity)
    loose = int(64 * p + 4 * math.sqrt(64 * p * (1 - p)))

    def suspects(table, pairs):
        n, check, roots = table.column("n").to_numpy(), table.column("check").to_numpy().view(np.uint64), table.column("root").to_numpy()
        seen = np.zeros(len(n), dtype=bool)
        for x, y in pairs:
            near = _fit(n, x, y, similarity) & (np.bitwise_count(check[x] ^ check[y]) <= loose) & (roots[x] != roots[y])
            seen[x[near]] = seen[y[near]] = True
        return table.select([*KEY, "own", "id", "root"]).filter(pa.array(seen))

    def compared(table, pairs):
        """Pairs as (x, y, differing bits, their number, expected limit, deviation)."""
        n, words = table.column("n").to_numpy(), _matrix(table.column("words"))
        for x, y in pairs:
            fit = _fit(n, x, y, similarity)
            x, y = x[fit], y[fit]
            if not len(x):
                continue
            differ = words[x] ^ words[y]
            yield x, y, differ, np.bitwise_count(differ).sum(axis=1, dtype=np.int64), *limits(n[x].astype(float), n[y].astype(float), similarity)

    def verify(table, pairs):
        known, part = table.column("root").to_numpy(), table.column("part").to_numpy()
        sure, grey, held = [], [], 0
        for x, y, differ, d, limit, deviation in compared(table, pairs):
            inside = (d <= limit - SURE * deviation) & (known[x] != known[y])
            sure.append((known[x[inside]], known[y[inside]]))
            held += int(inside.sum())
            if held > 4 * len(known) + 100_000:
                sure, held = [forest(*(np.concatenate(c) for c in zip(*sure, strict=True)))], len(known)
            between = (d > limit - SURE * deviation) & (d <= limit + SURE * deviation) & (known[x] != known[y])
            x, y, differ = x[between], y[between], differ[between]
            first = _first_meeting(differ, part[x], partitions)
            grey.append((x[first], y[first]))
        if not sure:
            return None
        a, b = forest(*(np.concatenate(c) for c in zip(*sure, strict=True)))
        x, y = (np.concatenate(c) for c in zip(*grey, strict=True))
        at = np.searchsorted(a, known) if len(a) else np.zeros(len(known), dtype=np.int64)
        root = np.where(a[np.minimum(at, len(a) - 1)] == known, b[np.minimum(at, len(a) - 1)], known) if len(a) else known
        waits = np.unique(np.concatenate([z[root[x] != root[y]] for z in (x, y)]))
        members = table.select([*KEY, "own", "id", "root"]).take(pa.array(waits))
        none = pa.nulls(len(a), pa.int32())
        links = pa.table({"part": none, "value": pa.nulls(len(a), pa.int64()), "i": none, "j": none, "own": none, "id": pa.array(a), "root": pa.array(b), "peer": pa.array(b)})
        return pa.concat_tables([members.append_column("peer", pa.nulls(len(waits), pa.int64())), links])

    def decide(table, pairs):
        ids, part, roots = (table.column(c).to_numpy() for c in ("id", "part", "root"))
        sets, found, top = table.column("hashes").combine_chunks(), [], {}

        def find(z):
            while top.setdefault(z, z) != z:
                top[z] = z = top[top[z]]
            return z

        for x, y, differ, d, limit, deviation in compared(table, pairs):
            between = (roots[x] != roots[y]) & (d > limit - SURE * deviation) & (d <= limit + SURE * deviation)
            x, y, differ = x[between], y[between], differ[between]
            first = _first_meeting(differ, part[x], partitions)
            for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
                s, t = find(roots[a].item()), find(roots[b].item())
                if s != t:
                    left, right = (sets[z].values.to_numpy() for z in (a, b))
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if both >= similarity * (len(left) + len(right) - both):
                        top[s] = t
                        found.append((ids[a].item(), ids[b].item()))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    def search(units, known):
        """Components of ``known`` and the links that the units give."""
        met = _by_unit(units, suspects, f"{key}, own int, id long, root long")
        seen = materialize(_by_unit(met.join(whole, "id"), verify, f"{key}, own int, id long, root long, peer long"), "verified")
        edges = seen.where("peer IS NOT NULL").select(F.col("id").alias("a"), F.col("peer").alias("b"))
        if known is not None:
            edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(edges)
        waits = seen.where("peer IS NULL").drop("peer", "root").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = waits.groupBy(*KEY).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*KEY)
        open_ = materialize(waits.join(mixed, KEY), "open")
        sets = _sets(texts.join(open_.select("id").distinct(), "id", "left_semi")).dropDuplicates(["id"])
        near = materialize(_by_unit(open_.join(whole, "id").join(sets, "id"), decide, "a long, b long"), "decided")
        if not near.isEmpty():
            linked = near.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots, done = components(linked), roots
            discard(done)
        discard(seen, open_, near)
        return roots

    filed = sketches.select("id", "n", _probes(partitions).alias("p")).select("id", "n", "p.part", "p.value", "p.check")
    whole = sketches.select("id", "n", "words")
    sizes = materialize(bucket_sizes(filed), "buckets")
    roots = search(first_units(filed, sizes, block), None)
    out, units = roots, later_units(filed, sizes, roots, block)
    if units is not None:
        units = materialize(units, "mixed")
        if not units.isEmpty():
            out = search(units, roots)
            discard(roots)
        discard(units)
    discard(sketches, sizes)
    return out.select(F.col("node").alias("id"), "root")


def _digest(text):
    return F.xxhash64(text)


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def clashes(docs: DataFrame) -> list[int]:
    """Digests that two different texts share, told apart by SHA-256.

    Of n texts about n * n / 2^65 pairs share one: none below some 10^9 texts, three at
    10^10, so the list is short at any size; more than ``CLASHES`` is an error.
    """
    shas = docs.select(_digest(_text()).alias("id"), F.sha2(F.encode(_text(), "UTF-8"), 256).alias("sha"))
    found = shas.groupBy("id").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).where("low <> high")
    rows = found.select("id").limit(CLASHES + 1).collect()
    if len(rows) > CLASHES:
        raise ValueError("more texts share a digest than digests of 64 bits allow for")
    return [r.id for r in rows]


def text_id(clashing: list[int] | tuple = ()):
    """The number of a text; null counts as empty. Texts of a clashing digest are numbered by their SHA-256."""
    own = _digest(_text())
    again = F.xxhash64(F.sha2(F.encode(_text(), "UTF-8"), 256), F.lit(1))
    return F.when(own.isin(list(clashing)), again).otherwise(own) if clashing else own


def drop_near_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of linked near copies, that of the smallest doc_id; all columns.

    Equal texts are linked as well, null and empty texts and texts without words with each
    other; different texts with one digest are not. A null doc_id stays only where its group
    has no other. Of rows that repeat doc_id and text the smallest stays. An empty table
    gives an empty result.
    """
    shared = clashes(docs)
    keyed = required(docs, "doc_id", "text").select("doc_id", text_id(shared).alias("id"))
    roots = near_components(docs, clashing=shared)
    rooted = keyed.join(roots, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    rows = rooted.groupBy("root", "doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.id").alias("_key"), F.col("first.n").alias("n"))
    return keep_one(docs, kept, "doc_id", text_id(shared))
