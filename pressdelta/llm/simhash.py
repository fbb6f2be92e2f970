"""SimHash near-deduplication with a generalised pigeonhole search.

Two fingerprints within ``tau`` bits of each other agree to within t_i bits in some
partition i of the 64 bits whenever the thresholds t_i (-1 leaves a partition out) add
up to tau - m + 1. The search

1. counts how often each pair of bits is set together over all distinct fingerprints
   and groups correlated bits into the same partition, for m = 2, 3 and 4;
2. counts the values of every partition in slices of at most eight bits, again over
   all fingerprints, which gives the expected number of candidates at each threshold;
3. lets a dynamic programme share the thresholds out unequally, and takes the m that
   costs least, so more documents mean wider partitions with a few flipped bits;
4. probes: each fingerprint is filed under its partition values within t_i flips;
5. verifies whole fingerprints inside each bucket and emits a spanning forest of the
   links there, never all pairs.

Large buckets are cut into blocks, and units of work of bounded size compare them (see
``blocks``), so no bucket has to fit one task and no link between components is left out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_sizes, first_units, large_buckets, later_units
from .common import materialize, required
from .graph import components

SHINGLE, SEED, BITS, TAU = 3, 42, 64, 3
#: Fingerprints of one bucket compared as one block.
BLOCK = 256
#: Shingles hashed before their bits are added up, for texts of any length.
SLAB = 1 << 15
#: Weight of checking one candidate against writing one probe.
PAIR_COST = 0.02


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; a text without words has fingerprint zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
        total = 1
    else:
        total = len(words) - shingle + 1
        runs = zip(*(itertools.islice(words, i, None) for i in range(shingle)), strict=False)
        hashes = (xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, SLAB):
        slab = np.fromiter(itertools.islice(hashes, SLAB), dtype="<u8", count=min(SLAB, total - at))
        ones += np.unpackbits(slab.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return required(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(reps: DataFrame) -> np.ndarray:
    """How many fingerprints set bits i and j together: 64 x 64, summed over all rows."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for at in range(0, len(bits), SLAB):
                total += bits[at : at + SLAB].T @ bits[at : at + SLAB]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in reps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def correlated_groups(counts: np.ndarray, total: int, m: int) -> list[list[int]]:
    """Bits dealt to m partitions so that strongly correlated bits share one."""
    p = np.diag(counts) / max(total, 1)
    cov = counts / max(total, 1) - np.outer(p, p)
    scale = np.sqrt(np.clip(np.outer(p * (1 - p), p * (1 - p)), 1e-12, None))
    corr = np.abs(cov / scale)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _slices(groups: list[list[int]]) -> list[list[int]]:
    return [g[i : i + 8] for g in groups for i in range(0, len(g), 8)]


def slice_histograms(reps: DataFrame, slices: list[list[int]]) -> list[np.ndarray]:
    """Counts of each value of each bit slice over all fingerprints."""

    def run(batches):
        totals = [np.zeros(1 << len(s), dtype=np.int64) for s in slices]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, s in zip(totals, slices, strict=True):
                value = np.zeros(len(fps), dtype=np.int64)
                for k, b in enumerate(s):
                    value |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
                t += np.bincount(value, minlength=len(t))
        rows = [(i, int(v), int(t[v])) for i, t in enumerate(totals) for v in np.nonzero(t)[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["i", "v", "n"])

    out = [np.zeros(1 << len(s)) for s in slices]
    for r in reps.select("fp").mapInArrow(run, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).collect():
        out[r.i][r.v] = r.n
    return out


def distance_distribution(histograms: list[np.ndarray]) -> np.ndarray:
    """P(a random pair differs in d bits), slices taken as independent."""
    out = np.ones(1)
    for h in histograms:
        p = h / max(h.sum(), 1)
        width = int(math.log2(len(p)))
        values = np.arange(len(p))
        apart = np.array([bin(x).count("1") for x in range(len(p))])[values[:, None] ^ values[None, :]]
        out = np.convolve(out, np.bincount(apart.ravel(), weights=np.outer(p, p).ravel(), minlength=width + 1))
    return out


def _ball(width: int, t: int) -> int:
    return sum(math.comb(width, d) for d in range(t + 1))


def _shared_probes(width: int, t: int, d: int) -> int:
    """Values within t flips of both of two values that lie d apart."""
    return sum(math.comb(d, x) * math.comb(width - d, y) for x in range(d + 1) for y in range(width - d + 1) if x + y <= t and d - x + y <= t)


def allocate(widths: list[int], distances: list[np.ndarray], total: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum tau - m + 1 of least expected cost, by dynamic programming."""
    goal = tau - len(widths) + 1
    best = {0: (0.0, [])}
    for width, dist in zip(widths, distances, strict=True):
        costs = {-1: 0.0}
        for t in range(min(tau, width, 2) + 1):
            shared = sum(p * _shared_probes(width, t, d) for d, p in enumerate(dist[: 2 * t + 1]))
            costs[t] = _ball(width, t) + PAIR_COST * total * shared
        step = {}
        for done, (cost, chosen) in best.items():
            for t, c in costs.items():
                if (s := done + t) not in step or cost + c < step[s][0]:
                    step[s] = (cost + c, [*chosen, t])
        best = step
    return best.get(goal, (math.inf, []))


def plan_partitions(reps: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold) that the search probes."""
    counts = bit_counts(reps)
    total = reps.count()
    choices = [correlated_groups(counts, total, m) for m in (2, 3, 4)]
    histograms = iter(slice_histograms(reps, [s for groups in choices for s in _slices(groups)]))
    plans = []
    for groups in choices:
        own = [[next(histograms) for _ in range(0, len(g), 8)] for g in groups]
        cost, thresholds = allocate([len(g) for g in groups], [distance_distribution(h) for h in own], total, tau)
        plans.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=False) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(i: int, bits: list[int], t: int):
    """Array of (partition, value): the fingerprint's own bits there, within t flips."""
    mask = _signed(sum(1 << b for b in bits))
    flips = [_signed(sum(1 << b for b in c)) for d in range(t + 1) for c in itertools.combinations(bits, d)]
    own = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda flip: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(flip).alias("value")))


def _probes(partitions: list[tuple[list[int], int]]):
    return F.explode(F.flatten(F.array(*[_filed(i, bits, t) for i, (bits, t) in enumerate(partitions)])))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the edges: each node with the root of its tree."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _close(fps: np.ndarray, group: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``, folded to a forest as they are found."""
    found_a, found_b, held = [], [], 0
    at = np.arange(len(fps))
    shift = 1
    while len(at := at[at + shift < len(fps)]) and len(at := at[group[at] == group[at + shift]]):
        a, b = fps[at], fps[at + shift]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= tau) & (a != b)  # of signed numbers it counts the absolute value
        if near.any():
            found_a.append(a[near])
            found_b.append(b[near])
            held += int(near.sum())
            if held > 4 * len(fps) + 100_000:
                folded = forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [folded[0]], [folded[1]], len(folded[0])
        shift += 1
    if not found_a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(reps: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``tau`` bits."""
    partitions = plan_partitions(reps, tau)
    filed = reps.select(F.col("fp").alias("id"), _probes(partitions).alias("p")).select("id", "p.part", "p.value")
    sizes = materialize(bucket_sizes(filed), "buckets")
    key = ["part", "value", "i", "j"]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            cols = [table.column(k).to_numpy() for k in key]
            starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            last = int(starts[-1]) if len(starts) else 0
            rest = table.slice(last)  # the last unit may go on in the next batch
            if last:
                yield from emit(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    def emit(table):
        cols = [table.column(k).to_numpy() for k in key]
        group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))])
        a, b = _close(table.column("id").to_numpy().astype(np.int64), group, tau)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def search(units):
        return units.select("id", *key).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")

    first = materialize(search(first_units(filed, sizes, block)), "links")
    if not large_buckets(sizes, block)[1]:
        return first
    roots = components(first)
    later = search(later_units(filed, sizes, roots, block))
    return later.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Fingerprints are 16 lowercase hex digits; component_id is the smallest doc_id that
    links of ``tau`` or fewer differing bits reach. Null and empty texts, and texts
    without words, have fingerprint zero and link like any other. Null doc_ids take
    part but never name a component unless it has no doc_id, then component_id is null.
    Rows that repeat share their fingerprint's component. An empty table gives an empty
    result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    if reps.isEmpty():
        return fps.select("doc_id", F.hex("fp").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    roots = components(links(reps, tau)).select(F.col("node").alias("fp"), "root")
    rooted = reps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(heads, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
