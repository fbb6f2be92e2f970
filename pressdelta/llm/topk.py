"""Exact top-k inner products with a KD-tree for each shard of vectors.

The vectors are split at the medians of their widest dimensions, taken from a bounded
sample, until the parts have the size of a shard, so a shard's vectors lie together. Every
shard goes on as a tree: the widest dimension is split at its median until a leaf holds few
vectors, and each node keeps the tight bounding box of its vectors. The inner product of a
query with any vector of a box is at most the sum over dimensions of the larger of q * low
and q * high.

Each query first visits the shard on the side of its signs, and takes its k-th score along.
Queries that lie together travel in blocks; a block and a shard meet only if the bound of
their two boxes reaches the least k-th score of the block. What meets is visited shard by
shard, largest bound first, nodes in the order of their bounds, and a visit ends when the
bound falls below the k-th best score so far.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, required

K, SCALE, EVERY = 5, 256, 50
#: Vectors in a shard and a leaf, queries in a block, shards that a block visits in a row.
SHARD, LEAF, QUERIES, ROW = 4096, 48, 512, 4
#: Vectors of each dimension that the splits between shards are taken from, and as many a part as these at least.
SAMPLE, PART = 65_536, 16


class Tree:
    """Nodes in one array each: bounding boxes, children or the slice of a leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None):
        order = np.arange(len(ids))
        self.low, self.high, self.child, self.span = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = x[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append([-1, -1])
            if parent >= 0:
                self.child[parent][side] = node
            if b - a > leaf:
                d = int((high - low).argmax())
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], half)]
                stack += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.x = ids[order], x[order]
        self.rows = (ids if rows is None else rows)[order]

    def dump(self) -> bytes:
        return pickle.dumps(vars(self), 5)

    @classmethod
    def load(cls, data: bytes) -> Tree:
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(data))
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[list[tuple[int, int]]], k: int, floor: np.ndarray | None = None) -> None:
        """Improve ``best``, for each query a list of (score, -vec_id), largest first.

        ``own`` are the rows that queries themselves are; ``floor`` are scores that candidates
        must reach.
        """
        exact = np.float64 if float(max(np.abs(self.x).max(), 1)) * float(max(np.abs(queries).max(), 1)) * self.x.shape[1] < 2**53 else np.int64
        x, low, high = self.x.astype(exact), self.low.astype(exact), self.high.astype(exact)
        every = queries.astype(exact)
        least = [max([t[0] for t in top[k - 1 : k]] + ([] if floor is None else [floor[i]]), default=None) for i, top in enumerate(best)]
        root = np.maximum(every, 0) @ high[0] + np.minimum(every, 0) @ low[0]
        alive = [i for i in range(len(every)) if least[i] is None or root[i] >= least[i]]
        if not alive:
            return
        q = every[alive]
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        for at, i in enumerate(alive):
            top, bar = best[i], least[i]
            heap = [(-bounds[at, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if bar is not None and -bound < bar:
                    break
                left, right = self.child[node]
                if left >= 0:
                    heapq.heappush(heap, (-bounds[at, left], left))
                    heapq.heappush(heap, (-bounds[at, right], right))
                    continue
                a, b = self.span[node]
                scores = x[a:b] @ q[at]
                good = self.rows[a:b] != own[i]
                if bar is not None:
                    good &= scores >= bar
                if good.any():
                    top += [(int(s), -int(v)) for s, v in zip(scores[good], self.ids[a:b][good], strict=True)]
                    top.sort(reverse=True)
                    del top[k:]
                    if len(top) >= k:
                        bar = top[-1][0] if bar is None else max(bar, top[-1][0])


class Splits:
    """Median splits of a sample: which part a vector, or the best side of a query, falls into."""

    def __init__(self, x: np.ndarray, parts: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, threshold, left, right; a part below zero
        self.parts = 0
        # Parts are halved largest first, so there are as many as asked for.
        heap, open_ = [(-len(x), 0)], {0: (np.arange(len(x)), None)}
        count = 1
        while heap and count < parts and -heap[0][0] >= 2 * PART:
            _, k = heapq.heappop(heap)
            rows, place = open_.pop(k)
            part = x[rows]
            d = int((part.max(axis=0) - part.min(axis=0)).argmax())
            cut = int(np.median(part[:, d]))
            below = part[:, d] <= cut
            if below.all():
                open_[-k - 1] = (rows, place)  # it has one value in every dimension
                continue
            node = len(self.nodes)
            self.nodes.append((d, cut, 0, 0))
            self._set(place, node)
            for side, own in ((2, rows[below]), (3, rows[~below])):
                name = 2 * node + side
                open_[name] = (own, (node, side))
                heapq.heappush(heap, (-len(own), name))
            count += 1
        # Parts are numbered from left to right, so those with near numbers lie near each other.
        leaves = {place for _, place in open_.values()}
        self.parts = len(leaves)
        stack, number = [(0, 3), (0, 2)] if self.nodes else [], 0
        while stack:
            place = stack.pop()
            if place in leaves:
                self._set(place, -1 - number)
                number += 1
            else:
                child = self.nodes[place[0]][place[1]]
                stack += [(child, 3), (child, 2)]

    def _set(self, place: tuple[int, int] | None, value: int) -> None:
        if place:
            node = list(self.nodes[place[0]])
            node[place[1]] = value
            self.nodes[place[0]] = tuple(node)

    def of(self, x: np.ndarray, signs: bool = False) -> np.ndarray:
        """Part of every row, by its values or by the signs of its values."""
        at = np.zeros(len(x), dtype=np.int64) if self.nodes else np.full(len(x), -1)
        table = np.array(self.nodes, dtype=np.int64).reshape(-1, 4)
        while (open_ := np.flatnonzero(at >= 0)).size:
            d, cut, left, right = table[at[open_]].T
            value = x[open_, d]
            at[open_] = np.where(value <= (0 if signs else cut), left, right)
        return -1 - at


#: Parts that blocks of queries are dealt over where they meet hulls of shards.
DEALS = 16


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.int64)


def _corners(low, high, qlow, qhigh):
    """The largest inner product of a vector of one box with a vector of another."""
    ends = F.arrays_zip(low.alias("a"), high.alias("b"), qlow.alias("c"), qhigh.alias("d"))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda s, e: s + F.greatest(e["a"] * e["c"], e["a"] * e["d"], e["b"] * e["c"], e["b"] * e["d"]))


def exact_top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, block: int = QUERIES, row: int = ROW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    ``embeddings(vec_id, embedding)``; components become floor(scale * x). Queries are
    rows whose vec_id is divisible by ``every``, candidates all rows but the query's own
    of the same dimension. Rows take no part if vec_id or the vector is null, empty or
    holds a null or non-finite component. Rows that repeat a vec_id are rows of their own:
    each is a candidate, also of the others, and each that is a query has its own ranks.
    Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    # (x + 0) == x is false for null and NaN; infinities have no finite bound.
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    usable = required(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)).where(finite)
    vectors = materialize(
        usable.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
            F.size("embedding").alias("dim"),
        ),
        "vectors",
    )
    is_query = F.col("vec_id") % every == 0
    sizes = {r.dim: (r.n, r.q) for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()}
    sizes = {d: s for d, s in sizes.items() if s[1]}
    if not sizes:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    asked = vectors.where(F.col("dim").isin(list(sizes)))

    splits = {}
    for d, (n, _) in sizes.items():
        wanted = math.ceil(n / shard)
        own = asked.where(F.col("dim") == d).select("v")
        some = own if n <= SAMPLE else own.sample(min(1.0, 0.9 * SAMPLE / n), 42)
        splits[d] = Splits(_matrix(some.limit(SAMPLE).toPandas()["v"]), wanted) if wanted > 1 else Splits(np.zeros((0, d), dtype=np.int64), 1)

    def place(batches):
        for batch in batches:
            out = np.zeros((2, len(batch)), dtype=np.int64)
            for d, at in batch.groupby("dim").indices.items():
                x = _matrix(batch["v"].iloc[at])
                out[0, at], out[1, at] = splits[d].of(x), splits[d].of(x, signs=True)
            yield batch.assign(part=out[0], turn=out[1])

    parted = materialize(asked.mapInPandas(place, "row long, vec_id long, v array<long>, dim int, part long, turn long"), "parted")
    # A part that is larger than a shard, as of many equal vectors, is dealt over several.
    deals = materialize(parted.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / shard).alias("deal")), "deals")
    dealt = lambda part, deal: F.col(part) * (1 << 24) + F.pmod(F.xxhash64("row"), F.col(deal))
    turns = deals.select("dim", F.col("part").alias("turn"), F.col("deal").alias("turns"))
    numbered = parted.join(deals, ["dim", "part"]).join(turns, ["dim", "turn"], "left")
    placed = materialize(numbered.select("row", "vec_id", "v", "dim", dealt("part", "deal").alias("shard"), F.coalesce(dealt("turn", "turns"), dealt("part", "deal")).alias("first")), "placed")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        tree = Tree(rows["vec_id"].to_numpy(), _matrix(rows["v"]), rows=rows["row"].to_numpy())
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "low": [tree.low[0]], "high": [tree.high[0]], "tree": [tree.dump()]})

    trees = materialize(placed.groupBy("dim", "shard").applyInPandas(grow, "dim int, shard long, low array<long>, high array<long>, tree binary"), "trees")
    queries = placed.where(is_query)
    shape = "query long, query_id long, vec_id long, score long"

    def visit(asking: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(asking) and len(shards):
            asking, shards = asking.sort_values("row"), shards.sort_values(["bound", "shard"], ascending=[False, True])
            q, own = _matrix(asking["v"]), asking["row"].to_numpy()
            floor = asking["floor"].to_numpy()
            best: list[list[tuple[int, int]]] = [[] for _ in own]
            for number, tree in zip(shards["shard"], shards["tree"], strict=True):
                there = np.flatnonzero(asking["seen"].to_numpy() != number)
                if not there.size:
                    continue
                Tree.load(tree).search(q[there], own[there], held := [best[i] for i in there], k, floor[there])
                for i, top in zip(there, held, strict=True):
                    best[i] = top
            for query, ident, top in zip(own, asking["vec_id"], best, strict=True):
                out["query"] += [query] * len(top)
                out["query_id"] += [ident] * len(top)
                out["vec_id"] += [-v for _, v in top]
                out["score"] += [s for s, _ in top]
        return pd.DataFrame(out, dtype="int64")

    def met(asking: DataFrame, shards: DataFrame, keys: list[str]) -> DataFrame:
        # Renamed to themselves, columns of one origin are told apart on the two sides.
        shards = shards.select(*[F.col(c).alias(c) for c in shards.columns])
        return asking.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(visit, shape)

    # Each query at the shard of its signs; many queries of one shard are dealt over blocks.
    lowest = F.lit(-(2**63)).cast("long")
    turn = queries.groupBy("dim", "first").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    first = queries.join(turn, ["dim", "first"]).select("dim", "row", "vec_id", "v", F.col("first").alias("at"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), lowest.alias("floor"), F.lit(-1).cast("long").alias("seen"))
    hosts = turn.join(trees.withColumnRenamed("shard", "first"), ["dim", "first"]).select("dim", F.col("first").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("first").alias("shard"), F.lit(0).cast("long").alias("bound"), "tree")
    start = materialize(met(first, hosts, ["dim", "at", "block"]), "start")
    kth = start.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).otherwise(lowest).alias("floor"))

    # Then every block of queries at the shards whose boxes can reach its least k-th score.
    spread = queries.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    name = F.concat_ws("-", "shard", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("string"))
    left = queries.join(spread, ["dim", "shard"]).join(kth, "row", "left")
    left = materialize(left.select("dim", "row", "vec_id", "v", name.alias("block"), F.coalesce("floor", lowest).alias("floor"), F.col("first").alias("seen")), "asking")
    sides = left.select("dim", "block", "floor", F.posexplode("v").alias("at", "x")).groupBy("dim", "block", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.min("floor").alias("floor"))
    boxes = sides.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box"), F.min("floor").alias("floor"))
    boxes = boxes.select("dim", "block", F.col("box.low").alias("qlow"), F.col("box.high").alias("qhigh"), "floor")
    bound = _corners(F.col("low"), F.col("high"), F.col("qlow"), F.col("qhigh"))
    shards_of = {r.dim: r.n for r in trees.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Blocks meet hulls of neighbouring shards first, and only the shards of hulls in reach.
    wide = F.create_map(*[F.lit(x) for d, n in shards_of.items() for x in (d, math.ceil(math.sqrt(n)))])[F.col("dim")]
    ranged = trees.select("dim", "shard", "low", "high", F.floor(F.floor(F.col("shard") / (1 << 24)) / wide).alias("hull"))
    ends = ranged.select("dim", "hull", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "hull", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    hulls = ends.groupBy("dim", "hull").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box")).select("dim", "hull", F.col("box.low").alias("hlow"), F.col("box.high").alias("hhigh"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))
    dealt_ = boxes.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(DEALS)).cast("int")).join(hulls.withColumn("deal", copies), ["dim", "deal"])
    near = dealt_.where(_corners(F.col("hlow"), F.col("hhigh"), F.col("qlow"), F.col("qhigh")) >= F.col("floor")).select("dim", "hull", "block", "qlow", "qhigh", "floor")
    reach = near.join(ranged, ["dim", "hull"]).withColumn("bound", bound).where("bound >= floor").select("dim", "block", "shard", "bound")
    groups = F.create_map(*[F.lit(x) for d, n in shards_of.items() for x in (d, math.ceil(n / row))])[F.col("dim")]
    reach = materialize(reach.withColumn("grp", F.pmod(F.xxhash64("shard"), groups).cast("int")), "reach")
    asking = left.join(reach.select("dim", "block", "grp").distinct(), ["dim", "block"])
    shards = reach.join(trees.select("dim", "shard", "tree"), ["dim", "shard"])
    found = start.unionByName(met(asking, shards, ["dim", "block", "grp"]))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
