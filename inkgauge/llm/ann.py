"""Nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stopping test.

Inner products become distances: every vector gets one more component so that all have the largest norm; queries get
zero there. Both are projected to a few dimensions by a seeded Gaussian (2-stable) matrix; then the squared projected
distance of two vectors over their squared distance follows a chi-square law of as many degrees. A kd-tree, fitted on
a bounded sample of projections, cuts them into blocks, and every row is put into its block; within a block a further
kd-tree has small leaves. For a query, leaves come by projected distance, and of their rows those are verified on the
whole vectors whose own projected distance passes the stopping test: by the chi-square law, a row beyond it that is nearer
than the k-th found would have a projected distance below it with the chance `sure`. The search ends at the first leaf that
lies beyond. Thirty-two dimensions are more than such trees cut well, but on vectors without much structure fewer
can't tell near from far: there the test has to save verifications, not leaves.

The search runs twice: at the block where the query lies, which bounds the k-th distance, and then at the blocks that
this bound can't rule out. Tasks are pairs of a block and a group of its queries. Blocks that the sample made too large
are split by hash, and queries of a block are split too, so tasks keep a bounded size.

Equal vectors are searched once: of their ids the k + 1 smallest are kept (no result can hold more of them), and a
query's own row is taken out afterwards.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and rows without an id,
take no part; vectors shorter than the longest count as ending in zeros; rows alike in id and vector count once;
an empty table gives no rows; extra columns aren't kept. With `k` or fewer candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import join_small, written

SAMPLE_ROWS, BLOCK_ROWS, LEAF_ROWS, MOST_BLOCKS, QUERY_GROUP = 20_000, 4096, 64, 4096, 2048
VERIFY_AT_ONCE = 512


def chi2_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection of the regularised incomplete gamma function."""

    def cdf(x: float) -> float:
        a, z = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0

    lo, hi = 0.0, m + 20 * math.sqrt(2 * m) + 20
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


class KdTree:
    """Cuts points at the median of their widest side until parts have `leaf` points or fewer."""

    def __init__(self, points: np.ndarray, leaf: int):
        m = points.shape[1]
        self.dim: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []  # negative: leaf -1 - x
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf, np.full(m, -np.inf), np.full(m, np.inf))

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, low: np.ndarray, high: np.ndarray) -> int:
        own = points[rows]
        d = int(np.argmax(own.max(0) - own.min(0))) if len(rows) else 0
        at = float(np.median(own[:, d])) if len(rows) else 0.0
        left = own[:, d] < at if len(rows) else np.zeros(0, bool)
        if len(rows) <= leaf or not left.any() or left.all():
            self.low.append(low)
            self.high.append(high)
            self.rows.append(rows)
            return -len(self.rows)
        here = len(self.dim)
        self.dim.append(d)
        self.cut.append(at)
        self.kids.append((0, 0))
        h, lo = high.copy(), low.copy()
        h[d] = lo[d] = at
        self.kids[here] = (self._grow(points, rows[left], leaf, low, h), self._grow(points, rows[~left], leaf, lo, high))
        return here

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        dim, cut, kids = np.array(self.dim or [0]), np.array(self.cut or [0.0]), np.array(self.kids or [(0, 0)])
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            right = points[inner, dim[n]] >= cut[n]
            node[inner] = kids[n, right.astype(int)]
        return -1 - node


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes: a row for each point."""
    total = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        total += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0.0) ** 2
    return total


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Projection:
    def __init__(self, width: int, m: int, seed: int, most: float):
        self.width, self.m, self.most = width, m, most
        self.g = np.random.default_rng(seed).standard_normal((width + 1, m))

    def data(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - (x * x).sum(1), 0.0))
        return x @ self.g[:-1] + rest[:, None] * self.g[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        return q @ self.g[:-1]


def search(
    q: np.ndarray, bound: np.ndarray, x: np.ndarray, weight: np.ndarray, proj: Projection, k: int, limit: float
) -> list[tuple[np.ndarray, int]]:
    """For each query the rows of x that may be among its k best, and how many rows were verified for it.

    bound: squared distances that the k-th best is known not to exceed; weight: how many ids a row stands for.
    Distances are |q|^2 + most - 2 <q, x>.
    """
    px, pq = proj.data(x), proj.query(q)
    tree = KdTree(px, LEAF_ROWS)
    low = np.array([px[r].min(0) for r in tree.rows])
    high = np.array([px[r].max(0) for r in tree.rows])
    inside = np.concatenate(tree.rows)  # rows leaf by leaf
    ends = np.cumsum([len(r) for r in tree.rows])
    px = px[inside]
    square = (px * px).sum(1)
    near = box_distance(pq, low, high)
    base = (q * q).sum(1) + proj.most
    out = []
    for i in range(len(q)):
        order = np.argsort(near[i], kind="stable")
        kth, rows, dist, at, verified = bound[i], np.zeros(0, int), np.zeros(0), 0, 0
        while at < len(order) and near[i, order[at]] <= limit * kth:
            upto = at + max(1, VERIFY_AT_ONCE // LEAF_ROWS)
            leaves = order[at:upto][near[i, order[at:upto]] <= limit * kth]
            at = upto
            met = np.concatenate([np.arange(ends[j] - len(tree.rows[j]), ends[j]) for j in leaves])
            if np.isfinite(kth):
                away = square[met] - 2 * (px[met] @ pq[i]) + pq[i] @ pq[i]
                met = met[away <= limit * kth]
            new = inside[met]
            verified += len(new)
            rows = np.concatenate([rows, new])
            dist = np.concatenate([dist, base[i] - 2 * (x[new] @ q[i])])
            sort = np.argsort(dist, kind="stable")
            last = np.searchsorted(np.cumsum(weight[rows[sort]]), k)
            if last < len(sort):
                kth = min(kth, max(dist[sort[last]], 0.0))
                # Equal distances stay: ids decide between them.
                keep = dist <= dist[sort[last]] + 1e-9 * proj.most
                rows, dist = rows[keep], dist[keep]
        out.append((rows, verified))
    return out


def valid(v: Column) -> Column:
    """A vector that takes part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def vector_key() -> Column:
    """128 bits that name the vector v."""
    return F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    dimensions: int = 32,
    sure: float = 0.8,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by inner product, ties to the smaller id.

    Beside them verified: how many distinct vectors were compared with the query's in full.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # Of equal vectors the first k + 1 ids; the limit acts before the shuffle too.
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = written(
        rows.select("vec_id", "v").withColumn("n", first).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("key", vector_key()),
        "vectors",
    )
    asked = written(rows.where("q").select("vec_id", "v").withColumn("key", vector_key()), "queries")
    shape = distinct.agg(
        F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.count("*").alias("n")
    ).first()
    result = "query_id long, rank int, vec_id long, score double, verified long"
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], result)
    width, most, limit = shape["width"], shape["most"], chi2_quantile(sure, dimensions)
    proj = Projection(width, dimensions, seed, most)

    share = min(1.0, SAMPLE_ROWS / shape["n"])
    sample = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": list(proj.data(matrix(list(b["v"]), width)))})

    # 2 SAMPLE_ROWS projections at most.
    points = matrix([r["p"] for r in sample.select("v").mapInPandas(projected, "p array<double>").limit(2 * SAMPLE_ROWS).collect()], dimensions)
    blocks = min(MOST_BLOCKS, max(1, round(shape["n"] / BLOCK_ROWS)))
    top = KdTree(points, max(1, math.ceil(len(points) / blocks)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(block=top.leaf_of(proj.data(matrix(list(b["v"]), width))))

    placed = distinct.mapInPandas(place, "v array<double>, ids array<long>, key string, block long")
    placed = written(placed, "placed")
    counts = placed.groupBy("block").agg(F.count("*").alias("rows"))  # one row for each of MOST_BLOCKS at most
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / (2 * BLOCK_ROWS))).cast("long")
    split = written(counts.withColumn("parts", parts).drop("rows"), "blocks")
    data = placed.join(F.broadcast(split), "block").withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(block=top.leaf_of(proj.query(matrix(list(b["v"]), width))), bound=np.inf)

    queries = asked.groupBy("key").agg(F.first("v").alias("v")).select("v", "key")
    at_home = queries.mapInPandas(home, "v array<double>, key string, block long, bound double")

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "score", "ids", "verified"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        q, x = matrix(list(left["v"]), width), matrix(list(right["v"]), width)
        ids, keys = list(right["ids"]), list(left["key"])
        found = search(q, left["bound"].to_numpy(float), x, np.array([len(i) for i in ids]), proj, k + 1, limit)
        out = []
        for i, (at, verified) in enumerate(found):
            # The score sums the products in order, as plain double arithmetic does.
            scores = np.cumsum(x[at] * q[i], axis=1)[:, -1].tolist() if len(at) else []
            out += [(keys[i], s, ids[j], 0) for s, j in zip(scores, at.tolist(), strict=True)]
            out.append((keys[i], None, None, verified))
        return pd.DataFrame(out, columns=names)

    def ask(routed: DataFrame) -> DataFrame:
        """routed (v, key, block, bound) -> key, score, ids found in those blocks; without ids, the rows verified there."""
        spread = (
            routed.join(F.broadcast(split), "block")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        )
        load = written(spread.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.max("parts") / QUERY_GROUP)).cast("long").alias("groups")), "load")
        spread = spread.join(F.broadcast(load), "block").withColumn("group", F.pmod(F.xxhash64("key"), "groups")).drop("groups", "parts")
        wanted = data.join(F.broadcast(load), "block").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
        keys = ["block", "part", "group"]
        return spread.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(answer, "key string, score double, ids array<long>, verified long")

    first_found = written(ask(at_home), "found")
    # The k+1-th best so far bounds the distance: |q|^2 + most - 2 score.
    ranked = first_found.select("key", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    kth = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("key").agg(F.max("n").alias("n"), F.min("score").alias("kth"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bound = F.when(F.col("n") > k, F.greatest(F.lit(0.0), square + F.lit(most) - 2 * F.col("kth")) * (1 + 1e-9)).otherwise(float("inf"))
    bounded = at_home.drop("bound").join(kth, "key", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).select("v", "key", "block", "bound")
    low, high = np.array(top.low), np.array(top.high)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 256):
                c = b.iloc[s : s + 256]
                near = box_distance(proj.query(matrix(list(c["v"]), width)), low, high)
                i, j = np.nonzero(near <= limit * c["bound"].to_numpy(float)[:, None])
                own = j == c["block"].to_numpy()[i]
                i, j = i[~own], j[~own]
                yield pd.DataFrame({"v": c["v"].to_numpy()[i], "key": c["key"].to_numpy()[i], "block": j, "bound": c["bound"].to_numpy()[i]})

    second = ask(written(bounded.mapInPandas(route, "v array<double>, key string, block long, bound double"), "routed"))
    both = written(first_found.unionByName(second), "found")
    verified = both.groupBy("key").agg(F.sum("verified").alias("verified"))
    found = both.select("key", "score", F.explode("ids").alias("id"))
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("best")
    )
    # k + 1 results for each distinct query vector; one that very many queries share is split.
    own = join_small(asked.select(F.col("vec_id").alias("query_id"), "key").distinct(), best.join(verified, "key"), ["key"], "inner", 10_000)
    rest = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", "verified", F.posexplode(rest).alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"), "verified"
    )
