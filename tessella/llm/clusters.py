"""Centroid clustering by kd-tree filtering, in whole numbers.

Vectors become integers, floor(scale * x). Every partition packs its vectors into kd-trees of at most `BLOCK` of them, cut
at the median of the widest dimension; the nodes of a tree hold counts, sums and boxes. The trees are stored once, and
each round reads them: from the root down a node keeps the centroids that may be nearest to some point of its box. Of
them the one nearest to the box's middle is set against each other one, which goes if it is farther from every point of
the box, strictly (where a tie is possible it stays). A node with one centroid left is assigned whole, by its count and sum;
what is left in the leaves is resolved point by point, ties to the smaller number.

A round sends for each task one row for each centroid, dimension and digit of the sums (base 2 ** 40, so that any sum is
exact), which are added before they reach the driver: centroids times dimensions rows, whatever the table's size. Centroids
travel to the tasks as they are, k times dimensions numbers.

Defined cases: vectors that are null, have another number of components or a null or non-finite component take no part.
Null ids can't be first centroids, since they have no hash; their vectors are assigned like others. Rows that repeat an
id are vectors of their own; among first centroids of one id those of smaller vectors come first. Fewer vectors than k
give fewer centroids; none give an empty result. Numbers beyond what doubles or longs hold exactly are computed with
Python's integers; distances and sums beyond a long are cut off at its limit. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64.0
#: Vectors of a tree at most, and of a leaf.
BLOCK, LEAF = 8192, 16
#: Largest component for which all distances between vectors and centroids stay exact in longs, times the square root of the dimensions.
EXACT = 2**29
DIGIT = 40
LIMIT = 2**63 - 1


def kept(rows: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of `dims` finite components as doubles."""
    x = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def whole(x, scale: float):
    """floor(scale * x) as longs, or as Python integers where distances could leave a long."""
    import numpy as np

    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if not out.size or np.abs(out).max() * math.sqrt(x.shape[1]) < EXACT:
        return out.astype(np.int64)
    from fractions import Fraction

    exact = [[math.floor(c) if math.isfinite(c) else math.floor(Fraction(scale) * Fraction(raw)) for c, raw in zip(row, of, strict=True)] for row, of in zip(out.tolist(), x.tolist(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def first_centroids(vectors: DataFrame, k: int, scale: float, order: Column) -> list[list[int]]:
    """The k vectors that come first in an order, as integers."""
    import numpy as np

    rows = vectors.where("vec_id is not null").orderBy(order, "v").limit(k).collect()
    return [list(map(int, row)) for row in whole(np.array([r["v"] for r in rows], float).reshape(len(rows), -1), scale).tolist()] if rows else []


class Tree:
    """A kd-tree over the rows of x, as arrays: node i has the children 2i + 1 and 2i + 2 and the rows order[start[i]:end[i]]."""

    def __init__(self, x):
        import numpy as np

        n = len(x)
        depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
        self.x, self.order = x, np.arange(n)
        self.start, self.end = np.zeros(2 ** (depth + 1) - 1, np.int64), np.zeros(2 ** (depth + 1) - 1, np.int64)
        self.end[0], self.depth = n, depth
        self.low, self.high, self.sum = (np.zeros((len(self.start), x.shape[1]), x.dtype) for _ in range(3))
        for node in range(len(self.start)):
            s, e = self.start[node], self.end[node]
            own = x[self.order[s:e]]
            if len(own):
                self.low[node], self.high[node], self.sum[node] = own.min(0), own.max(0), own.sum(0)
            if 2 * node + 1 < len(self.start):
                middle = (s + e) // 2
                if len(own) > 1:
                    widest = (self.high[node] - self.low[node]).argmax()
                    self.order[s:e] = self.order[s:e][np.argsort(own[:, widest], kind="stable")]
                self.start[[2 * node + 1, 2 * node + 2]] = s, middle
                self.end[[2 * node + 1, 2 * node + 2]] = middle, e

    def filtered(self, centroids):
        """(whole, left): (node, centroid) of nodes that are assigned whole, and (leaf, centroids) of leaves with several candidates."""
        import numpy as np

        k = len(centroids)
        norm = (centroids * centroids).sum(1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        done, left = [], []
        for level in range(self.depth + 1):
            low, high = self.low[nodes], self.high[nodes]
            # squared distance to the box's middle, times four, without the part that all centroids share
            near = np.where(alive, 4 * norm[None] - 4 * ((low + high) @ centroids.T), _most(centroids.dtype)).argmin(1)
            # of |z - p|^2 - |near - p|^2 the least over the box
            away = centroids[None] - centroids[near][:, None]
            reach = np.where(away > 0, away * high[:, None], away * low[:, None]).sum(2)
            alive &= (norm[None] - norm[near][:, None] - 2 * reach) <= 0  # near itself has 0
            single = alive.sum(1) == 1
            done += zip(nodes[single].tolist(), alive[single].argmax(1).tolist(), strict=True)
            nodes, alive = nodes[~single], alive[~single]
            if level == self.depth:
                left = [(i, np.flatnonzero(a)) for i, a in zip(nodes.tolist(), alive, strict=True)]
            nodes, alive = np.stack([2 * nodes + 1, 2 * nodes + 2], 1).ravel(), np.repeat(alive, 2, 0)
        return done, left

    def rows(self, node: int):
        return self.order[self.start[node] : self.end[node]]


def _most(dtype):
    return float("inf") if dtype == object else 2**62


def nearest(x, centroids, some):
    """The nearest of some centroids to each row of x, ties to the smaller number."""
    import numpy as np

    c = centroids[some]
    score = (c * c).sum(1)[None] - 2 * (x @ c.T)
    return some[score.argmin(1)] if score.dtype != object else some[np.array([min(range(len(r)), key=r.__getitem__) for r in score.tolist()], int)]


def alike(x, centroids: list[list[int]]):
    """x and the centroids as arrays of one kind: longs if all distances fit, else Python's integers."""
    import numpy as np

    fits = x.dtype != object and max(abs(c) for row in centroids for c in row) < EXACT // math.isqrt(4 * x.shape[1])
    return (x, np.array(centroids, np.int64)) if fits else (x.astype(object), np.array(centroids, object))


def packed(vectors: DataFrame, scale: float, block: int = BLOCK) -> DataFrame:
    """(ids, tree): the vectors of each partition as trees of at most `block` of them."""

    def run(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        ids: list = []
        held: list = []

        def out():
            t = Tree(whole(np.array(held, float), scale))
            return pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([pickle.dumps(t, 5)], pa.binary())], schema=pa.schema([("ids", pa.list_(pa.int64())), ("tree", pa.binary())]))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(v)
                if len(held) == block:
                    yield out()
                    ids.clear(), held.clear()
        if held:
            yield out()

    return vectors.mapInArrow(run, "ids array<long>, tree binary")


def digits(value: int) -> list[int]:
    """A whole number as signed digits, the lowest first."""
    out, sign, value = [], -1 if value < 0 else 1, abs(value)
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


def summed(trees: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(count, sums) of the vectors nearest to each centroid."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        count, sums = [0] * k, [[0] * dims for _ in range(k)]

        def add(c, n, s):
            count[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s.tolist(), strict=True)]

        for b in batches:
            for raw in b.column(0):
                t = pickle.loads(raw.as_buffer())
                x, z = alike(t.x, centroids)
                if x.dtype != t.x.dtype:
                    t = Tree(x)
                done, left = t.filtered(z)
                for c in range(k):
                    own = np.array([i for i, of in done if of == c], np.int64)
                    if len(own):
                        add(c, int((t.end[own] - t.start[own]).sum()), t.sum[own].sum(0))
                for leaf, some in left:
                    rows = t.rows(leaf)
                    of = nearest(x[rows], z, some)
                    for c in np.unique(of).tolist():
                        add(c, int((of == c).sum()), x[rows[of == c]].sum(0))
        found = [(c, d, p, v) for c in range(k) for d, value in enumerate([count[c], *sums[c]]) for p, v in enumerate(digits(value))]
        cols = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "d", "p", "v"])

    rows = trees.select("tree").mapInArrow(run, "c int, d int, p int, v long").groupBy("c", "d", "p").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()  # k * (dims + 1) * digits rows
    total = [[0] * (dims + 1) for _ in range(k)]
    for r in rows:
        total[r["c"]][r["d"]] += int(r["v"]) << (DIGIT * r["p"])
    return [(row[0], row[1:]) for row in total]


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for ids, raw in zip(b.column(0), b.column(1), strict=True):
                t = pickle.loads(raw.as_buffer())
                x, z = alike(t.x, centroids)
                if x.dtype != t.x.dtype:
                    t = Tree(x)
                of = np.zeros(len(x), np.int64)
                done, left = t.filtered(z)
                for node, c in done:
                    of[t.rows(node)] = c
                for leaf, some in left:
                    of[t.rows(leaf)] = nearest(x[t.rows(leaf)], z, some)
                far = x - z[of]
                distance = [min(LIMIT, int(v)) for v in (far * far).sum(1).tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(of.astype(np.int32)), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, order: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = rows.sparkSession
    vectors = kept(rows, dims, vec_id, vector)
    centroids = first_centroids(vectors, k, scale, F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256) if order is None else order)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    trees = cut(packed(vectors, scale, block))
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old for old, (n, sums) in zip(centroids, summed(trees, centroids), strict=True)]
    out = cut(assigned(trees, centroids))
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    table = [(c, min(LIMIT, d), min(LIMIT, sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    told = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
