"""Exact top-k search by inner product in three phases with one uniform threshold.

Vectors are packed into blocks of `block` rows, queries alike; a query block meets every row block inside one task, so no
pair of vectors ever is a row. A vector's dimensions are cut into `parts` lists: a list's local score is the product over
its dimensions, and the whole score is the sum of the local ones.

1. Gather. From every list of a row block the `k` entries with the best local scores are taken for each query. Only these
   leaders' other local scores are looked up; the best k go out. The k-th best of all is a safe cutoff: no answer is below.
2. Collect. The cutoff goes back to every row block. An object whose local scores all stay below cutoff / parts can't
   reach it, so the entries with a local score of at least that (the uniform threshold) suffice. A list whose largest
   possible product (norm of the query by the block's largest norm) is below the threshold in all parts isn't computed.
3. Resolve. What was collected is scored exactly; a row block sends what reaches the cutoff, its best k at most for each
   query (ties to the smaller id), and a window keeps the best k of all.

Components are floor(scale * x); scores are exact integers. Products that could leave what a double holds exactly are
computed with Python's integers, components beyond a double's range too; a score beyond a long is cut off at its limits,
ranks follow the exact score within a block.

Row blocks are dealt to shares, whose number follows the cluster and not the data; the queries, the smaller side, are
copied to each share. So the shuffle grows in proportion to the tables.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, take no part; neither do null ids
as queries or candidates. Only vectors of equal length meet. A query's own row never is its candidate; rows that repeat
an id count as that same row. Repeated query rows answer once. Fewer candidates than k give fewer rows. An empty table
gives an empty result. Other columns are ignored, but is_query may use them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

BLOCK = 2048
PARTS = 4
#: Shares for each core at most.
SHARES = 16
EXACT = 2**50
LIMIT = 2**63 - 1


def valid_vectors(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, asks): the components as doubles; rows that take no part are gone."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and x is not null").where((F.size("x") > 0) & whole)
    return rows.select("vec_id", F.col("x").alias("v"), "asks")


def blocked(vectors: DataFrame, block: int) -> DataFrame:
    """(dims, n, ids, data): packed blocks of at most `block` rows of vectors(vec_id, v); data holds little-endian doubles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def out(dims, rows):
            ids = np.array([i for i, _ in rows], "<i8")
            data = np.array([v for _, v in rows], "<f8")
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["dims", "n", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == block:
                    yield out(len(v), rows)
                    rows.clear()
        for dims, rows in held.items():
            if rows:
                yield out(dims, rows)

    return vectors.mapInArrow(run, "dims int, n int, ids binary, data binary")


def whole(x, scale: float):
    """floor(scale * x) as doubles, or as Python integers where a double doesn't hold them."""
    import numpy as np

    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if np.isfinite(out).all():
        return out
    from fractions import Fraction

    return np.array([[math.floor(Fraction(scale) * Fraction(c)) for c in row] for row in x.tolist()], object).reshape(x.shape)


def exactly(q, x):
    """q and x as they are if doubles hold all their products' sums exactly, else as Python integers."""
    import numpy as np

    if q.dtype != object and x.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT:
        return q, x
    return tuple(np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, x))


def lists_of(dims: int, parts: int):
    """The dimensions of each list."""
    import numpy as np

    return np.array_split(np.arange(dims), min(parts, dims))


def gathered(q, x, lists, k: int):
    """For each query the columns that lead a list (the best k of it and one more, as one may be its own row), and their whole scores."""
    import numpy as np

    n = min(k + 1, len(x))
    found = []
    for p in lists:
        local = q[:, p] @ x[:, p].T
        found.append(np.argsort(-local, 1)[:, :n] if local.dtype == object or n == len(x) else np.argpartition(local, len(x) - n, 1)[:, len(x) - n :])
    columns = np.sort(np.concatenate(found, 1), 1)
    score = np.stack([(x[c] * row).sum(1) for c, row in zip(columns, q, strict=True)]) if len(q) else np.zeros(columns.shape)
    fresh = np.ones(columns.shape, bool)
    fresh[:, 1:] = columns[:, 1:] != columns[:, :-1]
    return columns, score, fresh


def collected(q, x, lists, cutoffs):
    """(query rows, columns, whole scores) of the entries that some list raises to cutoff / parts; a cutoff of None takes all."""
    import numpy as np

    open_ = np.array([c is None for c in cutoffs])
    least = np.array([0 if c is None else c for c in cutoffs], object if q.dtype == object else float)
    if q.dtype == object:
        alive = np.arange(len(q))
    else:  # norms rounded up a little bound every local score
        bound = np.stack([np.sqrt((q[:, p] ** 2).sum(1)) * np.sqrt((x[:, p] ** 2).sum(1).max(initial=0)) for p in lists], 1)
        alive = np.flatnonzero(open_ | (bound.max(1) * 1.000001 * len(lists) >= least))
    local = [q[alive][:, p] @ x[:, p].T for p in lists]
    reach = np.logical_or.reduce([(s * len(lists) >= least[alive][:, None]).astype(bool) for s in local]) | open_[alive][:, None]
    rows, columns = np.nonzero(reach)
    return alive[rows], columns, sum(s[rows, columns] for s in local)


def _best(score, ids, k):
    """The k columns of a row with the highest scores, ties to the smaller id."""
    import numpy as np

    if len(score) > 4 * k and score.dtype != object:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    if score.dtype == object:
        return np.array(sorted(some.tolist(), key=lambda j: (-score[j], ids[j]))[:k], int)
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _unpack(row, side):
    import numpy as np

    dims = row["dims"]
    return np.frombuffer(row[f"{side}_ids"], "<i8"), np.frombuffer(row[f"{side}_data"], "<f8").reshape(-1, dims)


def _clip(x) -> int:
    return max(-LIMIT - 1, min(LIMIT, int(x)))


def _sent(ids, values, owner):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of `rows` for which is_query holds."""
    vectors = cut(valid_vectors(rows, is_query, vec_id, vector))
    spark = rows.sparkSession
    objects = cut(blocked(vectors.select("vec_id", "v"), block)).select("dims", F.col("ids").alias("x_ids"), F.col("data").alias("x_data"))
    asked = vectors.where("asks").select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    asked = blocked(asked, max(1, block // 2)).select("dims", F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    asked = cut(asked)
    cores = spark.sparkContext.defaultParallelism
    shares = max(cores, min(objects.count() // 8, SHARES * cores))
    dealt = objects.withColumn("share", F.pmod(F.xxhash64("x_ids"), F.lit(shares)))

    def meet(queries: DataFrame) -> DataFrame:
        every = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))
        return dealt.join(every, ["share", "dims"])

    def pairs(batches):
        """(row, query ids, queries, object ids, objects) of each pair of blocks, one at a time."""
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                (q_ids, q), (x_ids, x) = _unpack(row, "q"), _unpack(row, "x")
                yield row, q_ids, *exactly(whole(q, scale), whole(x, scale)), x_ids

    def leaders(batches):
        for row, q_ids, q, x, x_ids in pairs(batches):
            columns, score, fresh = gathered(q, x, lists_of(row["dims"], parts), k)
            ids, values, owner = [], [], []
            for i, own in enumerate(q_ids.tolist()):
                seen = fresh[i] & (x_ids[columns[i]] != own)
                at, s = columns[i][seen], score[i][seen]
                best = _best(s, x_ids[at], k)
                ids += x_ids[at[best]].tolist()
                values += [_clip(v) for v in s[best]]
                owner += [own] * len(best)
            yield _sent(ids, values, owner)

    def resolve(batches):
        import numpy as np

        for row, q_ids, q, x, x_ids in pairs(batches):
            cutoff = {i: c for i, c in row["cutoffs"] or [] if -LIMIT - 1 < c < LIMIT}
            own_cut = [cutoff.get(i) for i in q_ids.tolist()]
            at, columns, score = collected(q, x, lists_of(row["dims"], parts), own_cut)
            ids, values, owner = [], [], []
            ends = np.searchsorted(at, np.arange(len(q_ids) + 1))
            for i in np.unique(at).tolist():
                some, s = columns[ends[i] : ends[i + 1]], score[ends[i] : ends[i + 1]]
                keep = x_ids[some] != q_ids[i]
                if own_cut[i] is not None:
                    keep &= (s >= own_cut[i]).astype(bool)
                some, s = some[keep], s[keep]
                best = _best(s, x_ids[some], k)
                ids += x_ids[some[best]].tolist()
                values += [_clip(v) for v in s[best]]
                owner += [int(q_ids[i])] * len(best)
            yield _sent(ids, values, owner)

    found = "query_id long, vec_id long, score long"
    first = _ranked(cut(meet(asked).mapInArrow(leaders, found)), k)
    cutoffs = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).where(F.col("n") == k).select("query_id", "cutoff")
    by_block = _owned(asked).join(cutoffs, "query_id").groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "cutoff"))).alias("cutoffs"))  # block // 2 queries at most
    last = cut(meet(asked.join(by_block, "q_block", "left")).mapInArrow(resolve, found))
    return _ranked(last, k).select("query_id", "rank", "vec_id", "score")


def _owned(asked: DataFrame) -> DataFrame:
    """(q_block, query_id) from packed query blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["q_block", "query_id"])

    return asked.select("q_block", "q_ids").mapInArrow(run, "q_block long, query_id long").distinct()


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query with their rank; an id counts once, with its best score."""
    from pyspark.sql import Window

    best = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
