"""Exact top-k by inner product with a pivot table.

Vectors become vectors of whole numbers.  The distances of all vectors to many pivots (far apart from each other, of a bounded
sample) are worked out once and written beside them; by the triangle inequality the largest difference of two vectors'
distances to a pivot is a lower bound of their own distance, and so an upper bound of their inner product:
(|q|^2 + |x|^2 - bound^2) / 2.  Candidates of a block that lie alike to the pivots form groups, whose ranges of distances bound all their
members at once.  Each query takes the group of the highest bound first, and then every group whose bound reaches its k-th score so far;
a group is multiplied with all queries that take it together.  Queries come in blocks of a fixed size, which all tasks get; each task goes through its own
candidates in record batches and returns its k best of each query, and the best of those are kept.

Scores are exact: candidates are multiplied as doubles where no sum can pass 2^53, else as whole numbers of any size; a score
beyond the range of long counts as the end of that range.  How much the bounds save depends on the data: see the README.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part;
vectors of another dimension than the query's are no candidates; every other row is one, so repeated rows
can each take a rank; rows with the query's own id are not candidates; equal query rows count once, and of
unequal ones with one id the least vector is the query; vectors without components score 0; empty input gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE = 256
K = 5
#: Pivots, and the queries among which they are looked for.
PIVOTS, PIVOT_SAMPLE = 64, 2048
#: Queries that all tasks get at a time, and candidates evaluated between two looks at the bounds.
QUERY_BLOCK, EVALUATED = 8192, 256
#: Up to here doubles hold every whole number; the ends of long; the largest double.
WHOLE, LONG, LARGEST = float(1 << 53), (1 << 63) - 1, 1.7976931348623157e308


def integer_vectors(rows: DataFrame, scale: int = SCALE, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, q, dim): floor(scale * x) of each component, as a double that holds it exactly; rows that take no part are left out."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    src = rows.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    src = src.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & F.coalesce(finite, F.lit(False)))

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(x * F.lit(float(scale)), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)

    return src.select("id", F.transform("e", whole).alias("q"), F.size("e").alias("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; where they are too large for doubles, 0 for all, which bounds nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
        return np.nan_to_num(np.sqrt(np.maximum(square, 0)), nan=0.0, posinf=0.0)


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of x, each as far as can be from those taken before."""
    taken = [0] if len(x) else []
    near = pivot_distances(x, x[taken])[:, 0] if taken else np.zeros(0)
    while taken and len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, pivot_distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q, as doubles or Python ints."""
    with np.errstate(over="ignore"):
        if not x.size or np.abs(x).max() * np.abs(q).max() * len(q) < WHOLE:
            return x @ q
    whole = [int(v) for v in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist()], object)


def group_bounds(q: np.ndarray, q_far: np.ndarray, x: np.ndarray, x_far: np.ndarray) -> np.ndarray:
    """For each query an upper bound of its inner product with any row of x, by the ranges of the rows' distances to the pivots."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = (q * q).sum(1) + (x * x).sum(1).max()
        if x_far.shape[1]:
            least, most = x_far.min(0), x_far.max(0)
            # A little is taken off for rounding, so the bound stays one; what doubles cannot say bounds nothing.
            low = (np.maximum(least - q_far, q_far - most) - 1e-6 * (most + q_far)).max(1)
        else:
            low = np.zeros(len(q))
        low = np.maximum(low - 1e-6 * (1 + np.sqrt(total)), 0)
        return np.nan_to_num((total - low * low) / 2 + 1e-6 * (total + 1), nan=np.inf, posinf=np.inf)


def search_block(q: np.ndarray, q_ids: np.ndarray, q_far: np.ndarray, x: np.ndarray, ids: np.ndarray, x_far: np.ndarray, best: list[list[tuple]], k: int) -> int:
    """Brings each query's k best (score, -id), worst first, up to date with a block; returns how many were evaluated."""
    # Candidates at like distances from their nearest pivot stand together.
    order = np.lexsort((x_far.min(1), x_far.argmin(1))) if x_far.shape[1] else np.arange(len(x))
    groups = [order[at : at + EVALUATED] for at in range(0, len(x), EVALUATED)]
    if not groups or not len(q):
        return 0
    bounds = np.array([group_bounds(q, q_far, x[g], x_far[g]) for g in groups])
    worst = np.array([float(mine[0][0]) if len(mine) == k else -np.inf for mine in best])
    worst_id = np.array([-mine[0][1] if len(mine) == k else LONG for mine in best], np.int64)
    with np.errstate(over="ignore"):
        q_most = np.abs(q).max(1, initial=0) * max(1, q.shape[1])

    def merge(i: int, scores: list[int], at: np.ndarray) -> None:
        mine = best[i]
        mine += zip((min(max(int(v), -LONG - 1), LONG) for v in scores), (-ids[at]).tolist())
        mine.sort()
        del mine[:-k]
        if len(mine) == k:
            worst[i], worst_id[i] = float(mine[0][0]), -mine[0][1]

    def evaluate(g: np.ndarray, mine: np.ndarray) -> int:
        """Group g for some queries: all products at once where doubles hold them, else query by query."""
        with np.errstate(over="ignore"):
            exact = q_most[mine] * np.abs(x[g]).max(initial=0) < WHOLE
        for i in mine[~exact]:
            at = g[ids[g] != q_ids[i]]
            merge(i, products(x[at], q[i]).tolist(), at)
        held = mine[exact]
        scores = x[g] @ q[held].T
        own = ids[g][:, None] == q_ids[held]
        better = (scores > worst[held]) | ((scores == worst[held]) & (ids[g][:, None] <= worst_id[held]))
        better &= ~own
        for c in np.flatnonzero(better.any(0)).tolist():
            at = np.flatnonzero(better[:, c])
            if len(at) > k:
                at = at[np.lexsort((ids[g[at]], -scores[at, c]))[:k]]
            merge(held[c], scores[at, c].tolist(), g[at])
        return len(g) * len(mine)

    # First the group that promises each query most, so that its k-th score is high when it comes to the others.
    first, evaluated = bounds.argmax(0), 0
    for n, g in enumerate(groups):
        if len(mine := np.flatnonzero(first == n)):
            evaluated += evaluate(g, mine)
    for n, g in enumerate(groups):
        if len(mine := np.flatnonzero((first != n) & (bounds[n] >= worst))):
            evaluated += evaluate(g, mine)
    return evaluated


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors of whole numbers (id, q, dim), for all queries against all vectors."""
    spark = vectors.sparkSession
    queries = written(queries.groupBy("id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q")), "queries")
    ddl = "query_id long, vec_id long, score long"
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def one_pass(table: DataFrame, qs: list, dim: int, pivots: np.ndarray) -> DataFrame:
        order = sorted(qs, key=lambda r: r.id)
        q = np.array([r.q for r in order], np.float64).reshape(len(order), dim)
        sent = spark.sparkContext.broadcast((q, np.array([r.id for r in order], np.int64), pivot_distances(q, pivots)))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, q_ids, q_far = sent.value
            best: list[list[tuple]] = [[] for _ in q_ids]
            for batch in it:
                if batch.num_rows:
                    x, far = matrix(batch.column("q"), dim), matrix(batch.column("far"), q_far.shape[1])
                    search_block(q, q_ids, q_far, x, batch.column("id").to_numpy(), far, best, k)
            rows = [(i, -v, s) for i, mine in zip(q_ids.tolist(), best) for s, v in mine]
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[a : a + 50_000]), schema)], schema=schema)

        return table.mapInArrow(run, ddl)

    def pivot_table(dim: int, pivots: np.ndarray) -> DataFrame:
        """(id, q, far) of all vectors of the dimension, written: the distances are worked out once for all blocks."""
        at = spark.sparkContext.broadcast(pivots)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                far = pivot_distances(matrix(batch.column("q"), dim), at.value)
                offsets = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))], names=["id", "q", "far"])

        return written(vectors.filter(F.col("dim") == dim).select("id", "q").mapInArrow(run, "id long, q array<double>, far array<double>"), "pivot-table")

    found = []
    for d in queries.groupBy("dim").count().orderBy("dim").collect():
        mine = queries.filter(F.col("dim") == d.dim)
        sample = mine.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
        at = far_apart(np.array([r.q for r in sample], np.float64).reshape(len(sample), d.dim), pivots)
        distances = pivot_table(d.dim, at)
        blocks = -(-d["count"] // block)
        for b in range(blocks):
            part = mine if blocks == 1 else mine.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == b)
            found.append(written(one_pass(distances, part.collect(), d.dim, at), "nearest"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0))


OP2_SQL = """
WITH good AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_exact_search": op2_exact_search}
SQL = {"op2_exact_search": OP2_SQL}
