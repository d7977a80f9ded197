"""Centroid clustering with Ptolemaic pivots.

The initial centroids are the pivots, in fixed pairs, and every vector keeps its
distances to them.  By Ptolemy's inequality

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

for a pair (p, q), so numbers that are known give a lower bound for each
centroid.  Bounds are rounded down; a centroid whose bound is not above the best
exact distance is checked exactly, in whole numbers.

A round is one pass over the stored vectors that ends in a few sums for each
task and cluster; only the sums of the clusters, one row each, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.llm.common import bounded_batches, stored, table

#: Components of a vector, clusters, rounds, and parts of one that a component counts in.
SIZE, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Whole components are below this; so all squared distances are exact in 64 bits.
LARGEST = 1 << 27
#: More than the relative error of a product, a root or a quotient of doubles.
SLACK = 1e-12


# ---------------------------------------------------------------- vectors


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with all ``SIZE`` components, as whole numbers."""
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.filter((F.size(x) == SIZE) & finite)
    scaled = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")))
    small = F.forall(F.transform(x, lambda c: SCALE * c.cast("double")), lambda c: F.abs(c) < LARGEST)
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or more")))
    return kept.select(F.col(f"`{vec_id}`").alias("vec_id"), checked.cast("array<int>").alias("v"))


def first_centroids(whole: DataFrame) -> np.ndarray:
    """The vectors with the smallest digests of their ids; of rows that share an id, those of the smaller vectors."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.orderBy(digest, "v").limit(CLUSTERS).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    off = x - centroid
    return np.einsum("ij,ij->i", off, off)


def matrix_of(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def with_pivots(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with ``far``, their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("v"), np.int64)
            far = np.sqrt(np.stack([squared(x, p) for p in pivots], 1).astype(np.float64)) if len(x) else np.zeros((0, 1))
            offsets = pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "far"])

    return whole.mapInArrow(run, T.StructType([*whole.schema, T.StructField("far", T.ArrayType(T.DoubleType()))]))


# ---------------------------------------------------------------- assignment


class Nearest:
    """Finds the nearest of some centroids; of equally near ones that with the smaller number."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        self.far = np.sqrt(np.stack([squared(centroids, p) for p in pivots], 1).astype(np.float64))
        pairs = [(p, p + 1) for p in range(0, len(pivots) - 1, 2)]
        apart = {(p, q): float(np.sqrt(float(squared(pivots[p : p + 1], pivots[q])[0]))) for p, q in pairs}
        self.pairs = {pair: d for pair, d in apart.items() if d > 0}

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Squares of what rows are away from each centroid at least; ``far`` has their distances to the pivots."""
        least = np.zeros((len(far), len(self.centroids)))
        for (p, q), apart in self.pairs.items():
            a = far[:, p : p + 1] * self.far[None, :, q]
            b = far[:, q : q + 1] * self.far[None, :, p]
            np.maximum(least, (np.abs(a - b) - SLACK * (a + b)) / apart * (1 - SLACK), out=least)
        return least * least * (1 - SLACK)

    def assign(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and how many distances were taken exactly."""
        least = self.bounds(far)
        cluster = least.argmin(1)
        off = x - self.centroids[cluster]
        best, taken = np.einsum("ij,ij->i", off, off), len(x)
        begun = cluster.copy()
        for j, centroid in enumerate(self.centroids):
            rows = np.flatnonzero((least[:, j] <= best) & (begun != j))
            d = squared(x[rows], centroid)
            better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], j
            taken += len(rows)
        return cluster, best, taken


def cluster_sums(rows: DataFrame, nearest: Nearest) -> list:
    """(cluster, n, s) with the componentwise sums of the vectors of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(nearest.centroids), np.int64)
        sums = np.zeros((len(nearest.centroids), SIZE), np.int64)
        for batch in batches:
            x = matrix_of(batch.column("v"), np.int64)
            if len(x):
                cluster, *_ = nearest.assign(x, matrix_of(batch.column("far"), np.float64))
                n += np.bincount(cluster, minlength=len(n))
                np.add.at(sums, cluster, x)
        columns = [pa.array(np.arange(len(n)), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "s"])

    partial = rows.select("v", "far").mapInArrow(run, "cluster int, n long, s array<long>")
    # One statement, as each call that builds a column is a call to the JVM.
    sums = ", ".join(f"sum(s[{k}]) AS s{k}" for k in range(SIZE))
    total = f"SELECT cluster, sum(n) AS n, {sums} FROM {{partial}} GROUP BY cluster HAVING sum(n) > 0"
    return rows.sparkSession.sql(total, partial=partial).collect()


def assigned(rows: DataFrame, nearest: Nearest) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("v"), np.int64)
            if len(x):
                cluster, best, _ = nearest.assign(x, matrix_of(batch.column("far"), np.float64))
                columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    schema = T.StructType(list(rows.select("vec_id").schema)).add("cluster", T.IntegerType()).add("distance", T.LongType())
    return rows.select("vec_id", "v", "far").mapInArrow(run, schema)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all whole vectors.

    Vectors that are null, of another length, or have a component that is null
    or not finite are left out.  A component of 2^17 or more is an error, since
    its distances would not fit.  Rows that repeat count each; a null id counts
    as empty text when the first centroids are chosen.  Fewer than ``CLUSTERS``
    vectors make fewer clusters, an empty table gives an empty table.  Only the
    id and the vector are read, so other columns may have any names.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = whole_vectors(vectors, vec_id, embedding)
    pivots = first_centroids(whole)
    columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(pivots):
        return spark.createDataFrame([], whole.select("vec_id").schema).selectExpr(
            "vec_id", *[f"cast(null AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", ")]
        )
    rows = stored(with_pivots(whole, pivots), "vectors")
    centroids = pivots.copy()
    for _ in range(rounds):
        for r in cluster_sums(rows, Nearest(pivots, centroids)):
            # Whole numbers of any size, rounded down.
            centroids[r["cluster"]] = [r[f"s{k}"] // r["n"] for k in range(SIZE)]
    found = stored(assigned(rows, Nearest(pivots, centroids)), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance")).scalar()
    facts = F.broadcast(names.join(inertia, "cluster", "left").withColumn("inertia", total))
    return found.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings"))


def _round(k: int) -> str:
    """Assignment number k and the centroids after it."""
    return f"""
d{k} AS MATERIALIZED (
  SELECT r, c, CAST(list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (x.v[i] - m.v[i]) * (x.v[i] - m.v[i]))) AS BIGINT) AS d
  FROM x CROSS JOIN c{k} AS m
),
a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY r)"""


def _means(k: int) -> str:
    return f"""
s{k} AS (
  SELECT a.c, u.i, sum(x.v[u.i]) AS s, count(*) AS n
  FROM a{k - 1} AS a JOIN x USING (r) CROSS JOIN (SELECT unnest(range(1, {SIZE + 1})) AS i) AS u GROUP BY a.c, u.i
),
c{k} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{k - 1} AS o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY c
  ) AS n USING (c)
)"""


OP13_SQL = (
    f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS r
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}
),
c0 AS (SELECT r AS c, v FROM x WHERE r < {CLUSTERS}),"""
    + "".join(f"{_round(k)},{_means(k + 1)}," for k in range(ROUNDS))
    + _round(ROUNDS)
    + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN x USING (r) JOIN c{ROUNDS} AS m ON m.c = a.c
"""
)
