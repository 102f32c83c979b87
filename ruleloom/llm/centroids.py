"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, floor(scale * x). In each round a task tabulates, for each dimension, the squared
differences of the integers that occur in its chunk of vectors to every centroid's component; a vector's distances are
then sums of rows gathered from these tables. Chunks are bounded, so tables are too, whatever values occur. Tasks add
up their clusters' vectors; only k rows a task meet, and k x dims sums reach the driver, whatever the number of rows.
All of this is integer arithmetic, so results don't depend on partitions or order.

Vectors that are null, of another length, or that hold null or non-finite components are left out, as contracts of this
operator ask. A null id is hashed as an empty one. Rows that repeat are vectors of their own; where ids repeat, equal
digests are put in order by the vector. With fewer than k vectors each starts a centroid. A component beyond
2**27 in size, scaled, counts as 2**27 with its sign: squared distances of up to 127 dimensions then fit 64 bits, and
more dimensions raise an error. An inertia beyond 64 bits is given as the largest long. An empty table, or one
without a usable vector, gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import scratch

#: Vectors whose integers are tabulated at once.
CHUNK = 4096
#: The size to which components are held, and the dimensions for which squared distances then fit a long.
LARGEST, MOST_DIMS = 1 << 27, 127
MAX_LONG = (1 << 63) - 1


def integers(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(_id, q) of the usable vectors; q: floor(scale * x) of each component."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(scale) * x.cast("double")))).cast("int"))
    return df.where((F.size(vec) == dims) & finite).select(F.col(id_col).alias("_id"), scaled.alias("q"))


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to each centroid, summed from one table a dimension."""
    out = np.zeros((len(q), len(centroids)), np.int64)
    for d in range(q.shape[1]):
        occurring, at = np.unique(q[:, d], return_inverse=True)
        table = (occurring[:, None].astype(np.int64) - centroids[:, d]) ** 2
        out += table[at]
    return out


def _chunks(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    q = column.flatten().to_numpy().reshape(-1, dims)
    for lo in range(0, len(q), CHUNK):
        yield q[lo : lo + CHUNK]


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for q in _chunks(batch.column(0), dims):
                nearest = distances(q, centroids).argmin(1)
                n += np.bincount(nearest, minlength=k)
                order = nearest.argsort(kind="stable")
                present, starts = np.unique(nearest[order], return_index=True)
                total[present] += np.add.reduceat(q[order].astype(np.int64), starts)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": own.astype(np.int32), "n": n[own], "total": pa.array(list(total[own]), pa.list_(pa.int64()))})

    parts = vectors.select("q").mapInArrow(sums, "cluster int, n long, total array<long>")
    wide = F.sum(F.col("x").cast("decimal(19,0)")).alias("x")
    each = parts.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), wide)
    out = centroids.copy()
    for r in each.collect():  # k x dims rows
        out[r["cluster"], r["d"]] = int(r["x"]) // r["n"]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if dims > MOST_DIMS:
        raise ValueError(f"at most {MOST_DIMS} dimensions")
    kind, spark = df.schema[id_col].dataType.simpleString(), df.sparkSession
    vectors = scratch(integers(df, id_col, vec_col, dims, scale), "integers")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = vectors.select("q", drawn.alias("h")).orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        centroids = _means(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            met = [distances(q, centroids) for q in _chunks(batch.column(1), dims)]
            nearest = np.concatenate([m.argmin(1) for m in met])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(np.concatenate([m.min(1) for m in met]))], ["_id", "cluster", "distance"])

    assigned = scratch(vectors.mapInArrow(assign, f"_id {kind}, cluster int, distance long"), "clusters")
    shas = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}  # k rows
    whole = min(sum(sums.values()), MAX_LONG)
    each = spark.createDataFrame([(i, min(sums.get(i, 0), MAX_LONG), whole, s) for i, s in shas], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
