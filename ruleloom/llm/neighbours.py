"""Approximate nearest neighbours by a forest of random-projection trees, with exact reranking.

The forest is fitted on a bounded sample, and every vector is placed in a leaf of each tree. A query searches all trees
through one priority queue for its nearest leaves, and meets the vectors in these, in blocks; exact Euclidean distances
in double precision rank them. How many leaves a query takes is measured, not set: so many that of a bounded set of
queries, answered by a scan of all vectors, a share RECALL of all neighbours lies in the leaves taken. So the recall
holds on data of any kind; on data without structure the leaves taken are a large part of all.

Equal vectors are searched once: of each vector's ids only the k + 1 smallest can be among anyone's k nearest, so
groups of copies, however large, take that many ids to the index, and each query takes its own id out of what its vector
found. A row is known by id and vector: equal rows count once. Ids that repeat with other vectors are rows of their own.
A null id is no query; as a candidate it comes after other ids. Vectors null, empty or zero, or with null or non-finite
components take no part, nor do those of another length than most (the smaller length, if tied). Components whose squares
exceed a double's range give infinite scores. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import power_of_two, scratch
from ruleloom.llm.projection_forest import Forest

#: Rows that the forest is fitted on, about; queries that set the leaves to take; the share of neighbours these must hold.
SAMPLE, MEASURED, RECALL = 65_536, 256, 0.95
#: The sample's bytes, as doubles, bound it too.
SAMPLE_BYTES = 64 << 20
TREES, LEAF_ROWS = 4, 64
#: Bytes of all trees' planes; with the sample this bounds their leaves.
PLANE_BYTES = 32 << 20
#: Leaves that are stored together; vectors and queries of a block.
GROUP_LEAVES, BLOCK_ROWS, BLOCK_QUERIES = 16, 1024, 256
#: Queries whose margins are computed at once.
AT_ONCE = 32


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, vec, u) of the vectors that take part; u: the vector's hash."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.where(finite).select(F.col(id_col).alias("_id"), vec.alias("vec"))
    most = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("vec") == (most["dims"] if most else 0)).withColumn("u", F.xxhash64("vec"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """n vectors of a list column, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((q**2).sum(1)[:, None] - 2 * (q @ x.T) + (x**2).sum(1), nan=np.inf)


def _nearest(q: np.ndarray, x: np.ndarray, met: np.ndarray, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and x, and distances, of the k nearest x that each q meets, ties by tie.

    A matrix product finds the rows near the k-th distance, within its rounding; these are measured exactly.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.where(met, _squares(q, x), np.inf)
        slack = 1e-9 * ((q**2).sum(1) + (x**2).sum(1).max())
        kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        i, j = np.nonzero(met & ~(near > (kth + slack)[:, None]))
        d = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
    order = np.lexsort((tie[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def _measured(vectors: DataFrame, queries: DataFrame, k: int, forest: Forest) -> int:
    """The leaves that a query must take: a scan answers MEASURED queries, whose neighbours' leaves are then looked up."""
    n = queries.count()
    drawn = queries.where(F.pmod(F.xxhash64("u", F.lit(3)), F.lit(max(1, n // MEASURED))) == 0).limit(2 * MEASURED).collect()
    if not drawn:
        return forest.leaves * forest.trees
    q, own = np.array([r["vec"] for r in drawn], np.float64), np.array([r["u"] for r in drawn])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, u = _matrix(batch.column(1), batch.num_rows), batch.column(0).to_numpy()
            i, j, d = _nearest(q, x, own[:, None] != u, k, u)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(u[j]), pa.array(d), batch.column(1).take(pa.array(j))], ["i", "u", "d", "vec"])

    found = vectors.select("u", "vec").mapInArrow(scan, f"i int, u long, d double, vec {vectors.schema['vec'].dataType.simpleString()}")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "u"))).where(F.col("r") <= k)
    rows = found.select("i", "vec").collect()  # 2 x MEASURED x k rows at most
    if not rows:
        return forest.leaves * forest.trees
    of = np.array([r["i"] for r in rows])
    leaf = forest.place(np.array([r["vec"] for r in rows], np.float64))
    needed = np.zeros(len(rows), np.int64)
    for i in np.unique(of):
        order = forest.order(forest.margins(q[i : i + 1])[0])
        mine = of == i
        needed[mine] = order[np.arange(forest.trees)[:, None], leaf[:, mine]].min(axis=0)
    return int(np.quantile(needed, RECALL, method="higher"))


def _fitted(vectors: DataFrame, n: int, dims: int) -> Forest:
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    drawn = vectors.where(F.pmod(F.xxhash64("u", F.lit(1)), F.lit(max(1, n // rows))) == 0)  # about as many, at most twice
    sample = drawn.select("u", "vec").toArrow().combine_chunks().sort_by("u")
    x = _matrix(sample.column("vec").combine_chunks(), sample.num_rows) if sample.num_rows else np.zeros((0, dims))
    most = min(rows // 8, PLANE_BYTES // (4 * TREES * dims))
    return Forest(x, TREES, power_of_two(min(n / LEAF_ROWS, most // 2 + 1), 1, SAMPLE), seed=11)


def _blocks(rows: DataFrame, of: list[str], size: int, name: str) -> DataFrame:
    """rows by (tree, part of it), gathered into arrays of about size rows."""
    counts = rows.groupBy("tree", "grp").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row for each tree and group, bounded like the forest
    own = rows.join(F.broadcast(counts), ["tree", "grp"]).withColumn("part", F.pmod(F.xxhash64("u", F.lit(2)), "parts"))
    return scratch(own.groupBy("tree", "grp", "part").agg(F.collect_list(F.struct(*of)).alias(name)).drop("part"), name)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row whose id is divisible by every, nearest first.

    A block of vectors is one row, so callers bound Arrow batches by bytes, as common.small_batches() does.
    """
    kind, spark = df.schema[id_col].dataType.simpleString(), df.sparkSession
    rows = usable(df, id_col, vec_col)
    by_id = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    one = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("u", "vec").orderBy(by_id))).where(F.col("r") <= k + 1)
    least = F.coalesce(F.min("_id").cast("long"), F.lit((1 << 63) - 1)).alias("least")
    vectors = scratch(one.groupBy("u", "vec").agg(F.sort_array(F.collect_list(by_id)).alias("ids"), least), "vectors")
    queries = scratch(rows.where(F.col("_id") % every == 0).distinct(), "queries")
    asked = scratch(queries.select("u", "vec").distinct(), "asked")
    n, dims = vectors.count(), len((vectors.select("vec").first() or [[0]])[0])
    forest = _fitted(vectors, n, dims)
    budget = _measured(vectors, asked, k, forest)
    shared, vec = spark.sparkContext.broadcast(forest), df.schema[vec_col].dataType.simpleString()
    trees = forest.trees

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            leaf = shared.value.place(_matrix(batch.column(1), batch.num_rows))
            for t in range(trees):
                own = [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array((leaf[t] // GROUP_LEAVES).astype(np.int32)), pa.array((leaf[t] % GROUP_LEAVES).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["tree", "grp", "leaf", "u", "vec", "ids", "least"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                of, keys, wanted = [], [], []
                for i, margin in enumerate(forest.margins(_matrix(part.column(1), part.num_rows))):
                    found: dict[tuple[int, int], int] = {}
                    for t, leaf in forest.search(margin, budget):
                        key = (t, leaf // GROUP_LEAVES)
                        found[key] = found.get(key, 0) | 1 << leaf % GROUP_LEAVES
                    of += [i] * len(found)
                    keys += found
                    wanted += found.values()
                own = [pa.array([key[0] for key in keys], pa.int32()), pa.array([key[1] for key in keys], pa.int32()), pa.array(wanted, pa.int32())]
                yield pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(of, pa.int64())) for c in part.columns)], ["tree", "grp", "wanted", "u", "vec"])

    ids = vectors.schema["ids"].dataType.simpleString()
    placed = vectors.select("u", "vec", "ids", "least").mapInArrow(place, f"tree int, grp int, leaf int, u long, vec {vec}, ids {ids}, least long")
    index = _blocks(scratch(placed, "placed"), ["leaf", "u", "vec", "ids", "least"], BLOCK_ROWS, "stored")
    probes = asked.select("u", "vec").mapInArrow(probe, f"tree int, grp int, wanted int, u long, vec {vec}")
    asking = _blocks(scratch(probes, "probes"), ["wanted", "u", "vec"], BLOCK_QUERIES, "asking")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, stored in zip(batch.column(0), batch.column(1), strict=True):
                qs, xs = asked.values, stored.values
                met = (qs.field("wanted").to_numpy()[:, None] >> xs.field("leaf").to_numpy()) & 1 > 0
                i, j, d = _nearest(_matrix(qs.field("vec"), len(qs)), _matrix(xs.field("vec"), len(xs)), met, k + 1, xs.field("least").to_numpy())
                of, to = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([qs.field("u").take(of), pa.array(d), xs.field("u").take(to), xs.field("ids").take(to)], ["q", "d", "u", "ids"])

    found = asking.join(index, ["tree", "grp"]).select("asking", "stored").mapInArrow(meet, f"q long, d double, u long, ids {ids}")
    # a vector may be found in each tree, so this many hold the k + 1 nearest vectors
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", F.col("ids")[0], "u"))
    found = found.withColumn("r", rank).where(F.col("r") <= trees * (k + 1)).dropDuplicates(["q", "u"])
    each = found.select("q", F.explode(F.transform("ids", lambda x: F.struct("d", x["none"].alias("none"), x["id"].alias("id"), "u"))).alias("x"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("x"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    out = queries.select(F.col("_id").alias("query_id"), F.col("u").alias("q")).join(lists, "q")
    others = F.slice(F.filter("xs", lambda x: ~(x["id"].eqNullSafe(F.col("query_id")) & (x["u"] == F.col("q")))), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").cast(kind).alias(id_col), F.col("x.d").alias("score"))
