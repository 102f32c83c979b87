"""Sharding by sampled splitters.

Rows are put in the order of a key, the hash of their text, so equal texts lie together. A sample of keys, drawn
with chances in proportion to size, gives quantile boundaries that cut the key's range into many ranges of about
equal bytes. The exact bytes of each range are then counted; an overfull range is subdivided: each of its heaviest
texts becomes a range of its own, and one that is larger than a shard's share is divided by id. Last, ranges go to
shards, the largest first, each to the shard with the fewest bytes. Law "bytes": shards' bytes are near equal.

Size is the text's UTF-8 bytes plus 1 (null: 1). Equal texts share a shard unless they are more than a shard's
share. Null and empty texts count as equal. Rows that agree in id and text differ in their slot only. An empty table
gives an empty result. Only counts of ranges, never of rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import scratch, text_or_empty

#: Keys drawn for the boundaries; the ranges they make. A range is a task's work, so ranges grow with the bytes.
SAMPLE_PER_RANGE = 32
RANGE_BYTES = 128 << 20
LEAST_RANGES, MOST_RANGES = 512, 1 << 16


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text, spark = text_or_empty(text_col), df.sparkSession
    rows = scratch(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
            F.xxhash64(F.col(id_col), text).alias("_row"),
        ),
        "sizes",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    # each row is drawn with chance size * rate: about SAMPLE_PER_RANGE keys a range
    rate = SAMPLE_PER_RANGE * ranges / max(total, 1)
    draw = F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    weight = F.greatest(F.lit(1.0), F.col("size") * rate)  # a row of many shares counts as as many keys
    drawn = rows.where(draw < F.col("size") * rate).select("_key", weight.alias("w")).groupBy("_key").agg(F.sum("w").alias("w"))
    sample = np.array(sorted(map(tuple, drawn.collect())), dtype=[("k", "i8"), ("w", "f8")])
    upto = np.cumsum(sample["w"])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges)) if n else np.array([], "i8")
    splitters = np.unique(sample["k"][at])

    @F.pandas_udf("int")
    def range_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(splitters, k.to_numpy(), side="left").astype("i4"))

    rows = scratch(rows.withColumn("_range", range_of("_key")), "ranges")
    stats = {r: (b, c) for r, b, c in rows.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
    mean = total / max(1, len(stats))
    overfull = [r for r, (b, _) in stats.items() if b > 2 * mean]
    heavy = rows.where(F.col("_range").isin(overfull)).groupBy("_range", "_key").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    heavy = heavy.where(F.col("b") > mean / 2).collect() if overfull else []  # at most two for each mean range
    # by range and key (None: all others of the range): parts and bytes
    units = {(r, None): [1, b] for r, (b, _) in stats.items()}
    for r, key, b, c in heavy:
        units[r, None][1] -= b
        units[r, key] = [int(min(c, -(-b // mean))), b]
    load, home = [0.0] * shards, {}
    together = {u: b <= total / shards / 2 for u, (_, b) in units.items()}
    for u, (parts, b) in sorted(units.items(), key=lambda x: (-x[1][1] / (1 if together[x[0]] else x[1][0]), x[0][0], x[0][1] or 0)):
        for part in range(parts):
            # parts of a text that fits half a shard stay in one; they are apart only as tasks
            s = home[(*u, 0)] if part and together[u] else min(range(shards), key=lambda i: (load[i], i))
            load[s] += b / parts
            home[(*u, part)] = s
    whole = spark.createDataFrame([(r, s) for (r, key, _), s in home.items() if key is None] or [(-1, 0)], "_range int, _whole int")
    own = spark.createDataFrame([(key, units[r, key][0], p, s) for (r, key, p), s in home.items() if key is not None], "_key long, _parts int, _part int, _own int")
    # hot keys are few, at most two for each range, so all three tables are of bounded size
    parts = own.select("_key", "_parts").distinct()
    rows = rows.join(F.broadcast(parts), "_key", "left").withColumn(
        "_part", F.when(F.col("_parts").isNotNull(), F.pmod("_row", F.col("_parts"))).cast("int")
    )
    rows = rows.join(F.broadcast(own.drop("_parts")), ["_key", "_part"], "left").join(F.broadcast(whole), "_range")
    rows = rows.withColumn("shard", F.coalesce("_own", "_whole"))
    rows = rows.withColumn("_unit", F.when(F.col("_own").isNull(), F.lit(-1).cast("long")).otherwise(F.col("_key")))
    unit = ["shard", "_range", "_unit", F.coalesce("_part", F.lit(-1)).alias("_p")]
    rows = scratch(rows.select("_id", "size", "text_crc32", "_row", *unit), "shards")
    names = ["shard", "_range", "_unit", "_p"]
    counts = rows.groupBy(*names).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*names[1:]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*names, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*names).orderBy("_row", "_id")
    out = rows.withColumn("_at", F.row_number().over(inside) - 1).join(counts, names)
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
