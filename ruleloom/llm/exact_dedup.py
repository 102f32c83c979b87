"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 sets two cells of a bit table for each row's digest and keeps the cells that were set at least twice.
Pass 2 probes that filter: a row of which a cell was set only once has no equal row and passes straight through;
only the others shuffle and are grouped by the full SHA-256 digest, so false positives cost time and change nothing.
The filter has BITS_PER_ROW bits a row at any size. Up to BROADCAST_BYTES it is broadcast; a larger one stays in
buckets, and the rows meet these by a shuffled join.

Texts are equal when identical after each run of white space is replaced by one space; null counts as empty.
Of equal texts the row with the smallest id stays (null ids last); of rows that also agree in their id, exactly one.
An empty table gives an empty result. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import SPACES, broadcast_if_small, join_one, power_of_two, scratch, text_or_empty

BITS_PER_ROW = 16
#: No table has so many rows that this binds; beyond it the filter would fill up, and more rows shuffle.
MAX_BITS = 1 << 50
#: Of one bucket's bitmap and its number.
BUCKET_BYTES = 4200


def _normal(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def _digest(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value, F.lit(seed)).alias(f"_h{seed}") for seed in (0, 1)]


def _cell(seed: int, bits: int) -> Column:
    """The cell of a row's hash, from 1 on, as bitmap_bucket_number() counts from 1."""
    return F.pmod(F.col(f"_h{seed}"), F.lit(bits)) + 1


def _set(bitmap: Column, cell: Column) -> Column:
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass 1: (bucket, bitmap) of the cells that at least two rows set, as a written table."""
    cells = hashes.select(F.explode(F.array(_cell(0, bits), _cell(1, bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2")
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap")
    return scratch(twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(bitmap), "filter")


def _probe(rows: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds _maybe, false where the row can't have an equal one."""
    small, maybe = broadcast_if_small(table, BUCKET_BYTES), F.lit(True)
    for k in (0, 1):
        side = small.select(F.col("bucket").alias(f"_b{k}"), F.col("bitmap").alias(f"_m{k}"))
        rows = rows.join(side, F.bitmap_bucket_number(_cell(k, bits)) == F.col(f"_b{k}"), "left")
        maybe = maybe & _set(F.col(f"_m{k}"), _cell(k, bits))
    return rows.withColumn("_maybe", maybe).drop("_b0", "_m0", "_b1", "_m1", "_h0", "_h1")


def _bits(rows: DataFrame) -> int:
    return power_of_two(BITS_PER_ROW * rows.count(), 1 << 15, MAX_BITS)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col).alias("_id"), _digest(_normal(text_col)).alias("_sha"))
    rows = scratch(rows.select("_id", "_sha", *_hashes(F.col("_sha"))), "digests")
    bits = _bits(rows)
    probed = _probe(rows, repeated_filter(rows, bits), bits)
    alone = probed.where(~F.col("_maybe")).select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # rows that agree in digest and id come as one row with their number, then groups over these
    same = scratch(probed.where("_maybe").groupBy("_sha", "_id").agg(F.count("*").alias("_n")), "maybe")
    groups = same.groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_ids"))
    met = join_one(same, scratch(groups, "groups"), "_sha", "_ids", 80).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    met = met.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_row") == 1))
    out = alone.unionByName(met.select(alone.columns))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they were. Rows without an equal one never shuffle.

    Of the others each task first keeps one row a digest, so a group of copies, however large, shuffles as one row a
    task. Of rows that agree in id as well, the one with the least hash of its own text stays.
    """
    hashes = scratch(df.select(*_hashes(_normal(text_col))), "hashes")
    bits = _bits(hashes)
    whole = df.select(F.struct("*").alias("_whole"), _normal(text_col).alias("_normal"))
    probed = _probe(whole.select("_whole", "_normal", *_hashes(F.col("_normal"))), repeated_filter(hashes, bits), bits)
    own = F.col("_whole")
    order = F.struct(own[id_col].isNull(), own[id_col], F.xxhash64(own[text_col]))
    one = probed.where("_maybe").groupBy(_digest(F.col("_normal")).alias("_sha")).agg(F.min_by("_whole", order).alias("_whole"))
    return probed.where(~F.col("_maybe")).select("_whole.*").unionByName(one.select("_whole.*"))
