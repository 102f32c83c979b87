"""What the operators of this subpackage share: input checks and shared scratch tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the token definition used here: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes that go to Python in one Arrow batch, at most but for one row that is larger.
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, as one batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs in one process, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Tables that scratch() wrote in this process.
_WRITTEN: list[str] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    The written table cuts the lineage, outlives lost executors and gives later steps column pruning and true
    sizes. It lies under spark.checkpoint.dir until drop_scratch() or the cluster clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ruleloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows that one file of a written table takes, where their number is bounded beforehand.
FILE_ROWS = 1 << 16


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df with a partition for each FILE_ROWS rows, or for each core, instead of those that the session deals; never more.

    rows bounds the rows that df's last step takes; callers count wide ones several times. A file costs more than the rows
    of a small table do: in a local folder, without Hadoop's native library, processes are started for it.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that scratch() wrote in this process, and gives their number.

    For callers that have written or collected their results: what still reads such a table fails afterwards.
    """
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _WRITTEN]
    _WRITTEN.clear()
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in paths)


def local_table(spark: SparkSession, rows: Sequence[Sequence], fields: dict[str, pa.DataType]) -> DataFrame:
    """A small table of rows that the driver has. As Arrow it starts no Python worker; a list of rows would, with a daemon of its own on each executor."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields.items(), columns, strict=True)}))


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def power_of_two(n: float, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, math.ceil(math.log2(max(n, 1)))))))


#: A side of a join is broadcast only if its counted rows take no more.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks df for broadcast if its rows, counted here, fit BROADCAST_BYTES; else Spark shuffles both sides.

    df should be a written table, as it is counted and then read again.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Rows with arrays or binaries, whose bytes are added up, are broadcast up to so many: the driver holds them several times.
WIDE_BYTES = 8 << 20


def broadcast_if_narrow(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Marks df, a written table, for broadcast if its rows' bytes, added up here, fit WIDE_BYTES."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= WIDE_BYTES else df


#: A key of more rows is hot, unless a larger bound is needed to keep hot keys few.
HOT = 10_000


def join_one(df: DataFrame, keyed: DataFrame, key: str, count: str, row_bytes: int, broadcast: int | None = None) -> DataFrame:
    """df with the row of keyed for its key (inner); keyed, a written table, has one row a key and its rows in df.

    A small table is broadcast whole. Else hot keys are: as their rows add up to df's at most, so many rows of keyed
    hold them that they fit the bound, BROADCAST_BYTES unless broadcast states another. Their rows in df stay where they
    are and no task gets a hot key's rows.
    """
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    broadcast = broadcast or BROADCAST_BYTES
    if n * row_bytes <= broadcast:
        return df.join(F.broadcast(keyed), key)
    most = max(HOT, total * row_bytes // broadcast)
    hot = keyed.where(F.col(count) > most)
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) <= most), key)
    return df.join(F.broadcast(hot), key).unionByName(rest)
