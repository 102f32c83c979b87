"""Sessions with the settings that results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
#: Spark 4.1 joins the sides of a union partition by partition where both are dealt by one key. Adaptive reading may have
#: merged their partitions differently; rows of a key then lie in several partitions and windows over it go wrong.
UNION = "spark.sql.unionOutputPartitioning"


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, by name, with no partitioning taken over from either."""
    a.sparkSession.conf.set(UNION, "false")
    return a.unionByName(b)


def session(name: str = "ruleloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset and Spark runs in one process, a new temporary folder serves.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top}/ruleloom-{name}-{uuid.uuid4().hex}"


#: What written() wrote, by session.
_WRITTEN: dict[str, list[str]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to a new path. Steps that several others read are written once: that cuts their lineage and
    outlives lost executors. The table stays until drop_written() or the cluster clears its folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.setdefault(_session(df.sparkSession), []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that written() wrote in this session, and gives their number; what still reads them fails."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _WRITTEN.pop(_session(spark), [])]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in paths)
