"""Incremental runs: new documents as a stream of files, stage events, and the latest event of each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(events: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    """The last value of each key and the number of its events; on a stream in update mode, the state is one row a key."""
    return events.groupBy(*by).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))


def stage_row(stage: str, detail: Column, done: bool = True) -> Column:
    return F.to_json(F.struct(F.lit(stage).alias("stage"), detail.cast("string").alias("detail"), F.lit(done).alias("done")))


def ingest(spark: SparkSession, path: str, schema: str, run: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the batch analysis on each batch of new documents and writes its tables and stage events.

    Documents don't depend on each other, so a batch needs no state. Tables are written by batch id and overwritten on a
    retry, so each document counts once.
    """

    def batch(docs: DataFrame, number: int) -> None:
        docs.persist()
        events = [docs.agg(stage_row("read", F.count("*")).alias("event"))]
        for name, table in run(docs).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            events.append(docs.sparkSession.read.parquet(f"{out}/{name}/batch={number}").agg(stage_row(name, F.count("*")).alias("event")))
        all_ = events[0]
        for e in events[1:]:
            all_ = all_.unionByName(e)
        all_.coalesce(1).write.mode("overwrite").text(f"{out}/events/batch={number}")
        docs.unpersist()

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_latest(events: DataFrame, by: list[str], order: Column, value: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest value of each key of a stream up to date: each batch writes the keys that changed.

    The state has one row a key, so it grows with the keys, not with the events. A batch's rows are written by its number
    and overwritten when it is run again after a failure, so each event counts once; the checkpoint says where to go on.
    """

    def batch(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = latest(events, by, order, value)
    return rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """What follow_latest() has kept: each key's row of its last batch."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*by, "r.*")
