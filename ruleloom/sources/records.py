"""Metadata records, recorded model answers and feedback, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import vocabulary as V
from ruleloom.session import united, written

RAW_META = (
    "document_number string, docket_ids array<string>, agencies array<struct<raw_name:string,name:string>>, title string, "
    "publication_date string, type string, action string, page_length int, html_url string, full_text_xml_url string, "
    "abstract string, comments_close_on string, effective_on string, dates string, cfr_references array<struct<title:int,part:string>>"
)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """JSON records; rows that aren't valid come with nulls."""
    return meta(spark.read.schema(RAW_META).json(path))


def meta(raw: DataFrame) -> DataFrame:
    """Typed metadata of raw records."""
    names = F.filter(F.transform("agencies", lambda a: F.coalesce(a["name"], a["raw_name"])), lambda x: x.isNotNull() & (x != ""))
    first = F.get("agencies", F.lit(0))
    whole = F.filter("cfr_references", lambda r: r["title"].isNotNull() & r["part"].isNotNull())
    status = D.document_status(F.col("action"), F.col("type"))
    return raw.select(
        F.col("document_number").alias("doc_id"),
        F.coalesce("docket_ids", F.array().cast("array<string>")).alias("docket_ids"),
        F.coalesce(first["raw_name"], first["name"], F.lit("")).alias("agency"),
        F.coalesce(names, F.array().cast("array<string>")).alias("agencies"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.try_to_date("publication_date").alias("publication_date"),
        "type",
        F.coalesce("action", F.lit("")).alias("action"),
        status.alias("status"),
        "page_length",
        "html_url",
        F.col("full_text_xml_url").alias("xml_url"),
        "abstract",
        F.try_to_date("comments_close_on").alias("comments_close_on"),
        F.try_to_date("effective_on").alias("effective_on"),
        F.col("dates").alias("dates_note"),
        F.coalesce(F.transform(whole, lambda r: F.concat(r["title"].cast("string"), F.lit(" CFR Part "), r["part"])), F.array().cast("array<string>")).alias("cfr_references"),
    )


def docket(documents: DataFrame, docket_id: str) -> DataFrame:
    """All versions of a proceeding, the oldest first."""
    return documents.where(F.array_contains("docket_ids", docket_id)).orderBy("publication_date", "doc_id")


def substantive(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("type").isin("Rule", "Proposed Rule"))


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that a stored table doesn't have yet: what a read-through cache would fetch."""
    return wanted.join(stored.select(key), key, "left_anti")


def _generations(spark: SparkSession, own: str) -> list[int]:
    """The finished writes to a version of a store: those with Spark's mark of success."""
    top = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.removeprefix("gen=")) for n in names if n.startswith("gen=") and fs.exists(path(f"{own}/{n}/_SUCCESS")))


def read_through(wanted: DataFrame, store: str, version: int, shape: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, record, fetched for the keys of wanted (key string, one row each) that the store has or fetch gives.

    A store keeps JSON values by version, so records of another shape than this version's are never read. A value that
    isn't a JSON object is corrupt; its key is fetched again, like those that the store lacks. fetch gets only these
    keys, as rows, and gives key and value. What it gives is added as one more generation, which readers see when it is
    complete and take before earlier ones; a failed write leaves the store as it was.
    """
    spark, own = wanted.sparkSession, f"{store}/v{version}"
    done = _generations(spark, own)
    held = spark.createDataFrame([], "key string, value string, gen int")
    if done:
        held = spark.read.option("basePath", own).schema("key string, value string, gen int").parquet(*[f"{own}/gen={g}" for g in done])
    last = held.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by("value", "gen").alias("value"))
    good = last.where(F.json_object_keys("value").isNotNull())
    new = written(fetch(wanted.select("key").join(good.select("key"), "key", "left_anti")).select("key", "value"), "fetched")
    if not new.isEmpty():
        new.write.parquet(f"{own}/gen={max(done, default=-1) + 1}")
    both = united(good.withColumn("fetched", F.lit(False)), new.withColumn("fetched", F.lit(True)))
    return both.select("key", F.from_json("value", shape).alias("record"), "fetched")


def drift(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, expected, actual of every difference; a row that one side lacks differs in every field."""
    e = expected.select(F.col(key), F.lit(True).alias("_e"), *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    a = actual.select(F.col(key), F.lit(True).alias("_a"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"a_{f}").alias("actual")) for f in fields]))
    lone = F.col("_e").isNull() | F.col("_a").isNull()
    met = e.join(a, key, "full").select(key, lone.alias("lone"), rows.alias("d")).select(key, "lone", "d.*")
    return met.where(F.col("lone") | ~F.col("expected").eqNullSafe(F.col("actual"))).drop("lone")


def safe_name(key: Column) -> Column:
    """A file name for a key: safe characters, 80 at most, and eight digits of its SHA-1."""
    return F.concat(F.substring(F.regexp_replace(key, "[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("."), F.substring(F.sha1(key), 1, 8))


def request_key(request: Column) -> Column:
    """The first 24 digits of the SHA-256 of a request's JSON."""
    return F.substring(F.sha2(F.to_json(request), 256), 1, 24)


def answered(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests with their recorded answers; one without has the error provider-error."""
    met = requests.join(recorded.select("key", F.col("answer")), "key", "left")
    return met.withColumn("error", F.when(F.col("answer").isNull(), "provider-error"))


FEEDBACK = "id string, frDocNumber string, cardId string, verdict string, note string, createdAt timestamp"


def add_feedback(rows: DataFrame, path: str) -> DataFrame:
    """Appends valid rows to the log and gives back the others with their error."""
    bad = F.when(F.coalesce(F.col("frDocNumber"), F.lit("")) == "", "frDocNumber is missing").when(
        F.coalesce(F.col("cardId"), F.lit("")) == "", "cardId is missing"
    )
    bad = bad.when(~F.coalesce(F.col("verdict").isin(*V.VERDICTS), F.lit(False)), "verdict is unknown").when(F.length("note") > 2000, "note is too long")
    checked = rows.withColumn("error", bad)
    good = checked.where("error is null").drop("error")
    good = good.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("createdAt", F.coalesce("createdAt", F.current_timestamp()))
    good.write.mode("append").json(path)
    return checked.where("error is not null")


def read_feedback(spark: SparkSession, path: str, doc: str | None = None) -> DataFrame:
    log = spark.read.schema(FEEDBACK).json(path)
    return log.where(F.col("frDocNumber") == doc) if doc else log
