"""Queries of what comes in and goes out: streams that are stopped and go on, a store that is read through, reports and
source windows, each with the SQL that says what they give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import vocabulary as V
from ruleloom.operators import citations as C
from ruleloom.operators import determinations as G
from ruleloom.operators import model as M
from ruleloom.operators import redline as E
from ruleloom.operators import structure as S
from ruleloom.plans.corpus import analysis, read
from ruleloom.plans.corpus_queries import ENTRIES
from ruleloom.plans.table_queries import ORACLE_SQL as TABLE_SQL
from ruleloom.plans.table_queries import WS
from ruleloom.session import new_path
from ruleloom.sources import records, sinks
from ruleloom.streaming import stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _halves(df: DataFrame, key: str) -> list[DataFrame]:
    """What arrives before a stop, and after it, in no order."""
    return [df.where(F.pmod(F.xxhash64(key), F.lit(2)) == half).repartition(3) for half in (0, 1)]


@query(TABLE_SQL["stage_latest"])
def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each key, kept by a stream that is stopped halfway and goes on from its checkpoint; later
    arrivals may be older."""
    events, by = read(spark, sf_dir, "events"), ["user_id", "event_type"]
    source, out, checkpoint = (new_path(spark, n) for n in ("events", "latest", "progress"))
    for half in _halves(events, "event_id"):
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        stages.follow_latest(stream, by, F.struct("ts", "event_id"), "value", out, checkpoint).awaitTermination()
    return stages.current(spark, out, by).select(*by, "value", "n")


@query(
    rf"""WITH s AS (SELECT len(string_split(regexp_replace(coalesce(text, ''), '([.;:])[{WS}]+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentences,
      len(list_filter(string_split_regex(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '')) AS words FROM documents)
    SELECT unnest(['read', 'sentences', 'words']) AS stage, unnest([count(*), sum(sentences), sum(words)])::BIGINT AS total FROM s"""
)
def ingested_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events of documents that arrive in two parts, the second after a restart: each document counts once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source, out, checkpoint = (new_path(spark, n) for n in ("arrivals", "ingested", "progress"))

    def run(batch: DataFrame) -> dict[str, DataFrame]:
        words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")
        return {"sentences": batch.select("doc_id", F.explode(D.sentences(F.col("text")))), "words": batch.select("doc_id", F.explode(words))}

    for half in _halves(docs, "doc_id"):
        half.write.mode("append").parquet(source)
        stages.ingest(spark, source, "doc_id long, text string", run, out, checkpoint).awaitTermination()
    said = F.from_json("value", "stage string, detail string, done boolean")
    return spark.read.text(f"{out}/events").select(said.alias("e")).where("e.done").groupBy(F.col("e.stage").alias("stage")).agg(F.sum(F.col("e.detail").cast("long")).alias("total"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN c_name ELSE 'held ' || c_name END AS name, c_nationkey AS nation,
    c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS first_fetched, false AS second_fetched FROM customer"""
)
def read_through_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by way of a store that has an older version of all, and of its own version some, a few of them cut off: what
    it lacks is fetched once and then held."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_name", "c_nationkey")
    store = new_path(spark, "store")
    value = F.to_json(F.struct(F.concat(F.lit("held "), "c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    c.select("key", F.lit('{"title": "of an older shape"}').alias("value")).write.parquet(f"{store}/v1/gen=0")
    held = F.when(F.col("c_custkey") % 5 == 0, F.substring(value, 1, 12)).otherwise(value)
    c.where("c_custkey % 3 <> 0").select("key", held.alias("value")).write.parquet(f"{store}/v2/gen=0")

    def fetch(keys: DataFrame) -> DataFrame:
        return keys.join(c, "key").select("key", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("value"))

    first, second = (records.read_through(c.select("key"), store, 2, "name string, nation long", fetch) for _ in range(2))
    met = first.select("key", F.col("fetched").alias("first_fetched")).join(second, "key")
    return met.select(F.col("key").cast("long").alias("c_custkey"), "record.name", "record.nation", "first_fetched", F.col("fetched").alias("second_fetched"))


_BAR = " || ".join(
    f"""CASE WHEN {m} > 0 THEN '<i class="{m}" style="flex:' || {m} || '" title="{V.LABELS["materiality"][m]}: ' || {m} || ' (' || format('{{:.1f}}', 100 * {m} / revisions) || '%)"></i>' ELSE '' END"""
    for m in V.MATERIALITIES
)
_PRIORITY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LABELS["priority"].items())


@query(
    f"""WITH {ENTRIES}, f AS (SELECT doc_id, count(*) AS revisions, {", ".join(f"count(*) FILTER (materiality = '{m}') AS {m}" for m in V.MATERIALITIES)} FROM judged GROUP BY doc_id),
    p AS (SELECT *, list_position(['deadline', 'money', 'threshold', 'obligation', 'definition', 'other'], category) AS rank,
      row_number() OVER (PARTITION BY doc_id, category ORDER BY list_position(['material', 'needs-review', 'clarifying'], priority), revisions DESC, build_seq) AS nth, count(*) OVER (PARTITION BY doc_id, category) AS n FROM entries),
    c AS (SELECT doc_id, rank, '<h2>' || upper(category[1:1]) || category[2:] || ' (' || n || ')</h2><ul>' || string_agg('<li>' || provision || ': ' || CASE priority {_PRIORITY} END || ', ' || revisions || ' revisions</li>', '' ORDER BY nth)
      FILTER (nth <= {sinks.PER_CATEGORY}) || '</ul>' || CASE WHEN n > {sinks.PER_CATEGORY} THEN '<p>' || (n - {sinks.PER_CATEGORY}) || ' more</p>' ELSE '' END AS html FROM p GROUP BY doc_id, rank, category, n),
    h AS (SELECT doc_id, string_agg(html, '' ORDER BY rank) AS changed FROM c GROUP BY doc_id),
    e AS (SELECT doc_id, string_agg('<li>' || CASE kind WHEN 2 THEN '<del>Customer</del> <ins>customer</ins>' WHEN 3 THEN '<del>in a</del> <ins>in the</ins>' WHEN 4 THEN '<del>section 3.1</del> <ins>section 3.2</ins>' ELSE '<ins>see</ins>' END
      || ' ' || rule_id || '</li>', '' ORDER BY place) AS listed FROM judged WHERE materiality = 'editorial' GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS entries FROM entries GROUP BY doc_id)
    SELECT o_orderkey AS doc_id, '<b>' || coalesce(entries, 0) || '</b> provisions changed; <b>' || (o_orderpriority = '1-URGENT')::INT || '</b> determinations; <b>' || coalesce(material + undecided, 0)
      || '</b> revisions to review; <b>100.0%</b> citations verified; ' AS stats, CASE WHEN f.doc_id IS NULL THEN '<p>No marked-up edits.</p>' ELSE '<div class="bar">' || {_BAR} || '</div>' END AS bar,
      coalesce(changed, '<p>No provision changed.</p>') AS provisions, coalesce(listed, '') AS editorial
    FROM orders LEFT JOIN f ON f.doc_id = o_orderkey LEFT JOIN h ON h.doc_id = o_orderkey LEFT JOIN e ON e.doc_id = o_orderkey LEFT JOIN n ON n.doc_id = o_orderkey"""
)
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' reports: figures, the bar of materialities, provisions by category, editorial revisions."""
    return sinks.report_parts(analysis(spark, sf_dir)).select("doc_id", "stats", "bar", "provisions", "editorial")


_WORDS = f"trim(regexp_replace(coalesce(text, ''), '[{WS}]+', ' ', 'g'))"


@query(
    f"""WITH p AS (SELECT lang, doc_id, quality::VARCHAR AS rule_label, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 <> 0 THEN (1 - quality)::VARCHAR ELSE quality::VARCHAR END AS model_label, {_WORDS} AS t
      FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM p WHERE rule_label <> model_label)
    SELECT lang, place::INT AS place, 'r' || doc_id % 3 AS rule_id, rule_label, model_label, t[1:{M.EXAMPLE_CHARS}] AS before, trim('> ' || t)[1:{M.EXAMPLE_CHARS}] AS after FROM r WHERE place <= {M.EXAMPLES}"""
)
def agreement_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of each language on which rule and model differ, with their texts clipped."""
    own = F.col("quality").cast("string")
    said = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 4 != 0, (1 - F.col("quality")).cast("string")).otherwise(own)
    t = F.coalesce("text", F.lit(""))
    pairs = read(spark, sf_dir, "labels").select("doc_id", own.alias("rule_label"), said.alias("model_label")).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    pairs = pairs.select("lang", "doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("rule_id"), "rule_label", "model_label", t.alias("before"), F.concat(F.lit("> "), t).alias("after"))
    found = M.disagreements(pairs, "lang", "doc_id").select("lang", F.posexplode("examples").alias("k", "x"))
    return found.select("lang", (F.col("k") + 1).alias("place"), "x.*")


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, length(coalesce(text, '')) // 3 AS s, doc_id % 7 AS k FROM documents),
    q AS (SELECT *, CASE k WHEN 0 THEN -1 ELSE s END AS start, CASE k WHEN 1 THEN s WHEN 2 THEN s + {sinks.WINDOW_CHARS} + 1 WHEN 3 THEN n + 1 ELSE least(n, s + 100) END AS "end" FROM d),
    e AS (SELECT *, CASE WHEN start < 0 OR "end" <= start THEN 'end must lie after start' WHEN "end" - start > {sinks.WINDOW_CHARS} THEN 'the span is too long' WHEN k = 4 OR "end" > n THEN 'out of bounds' END AS error,
      greatest(0, start - {sinks.PAD}) AS a, least(n, "end" + {sinks.PAD}) AS b FROM q),
    c AS (SELECT doc_id, start, "end", error, list_filter([('unchanged', text[a + 1:least(b, s + 10)]), ('deletion', text[s + 11:least(b, s + 20)]), ('unchanged', text[s + 21:least(b, s + 50)]),
      ('addition', text[s + 51:least(b, s + 60)]), ('unchanged', text[s + 61:b])], lambda x: x[2] <> '') AS parts FROM e)
    SELECT doc_id, start::INT AS start, "end"::INT AS "end", error, CASE WHEN error IS NULL THEN md5(array_to_string(list_transform(parts, lambda x: x[1] || ':' || x[2]), '|')) END AS shown FROM c"""
)
def source_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source around spans of all documents, cut at edits, and the errors of bad requests; some ask for a document that
    isn't there."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, n = F.col("doc_id") % 7, F.length("text")
    s = F.floor(n / 3).cast("int")
    edits = F.explode(F.array(*[F.struct((s + a).alias("span_start"), (s + b).alias("span_end"), F.lit(kind).alias("kind")) for a, b, kind in ((10, 20, "deletion"), (50, 60, "addition"))]))
    end = F.when(k == 1, s).when(k == 2, s + sinks.WINDOW_CHARS + 1).when(k == 3, n + 1).otherwise(F.least(n, s + 100))
    absent = F.when(k == 4, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    asked = d.select(absent.alias("doc_id"), F.when(k == 0, -1).otherwise(s).alias("start"), end.alias("end"))
    out = sinks.source_windows(d, d.select("doc_id", edits.alias("e")).select("doc_id", "e.*"), asked)
    shown = F.md5(F.array_join(F.transform("segments", lambda x: F.concat_ws(":", x["kind"], x["segment"])), "|"))
    back = F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    return out.select(back.alias("doc_id"), "start", "end", "error", shown.alias("shown"))


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'fits' WHEN o_orderkey % 5 IN (2, 3) THEN 'no redline convention is registered for this agency' ELSE 'no legend declares the mark-up' END AS reason
    FROM orders WHERE o_orderkey % 4 IN (0, 1)"""
)
def substantive_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents of all types the substantive ones, with why they have no edits: an agency without conventions, known by
    any of its names, or no legend."""
    k = F.col("o_orderkey")
    kinds = F.get(F.array(*map(F.lit, ("Rule", "Proposed Rule", "Notice", None))), (k % 4).cast("int"))
    agency = F.when(k % 5 == 2, "ENVIRONMENTAL PROTECTION AGENCY").when(k % 5 == 3, "").otherwise("DEPARTMENT OF ENERGY")
    names = F.when(k % 5 == 3, F.array().cast("array<string>")).when(k % 5 == 2, F.array(F.lit("Agency"))).otherwise(F.array(F.lit("Energy"), F.lit("Federal energy regulatory commission")))
    meta = read(spark, sf_dir, "orders").select(k.alias("doc_id"), kinds.alias("type"), agency.alias("agency"), names.alias("agencies"))
    docs = S.with_convention(records.substantive(meta))
    regions = docs.where(F.col("doc_id") % 5 < 2).select("doc_id")
    return E.extraction_reason(docs, regions).select("doc_id", F.coalesce("reason", F.lit("fits")).alias("reason"))


_DUE = (("1 day", 1, "days", "unstated"), ("90 days from publication", 90, "days", "publication"), ("1 year from effective", 1, "years", "effective"), ("18 months", 18, "months", "unstated"))


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, CASE doc_id % 4 {" ".join(f"WHEN {i} THEN '{x[0]}'" for i, x in enumerate(_DUE))} END AS due, md5(CASE WHEN length(text) > 80 THEN text[1:80] || '…' ELSE text END) AS shown FROM d"""
)
def clipped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is shown: quotes clipped to their first characters, periods in words."""
    k = (F.col("doc_id") % 4).cast("int")
    count, unit, anchor = (F.get(F.array(*[F.lit(x[i]) for x in _DUE]), k) for i in (1, 2, 3))
    shown = F.md5(C.clipped(F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "documents").select("doc_id", G.described(count, unit, anchor).alias("due"), shown.alias("shown"))
