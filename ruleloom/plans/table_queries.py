"""Queries of single operators over the given tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators import citations as C
from ruleloom.operators import determinations as G
from ruleloom.operators import model as M
from ruleloom.operators import rules as R
from ruleloom.operators import spans as P
from ruleloom.plans.corpus import read
from ruleloom.session import new_path, written
from ruleloom.sources import markup, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: ECMAScript's white space as an RE2 class.
WS = r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _text(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_text('text')}) AS digest, length({_text('text')}) AS n_chars FROM documents")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.collapse("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query(
    rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.;:])[{WS}]+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents)
    SELECT doc_id, CAST(len(parts) AS INT) AS sentences, CAST(list_max(list_transform(parts, lambda x: length(x))) AS INT) AS longest FROM s"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sentences(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '')) AS INT) AS words FROM documents")
def approx_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("words"))


@query(
    """WITH r AS (SELECT CAST(l_partkey % 9 + 1 AS VARCHAR) || '.' || l_linenumber AS a, CAST(l_suppkey * 37 % 300 AS VARCHAR) AS b FROM lineitem)
    SELECT a || ',' || b AS refs, CASE WHEN CAST(b AS INT) < 100 THEN a || ',' || b ELSE a END AS provision_refs, count(*) AS n FROM r GROUP BY ALL"""
)
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat((F.col("l_partkey") % 9 + 1).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    b = (F.col("l_suppkey") * 37 % 300).cast("string")
    text = F.concat(F.lit("See section "), a, F.lit(" and Section "), b, F.lit(". Later, section "), a, F.lit(" applies; subsection 5 and sections 6 don't."))
    refs = read(spark, sf_dir, "lineitem").select(D.cross_refs(text).alias("r"))
    own = F.array_join(F.filter("r", D.is_provision_ref), ",")
    return refs.groupBy(F.array_join("r", ",").alias("refs"), own.alias("provision_refs")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'R' THEN l_linenumber || '.1' WHEN 'A' THEN '' ELSE l_linenumber || '.2' END AS amended, count(*) AS n
    FROM lineitem GROUP BY ALL"""
)
def directive_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("We modify section "), n, F.lit(".1 of the rules. It stood in section 9.9.")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("We decline to adopt the proposal to add section "), n, F.lit(".3.")))
        .otherwise(F.concat(F.lit("The existing requirements in section 4.4 stand. Accordingly, the Commission revises section "), n, F.lit(".2.")))
    )
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus", F.array_join(D.directive_refs(text), ",").alias("amended")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS a, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS b FROM events),
    m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    i AS (SELECT *, sum(CASE WHEN a - before <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) - 1 AS island FROM m)
    SELECT user_id, CAST(island AS INT) AS island, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY ALL"""
)
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select("user_id", at.alias("a"), (at + F.floor(F.col("value") * 60)).alias("b"))
    return P.merge_spans(e, ["user_id"], "a", "b", 3600)


@query(
    """SELECT p.event_id, p.user_id, v.ts AS view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"))
    return P.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_ts", ["view_ts"]).drop("ts")


@query(
    """WITH t AS (SELECT unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS token FROM pages)
    SELECT lower(nullif(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1), '')) AS tag, token LIKE '</%' AS closing, count(*) AS n, CAST(sum(CASE WHEN token LIKE '<%' THEN 0 ELSE length(token) END) AS BIGINT) AS text_chars
    FROM t GROUP BY ALL"""
)
def markup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = markup.html_tokens(read(spark, sf_dir, "pages"), "page_id", "html")
    return t.groupBy("tag", "closing").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_tag"), 0).otherwise(F.length("token"))).alias("text_chars"))


@query(
    f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS token, generate_subscripts(regexp_extract_all(html, '<[^>]*>|[^<]+'), 1) AS seq FROM pages),
    n AS (SELECT *, lead(token) OVER (PARTITION BY page_id ORDER BY seq) AS following FROM t)
    SELECT page_id, CAST(seq - 1 AS INT) AS seq, CAST(substr(lower(token), 3, 1) AS INT) AS level, {_text("following")} AS title FROM n WHERE regexp_matches(token, '^<[hH][1-6][ >]')"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = markup.html_tokens(read(spark, sf_dir, "pages"), "page_id", "html")
    t = t.withColumn("following", F.lead("token").over(Window.partitionBy("page_id").orderBy("seq")))
    h = t.where(F.regexp_like("token", F.lit("^<[hH][1-6][ >]")))
    return h.select("page_id", "seq", F.substring("tag", 2, 1).cast("int").alias("level"), T.collapse("following").alias("title"))


@query(
    """SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS complete FROM conversations GROUP BY ALL"""
)
def paragraph_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.operators.structure import completeness

    p = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("number"), F.lit(False).alias("separate"))
    return completeness(p).withColumnRenamed("doc_id", "conv_id")


_ACTIONS = "CASE o_orderkey % 6 WHEN 0 THEN 'Order on rehearing and clarification.' WHEN 1 THEN 'Notice of proposed rulemaking.' WHEN 2 THEN 'Final rule.' WHEN 3 THEN 'Proposed rule; extension' WHEN 4 THEN 'Final Order' ELSE 'Correction.' END"
_TYPES = "CASE WHEN o_orderpriority = '5-LOW' THEN 'Notice' WHEN o_orderstatus = 'P' THEN 'Proposed Rule' ELSE 'Rule' END"


@query(
    f"""WITH d AS (SELECT {_ACTIONS} AS action, {_TYPES} AS type, o_orderkey % 6 AS k FROM orders)
    SELECT action, type, CASE WHEN type = 'Notice' THEN 'notice' WHEN k = 0 THEN 'amended' WHEN k IN (1, 3) THEN 'proposed' WHEN k IN (2, 4) THEN 'final'
      WHEN type = 'Proposed Rule' THEN 'proposed' ELSE 'final' END AS status, count(*) AS n FROM d GROUP BY ALL"""
)
def status_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").selectExpr(f"{_ACTIONS} AS action", f"{_TYPES} AS type")
    return d.groupBy("action", "type", D.document_status(F.col("action"), F.col("type")).alias("status")).agg(F.count("*").alias("n"))


_DISPOSITION = "CASE l_linenumber % 7 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'sustained' WHEN 2 THEN 'clarified' WHEN 3 THEN 'modified' WHEN 4 THEN 'set-aside' WHEN 5 THEN 'unclassified' END"
_STATUS = "CASE l_returnflag WHEN 'R' THEN 'amended' WHEN 'A' THEN 'final' ELSE CASE WHEN l_linestatus = 'O' THEN 'proposed' ELSE 'notice' END END"


@query(
    f"""WITH p AS (SELECT {_STATUS} AS status, {_DISPOSITION} AS disposition, l_quantity > 25 AS changed FROM lineitem)
    SELECT status, disposition, changed, CASE WHEN disposition = 'unclassified' OR status = 'notice' THEN 'unknown' WHEN status = 'proposed' THEN 'proposed'
      WHEN status = 'final' THEN 'adopted' WHEN disposition IS NULL THEN CASE WHEN changed THEN 'adopted' ELSE 'unknown' END
      WHEN disposition IN ('affirmed', 'sustained', 'clarified') THEN 'settled' WHEN disposition = 'modified' THEN 'adopted' ELSE 'reopened' END AS provision_status,
      count(*) AS n FROM p GROUP BY ALL"""
)
def provision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "lineitem").selectExpr(f"{_STATUS} AS status", f"{_DISPOSITION} AS disposition", "l_quantity > 25 AS changed")
    s = D.provision_status(F.col("status"), F.col("disposition"), F.col("changed"))
    return p.groupBy("status", "disposition", "changed", s.alias("provision_status")).agg(F.count("*").alias("n"))


_CONFIDENCE = "c_custkey % 2 = 0 AS by_rule, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS agree, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 10000 END AS said, c_nationkey = 7 AS foreign_label"


@query(
    f"""WITH c AS (SELECT c_custkey, {_CONFIDENCE} FROM customer)
    SELECT c_custkey, CASE WHEN foreign_label OR agree = false THEN 'low' WHEN by_rule OR agree THEN 'high' WHEN said < 0.7 THEN 'low' ELSE 'medium' END AS level,
      CASE WHEN foreign_label OR agree = false THEN true WHEN by_rule OR agree THEN false WHEN said < 0.7 THEN true ELSE false END AS escalated FROM c"""
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey", *_CONFIDENCE.split(", "))
    level = D.confidence(F.col("by_rule"), F.col("agree"), F.col("said"), F.col("foreign_label"))
    return c.select("c_custkey", level.alias("c")).select("c_custkey", "c.level", "c.escalated")


# Changed texts with the category that the signal lists give them.
_CHANGES = (
    ("within ten (10) Business Days", "deadline"), ("a letter of credit", "money"), ("at least 5 units", "threshold"), ("Widget shall mean it", "definition"),
    ("must not ship", "obligation"), ("a new color", "other"), ("due date and $5", "deadline"), ("non-refundable", "money"), ("20 MW of load", "threshold"),
    ("it may not apply", "obligation"), ("the following day", "other"),
)


@query(
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'definition' ELSE CASE p_size % 11 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_CHANGES))
    + " END END AS category FROM part"
)
def categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.get(F.array(*[F.lit(t) for t, _ in _CHANGES]), F.col("p_size") % 11)
    title = F.when(F.col("p_type") == "PROMO", "Section 1. Definitions").otherwise(F.concat(F.lit("Section 2. "), F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", D.category(changed, title).alias("category"))


@query(
    """SELECT p_brand, p_partkey, CAST(place AS INT) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 4"""
)
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_per_group(read(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4).select("p_brand", "p_partkey", "place")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def leftover_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.missing(read(spark, sf_dir, "orders").select("o_orderkey"), returned, "o_orderkey")


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words FROM conversations),
    p AS (SELECT *, lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w)
    SELECT conv_id, turn, round(CASE WHEN least(len(words), len(before)) > 0 THEN len(list_intersect(words, before)) / least(len(words), len(before)) ELSE 0.0 END, 6) AS score
    FROM p WHERE before IS NOT NULL"""
)
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "conversations").withColumn("words", F.array_distinct(T.extract_all(F.lower("text"), "[a-z]{4,}")))
    w = w.withColumn("before", F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return w.select("conv_id", "turn", F.round(D.overlap(F.col("words"), F.col("before")), 6).alias("score"))


@query(
    f"""WITH l AS (SELECT doc_id * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT seq, {_text("line")} AS t FROM l)
    SELECT md5(lower(t)) AS key, arg_min(t, seq)[1:260] AS text, count(*) AS n, min(seq) AS first_seq FROM k WHERE t <> '' GROUP BY md5(lower(t)) HAVING count(*) > 1"""
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.select((F.col("doc_id") * 1000000 + F.col("k") + 1).alias("seq"), T.collapse("line").alias("t")).where("t <> ''")
    return P.collapse_repeats(lines, [], F.md5(F.lower("t")), "t", "seq").where("n > 1")


@query(
    """SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + CAST(o_orderkey % 40 AS INT)
      ELSE (date_trunc('month', o_orderdate) + to_months(CAST((o_orderkey % 40) * CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 12 END AS INT)) + to_days(CAST(day(o_orderdate) - 1 AS INT)))::DATE END) AS due_on FROM orders"""
)
def deadline_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(F.lit("days"), F.lit("months"), F.lit("years")), (F.col("o_orderkey") % 3).cast("int"))
    due = D.add_period(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"), unit)
    return read(spark, sf_dir, "orders").select("o_orderkey", due.alias("due_on"))


# Sentences with what they direct: count, unit and anchor, or nothing.
_FILINGS = (
    ("We require each utility to submit a compliance filing within ninety days of the effective date of this rule.", (90, "days", "effective")),
    ("The Commission directs a compliance filing within 12 months.", None),
    ("We will require a compliance filing within 2 years of publication date.", (2, "years", "publication")),
    ("Some suggest that we require a compliance filing within 60 days.", None),
    ("We direct a compliance filing within forty-five calendar days.", (45, "days", "unstated")),
    ("We require reports within 30 days.", None),
    ("We direct a compliance filing soon.", None),
)


@query(
    "WITH s AS (SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT "
    + ", ".join(
        "CASE k " + " ".join(f"WHEN {i} THEN {x[j]!r}" for i, (_, x) in enumerate(_FILINGS) if x) + f" END AS {name}" for j, name in enumerate(("count", "unit", "anchor"))
    )
    + f", n FROM s WHERE k IN ({', '.join(str(i) for i, (_, x) in enumerate(_FILINGS) if x)})"
)
def deadline_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Nothing here. "), F.get(F.array(*[F.lit(t) for t, _ in _FILINGS]), (F.col("o_orderkey") % 7).cast("int")), F.lit(" The end."))
    s = G.deadline_sentences(read(spark, sf_dir, "orders").select(text.alias("text")), "text")
    return s.groupBy("count", "unit", "anchor").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    fenced = F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone."))
    said = F.get(F.array(p, fenced, F.concat(F.lit("```\n"), p, F.lit("```")), F.concat(F.lit("The answer is "), p, F.lit(" as asked")), F.concat(F.lit("no answer "), F.lit("{"))), (F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(D.json_salvage(said), "$.k", "long").alias("k"))


@query(
    """WITH p AS (SELECT toxic, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS said, quality FROM labels)
    SELECT toxic, count(*) AS sampled, count(*) FILTER (said = quality) AS agreed, count(*) FILTER (said <> quality) AS disagreed, count(*) FILTER (said IS NULL) AS unanswered,
      round(count(*) FILTER (said = quality) / count(said), 6) AS rate FROM p GROUP BY ALL"""
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    p = read(spark, sf_dir, "labels").select("toxic", F.col("quality").alias("rule_label"), said.alias("model_label"))
    return M.agreement(p, "toxic").withColumn("rate", F.round("rate", 6))


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey FROM n WHERE i % greatest(1, n // 3) = 0 AND i // greatest(1, n // 3) < 3"""
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stride_sample(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query(
    """WITH w AS (SELECT doc_id, CASE WHEN length(text) < 200 THEN rpad(text, 200, '_') ELSE text END AS t, CAST(doc_id % 30 AS INT) AS d FROM documents),
    p AS (SELECT *, length(t) - 100 AS z FROM w)
    SELECT doc_id, 'unchanged:' || t[1:10 + d] || '|deletion:' || t[11 + d:20 + d] || '|addition:' || t[21 + d:30 + d] || '|unchanged:' || t[31 + d:z] || '|addition:' || t[z + 1:] AS shown FROM p"""
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as windows that start at 1000; spans: two that overlap, one inside what is shown, and one that leaves the window."""
    text = F.when(F.length("text") < 200, F.rpad("text", 200, "_")).otherwise(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.lit(1000).alias("window_start"))
    at, last = (F.col("doc_id") % 30).cast("int") + 1010, F.length("text") + 900
    s = [(at, at + 10, "deletion"), (at + 5, at + 20, "addition"), (at + 12, at + 15, "deletion"), (last, last + 400, "addition"), (F.lit(900), F.lit(1000), "deletion")]
    spans = d.select("doc_id", F.explode(F.array(*[F.struct(a.alias("span_start"), b.alias("span_end"), F.lit(k).alias("kind")) for a, b, k in s])).alias("s")).select("doc_id", "s.*")
    out = P.segments(d, spans, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "kind", "segment").alias("x")))).alias("all"))
    return out.select("doc_id", F.array_join(F.transform("all", lambda a: a["x"]), "|").alias("shown"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL")
def stage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.streaming.stages import latest

    return latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "value")


_SHIFT = "CASE WHEN doc_id % 11 = 0 THEN 100000000 ELSE 0 END"


@query(
    f"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) // 4 AS a, text FROM documents),
    q AS (SELECT *, text[a + 1:a + 40] AS quote FROM c),
    v AS (SELECT doc_id, CASE WHEN trim(regexp_replace(quote, '[{WS}]+', ' ', 'g')) = '' THEN 'empty-quote' WHEN doc_id % 11 = 0 THEN 'out-of-bounds'
      WHEN doc_id % 7 = 0 THEN 'quote-mismatch' WHEN doc_id % 13 = 0 THEN 'section-not-found' WHEN doc_id % 17 = 0 THEN 'outside-section' END AS reason FROM q)
    SELECT doc_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN 'exact' END AS match, reason FROM v"""
)
def verify_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims taken from the documents, some of them spoilt: another text, out of bounds, no section, another section."""
    return _verified(read(spark, sf_dir, "documents"))


def _verified(docs: DataFrame) -> DataFrame:
    a = F.floor(F.length("text") / 4).cast("int")
    quote = F.substring(F.col("text"), a + 1, F.lit(40))
    bad = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("#"), quote)).otherwise(quote)
    shift = F.expr(_SHIFT).cast("int")
    section = F.when(F.col("doc_id") % 13 == 0, "9").otherwise("1")
    claims = docs.select(
        "doc_id", section.alias("section_id"), F.when(T.is_blank(quote), quote).otherwise(bad).alias("quote"), (a + shift).alias("span_start"),
        (F.least(F.length("text"), a + 40) + shift).alias("span_end"),
    )
    start = F.when(F.col("doc_id") % 17 == 0, F.length("text")).otherwise(0)
    sections = docs.select("doc_id", F.lit("1").alias("section_id"), start.alias("span_start"), F.length("text").alias("span_end"))
    return C.verify(claims, docs.select("doc_id", "text"), sections).select("doc_id", "ok", "match", "reason")


@query(
    f"""WITH v AS (SELECT lang, NOT (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR
      trim(regexp_replace(text[length(text) // 4 + 1:length(text) // 4 + 40], '[{WS}]+', ' ', 'g')) = '') AS ok FROM documents)
    SELECT lang, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS suppressed, round(avg(ok::INT), 6) AS rate FROM v GROUP BY ALL"""
)
def gate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    v = _verified(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return C.gate(v, "lang").withColumn("rate", F.round("rate", 6))


@query(
    """WITH h AS (SELECT item_id, (length(d.text) - length(replace(d.text, trim(b.text), ''))) // length(trim(b.text)) AS n FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text)))
    SELECT item_id, count(*) FILTER (n = 1) AS found_in, count(*) FILTER (n > 1) AS ambiguous_in FROM h GROUP BY ALL"""
)
def locate_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which documents each benchmark passage is found, once or more often."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = C.contained(b, read(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")
    out = C.located(met, "text", "quote")
    return out.groupBy("item_id").agg(F.count_if(F.col("result") == "found").alias("found_in"), F.count_if(F.col("result") == "ambiguous").alias("ambiguous_in"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[\t-\r ]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM documents)
    SELECT doc_id, count(*) AS tokens, CAST(sum(length(token)) + count(*) - 1 AS BIGINT) AS normal_chars FROM w GROUP BY ALL"""
)
def normal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.normal_tokens(read(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.max(F.col("normal_at") + F.length("token")).cast("long").alias("normal_chars"))


# Inputs with what they name.
_INPUTS = (
    ("https://www.federalregister.gov/documents/2024/04/16/{n}/slug", "document", "{n}"), (" {n} ", "document", "{n}"), ("rm22-14-{k}", "docket", "RM22-14-{k}"),
    ("https://example.org/{n}", None, None), ("", None, None), ("http://federalregister.gov/full/{n}.xml", "document", "{n}"), ("https://federalregister.gov.example.org/{n}", None, None),
)


@query(
    "WITH i AS (SELECT c_custkey, CAST(2000 + c_custkey % 30 AS VARCHAR) || '-' || lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') AS n, CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT c_custkey, "
    + ", ".join(
        "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(("'" + (x[j] or "").replace("{n}", "' || n || '").replace("{k}", "' || k || '") + "'") if x[j] else "NULL" for x in _INPUTS)) + f" END AS {name}"
        for j, name in ((1, "kind"), (2, "value"))
    )
    + ", c_custkey % 7 IN (3, 4, 6) AS unsupported FROM i"
)
def resolve_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat((2000 + F.col("c_custkey") % 30).cast("string"), F.lit("-"), F.lpad((F.col("c_custkey") % 99999).cast("string"), 5, "0"))
    raw = F.get(F.array(*[F.replace(F.replace(F.lit(t), F.lit("{n}"), n), F.lit("{k}"), F.col("c_custkey").cast("string")) for t, _, _ in _INPUTS]), (F.col("c_custkey") % 7).cast("int"))
    r = read(spark, sf_dir, "customer").select("c_custkey", D.resolve_input(raw).alias("r"))
    return r.select("c_custkey", "r.kind", "r.value", F.col("r.error").isNotNull().alias("unsupported"))


@query(
    """SELECT c_custkey, f AS field, CASE f WHEN 'c_name' THEN c_name ELSE c_mktsegment END AS expected,
      CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN f = 'c_name' THEN c_name || '!' ELSE c_mktsegment END AS actual
    FROM customer, (SELECT unnest(['c_name', 'c_mktsegment']) AS f) WHERE c_custkey % 10 = 3 OR (c_custkey % 10 = 4 AND f = 'c_name')"""
)
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    name = F.when(F.col("c_custkey") % 10 == 4, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    return records.drift(c, c.where("c_custkey % 10 <> 3").withColumn("c_name", name), "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT url, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g')[1:80] || '.' || sha1(url)[1:8] AS name FROM pages")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("url", records.safe_name(F.col("url")).alias("name"))


@query(
    """SELECT conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn || '}')[1:24] AS key, CASE WHEN role = 'user' THEN 'provider-error' END AS error FROM conversations"""
)
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with recorded answers; those of users have none."""
    c = read(spark, sf_dir, "conversations").withColumn("key", records.request_key(F.struct("role", "turn")))
    recorded = c.where("role <> 'user'").groupBy("key").agg(F.min("text").alias("answer"))
    return records.answered(c.select("conv_id", "turn", "key"), recorded).select("conv_id", "turn", "key", "error")


@query(
    """WITH v AS (SELECT p_partkey, list_sort(list_distinct([CAST(p_size AS DOUBLE), CAST(p_partkey % 20 AS DOUBLE), 25.0, CAST(p_partkey % 5000 AS DOUBLE) + 0.5])) AS v FROM part)
    SELECT p_partkey, array_to_string(list_transform(v, lambda x: printf('%.1f', x)), ',') AS numbers FROM v"""
)
def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.get(F.array(*[F.lit(w) for w in V.ONES]), (F.col("p_partkey") % 20).cast("int"))
    amount = F.format_number(F.col("p_partkey") % 5000 + 0.5, 1)
    text = F.concat(F.lit("within "), words, F.lit(" ("), F.col("p_size").cast("string"), F.lit(" Business Days), twenty-five percent of $"), amount, F.lit("."))
    v = F.transform(R.numeric_values(text), lambda x: F.format_string("%.1f", x))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(v, ",").alias("numbers"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role = 'user' OR turn % 2 = 1 AS own, coalesce(text, '') AS text FROM conversations),
    e AS (SELECT conv_id, turn, lower({_text("text")}) AS edit, lower({_text("CASE WHEN own THEN ' ' || text[5:44] ELSE '§ nothing of the kind §' END")}) AS evidence FROM c)
    SELECT conv_id, turn, evidence <> '' AND (contains(edit, evidence) OR contains('short', evidence) OR (length(edit) >= 8 AND contains(evidence, edit))) AS grounded FROM e"""
)
def grounded_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is cut from the text (users, odd turns) or made up."""
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    own = (F.col("role") == "user") | (F.col("turn") % 2 == 1)
    evidence = F.when(own, F.concat(F.lit(" "), F.substring("text", 5, 40))).otherwise("§ nothing of the kind §")
    return c.select("conv_id", "turn", M.grounded(evidence, F.array("text", F.lit("short"))).alias("grounded"))


def _labels_sql(kind: str, key: str) -> str:
    return f"CASE {key} " + " ".join("WHEN '{}' THEN '{}'".format(*(x.replace("'", "''") for x in kv)) for kv in V.LABELS[kind].items()) + " END"


def _nth(kind: str) -> tuple[str, ...]:
    """A set's keys, and one that it lacks."""
    return (*V.LABELS[kind], "other")


@query(
    "WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, "
    + ", ".join(f"{_labels_sql(n, '[' + ', '.join(repr(x) for x in _nth(n)) + f'][CAST(k % {len(_nth(n))} AS INT) + 1]')} AS {n}" for n in V.LABELS)
    + ", CASE WHEN k % 3 = 0 THEN 'https://example.org/' || k ELSE 'https://www.federalregister.gov/d/' || k END AS url FROM o"
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see for keys of all sets, an unknown one among them, and the page of a document with and without a URL."""
    k = F.col("o_orderkey")
    keys = {n: F.get(F.array(*map(F.lit, _nth(n))), (k % len(_nth(n))).cast("int")) for n in V.LABELS}
    number = k.cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://example.org/"), number)).when(k % 3 == 1, "")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[D.label(n, c).alias(n) for n, c in keys.items()], D.official_url(url, number).alias("url"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer)
    SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN k % 3 = 0 THEN '' ELSE 'RM' || k || '-1,RM' || k || '-2' END AS dockets,
      CASE k % 4 WHEN 0 THEN upper(s) WHEN 1 THEN s WHEN 2 THEN upper(s) ELSE '' END AS agency,
      CASE k % 4 WHEN 0 THEN s || ';Second' WHEN 1 THEN s || ';Second' WHEN 2 THEN upper(s) || ';Second' ELSE '' END AS agencies,
      CASE WHEN k % 5 = 0 THEN '' ELSE n END AS title, CASE WHEN k % 7 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(k % 1000 AS INT) END AS publication_date,
      CASE WHEN k % 6 = 0 THEN 'notice' WHEN k % 6 = 1 THEN 'amended' WHEN k % 6 IN (2, 4) THEN 'proposed' ELSE 'final' END AS status,
      CASE WHEN k % 2 = 0 THEN (k % 50) || ' CFR Part ' || k ELSE '' END AS cfr FROM c"""
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with gaps, as typed metadata: dockets, agencies, dates, status and references."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    number, none = k.cast("string"), F.lit(None).cast("string")
    first = F.struct(F.when(k % 4 != 1, F.upper(s)).alias("raw_name"), F.when(k % 4 < 2, s).alias("name"))
    second = F.struct(none.alias("raw_name"), F.lit("Second").alias("name"))
    empty = F.struct(none.alias("raw_name"), F.lit("").alias("name"))
    raw = read(spark, sf_dir, "customer").select(
        number.alias("document_number"), F.when(k % 3 != 0, F.array(F.concat(F.lit("RM"), number, F.lit("-1")), F.concat(F.lit("RM"), number, F.lit("-2")))).alias("docket_ids"),
        F.when(k % 4 != 3, F.array(first, second, empty)).alias("agencies"), F.when(k % 5 != 0, F.col("c_name")).alias("title"),
        F.when(k % 7 == 0, "no date").otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")).cast("string")).alias("publication_date"),
        F.get(F.array(*map(F.lit, ("Notice", "Rule", "Proposed Rule", "Rule", "Rule", "Rule"))), (k % 6).cast("int")).alias("type"),
        F.get(F.array(F.lit("Final rule."), F.lit("Order on rehearing."), none, F.lit(" Final Rule. "), F.lit("Notice of Proposed Rulemaking"), F.lit("Other")), (k % 6).cast("int")).alias("action"),
        F.lit(1).alias("page_length"), none.alias("html_url"), none.alias("full_text_xml_url"), none.alias("abstract"), none.alias("comments_close_on"), none.alias("effective_on"), none.alias("dates"),
        F.array(F.struct((k % 50).cast("int").alias("title"), F.when(k % 2 == 0, number).alias("part")), F.struct(F.lit(None).cast("int").alias("title"), F.lit("9").alias("part"))).alias("cfr_references"),
    )
    return records.meta(raw).select(
        "doc_id", F.array_join("docket_ids", ",").alias("dockets"), "agency", F.array_join("agencies", ";").alias("agencies"), "title", "publication_date", "status", F.array_join("cfr_references", ",").alias("cfr"),
    )


@query(
    """WITH f AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'frDocNumber is missing' WHEN event_id % 13 = 0 THEN 'cardId is missing'
      WHEN event_id % 5 = 3 THEN 'verdict is unknown' WHEN event_id % 17 = 0 THEN 'note is too long' END AS error FROM events)
    SELECT user_id, count(*) FILTER (error IS NULL) AS logged, count(*) FILTER (error IS NOT NULL) AS refused FROM f GROUP BY ALL"""
)
def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts appended to the log, where they are valid, and read back by document."""
    k = F.col("event_id")
    none = F.lit(None).cast("string")
    verdict = F.get(F.array(*map(F.lit, (*V.VERDICTS, "maybe", "agree"))), (k % 5).cast("int"))
    rows = read(spark, sf_dir, "events").select(
        none.alias("id"), F.when(k % 11 != 0, F.col("user_id").cast("string")).alias("frDocNumber"), F.when(k % 13 == 0, "").otherwise(k.cast("string")).alias("cardId"), verdict.alias("verdict"),
        F.when(k % 17 == 0, F.repeat(F.lit("x"), 2001)).otherwise("fine").alias("note"), F.lit(None).cast("timestamp").alias("createdAt"), "user_id",
    )
    path = new_path(spark, "feedback")
    refused = records.add_feedback(rows, path).groupBy("user_id").agg(F.count("*").alias("refused"))
    log = records.read_feedback(spark, path).groupBy(F.col("frDocNumber").cast("long").alias("user_id")).agg(F.count("*").alias("logged"))
    met = log.join(refused.withColumn("user_id", F.col("user_id").cast("long")), "user_id", "full")
    return met.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("logged", "refused")])


@query(
    f"""WITH c AS (SELECT doc_id, {_text("text")} AS t, doc_id % 3 AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    q AS (SELECT doc_id, t, k, length(t) // 2 AS h, length(t) // 5 AS a, trim(t[length(t) // 5 + 1:length(t) // 5 + 60]) AS quote, t[1:length(t) // 2] AS half FROM c),
    n AS (SELECT *, CASE WHEN quote = '' THEN 0 ELSE len(list_filter(range(length(half) - length(quote) + 1), lambda i: half[i + 1:i + length(quote)] = quote)) END AS n FROM q)
    SELECT doc_id, CASE WHEN k = 2 AND doc_id % 2 = 0 THEN 'section-not-found' WHEN n = 0 THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS result,
      CASE WHEN n = 1 AND NOT (k = 2 AND doc_id % 2 = 0) THEN CASE WHEN k = 1 AND contains(quote, ' ') THEN 'normalized' ELSE 'exact' END END AS match,
      CASE WHEN n = 1 AND NOT (k = 2 AND doc_id % 2 = 0) THEN CAST(length(half) - length(split_part(half, quote, 2)) - length(quote) AS INT) END AS original_start FROM n"""
)
def locate_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the collapsed documents in their first half as a section: as they are, with doubled spaces, in a section that lacks."""
    d = written(read(spark, sf_dir, "documents").select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("text")), "collapsed")
    cut = T.trim(F.substring(F.col("text"), F.floor(F.length("text") / 5).cast("int") + 1, F.lit(60)))
    quote = F.when(F.col("doc_id") % 3 == 1, F.replace(cut, F.lit(" "), F.lit("  "))).otherwise(cut)
    scope = F.when((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 2 == 0), "9").otherwise("1")
    sections = d.select("doc_id", F.lit("1").alias("section_id"), F.lit(0).alias("span_start"), F.floor(F.length("text") / 2).cast("int").alias("span_end"))
    out = C.locate_within(d.select("doc_id", scope.alias("scope"), quote.alias("quote")), d, sections)
    return out.select("doc_id", "result", "match", "original_start")


@query(
    f"""WITH c AS (SELECT doc_id, {_text("coalesce(text, '')")} AS t FROM documents), w AS (SELECT *, unnest(range(0, 10)) AS j FROM c), p AS (SELECT *, length(t) * j // 9 AS p FROM w)
    SELECT doc_id, j::INT AS j, CAST(p AS INT) AS normal_at, nullif(CASE WHEN t[p + 1:p + 1] = ' ' THEN t[p + 2:p + 2] ELSE t[p + 1:p + 1] END, '') AS symbol FROM p"""
)
def original_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten places in each document's normal form, taken back to the original: the same character stands there, for a space
    the next; at the end there is none."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    points = d.select("doc_id", F.length(T.collapse("text")).alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"), "n")
    points = points.select("doc_id", "j", F.floor(F.col("n") * F.col("j") / 9).cast("int").alias("normal_at"))
    places = C.originals(points, C.normal_tokens(d, "doc_id", "text"), "doc_id", "normal_at")
    one = F.struct("j", "normal_at", "original_at")
    met = places.groupBy("doc_id").agg(F.collect_list(one).alias("places")).join(d, "doc_id")
    return met.select("doc_id", "text", F.explode("places").alias("p")).select(
        "doc_id", "p.j", "p.normal_at", F.when(F.col("p.original_at").isNotNull(), F.substring(F.col("text"), F.col("p.original_at") + 1, F.lit(1))).alias("symbol")
    )


_QUOTES = """q AS (SELECT item_id, string_split({normal}, ' ') AS w, unnest(['opening', 'inner']) AS part FROM benchmark),
    s AS (SELECT item_id, part, array_to_string(CASE part WHEN 'opening' THEN w[1:4] ELSE w[3:16] END, ' ') AS quote FROM q)"""


@query(
    f"""WITH {_QUOTES.format(normal=_text("text"))}, d AS (SELECT doc_id, {_text("text")} AS t FROM documents)
    SELECT item_id, part, count(*) AS docs, min(doc_id) AS first_doc, sum((length(t) - length(replace(t, quote, ''))) // length(quote))::BIGINT AS times FROM s JOIN d ON contains(t, quote) AND quote <> '' GROUP BY ALL"""
)
def corpus_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of the benchmark's passages, which many share, and inner words of them with doubled spaces, in all documents
    but for white space."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.split(T.collapse("text"), " ").alias("w"))
    opening, inner = F.array_join(F.slice("w", 1, 4), " "), F.array_join(F.slice("w", 3, 14), "  ")
    both = F.explode(F.array(*[F.struct(F.lit(part).alias("part"), x.alias("quote")) for part, x in (("opening", opening), ("inner", inner))]))
    q = b.select("item_id", both.alias("q")).select(F.struct("item_id", "q.part").alias("key"), "q.quote")
    met = C.contained(q, read(spark, sf_dir, "documents").select("doc_id", "text"), "key", "doc_id", normal=True)
    t, quote = T.collapse("text"), T.collapse("quote")
    times = (F.length(t) - F.length(F.replace(t, quote, F.lit("")))) / F.length(quote)
    return met.groupBy("key.item_id", "key.part").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.sum(times.cast("long")).alias("times"))
