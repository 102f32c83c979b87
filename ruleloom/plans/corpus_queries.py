"""Queries over the documents that Spark writes from orders and lineitem, each with the SQL that says what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import briefing as B
from ruleloom.operators import cards as C
from ruleloom.operators import citations as Q
from ruleloom.operators import determinations as G
from ruleloom.operators import model as M
from ruleloom.operators import redline as E
from ruleloom.operators import rules as R
from ruleloom.operators import spans as P
from ruleloom.operators import structure as S
from ruleloom.plans.corpus import KINDS, analysis, kind_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: A row per provision that a legend covers, with its kind, its place in the document and its number of edits.
LINES = f"""
lines AS (
  SELECT o_orderkey AS doc_id, l_linenumber AS line, l_partkey, (l_partkey + l_linenumber) % {KINDS} AS kind, o_orderpriority = '1-URGENT' AS urgent,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS place,
    {kind_sql("before")} AS before_body, {kind_sql("after")} AS after_body
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
),
judged AS (
  SELECT *, CASE WHEN kind IN (5, 7) THEN 1 ELSE 2 END AS n,
    CASE kind WHEN 0 THEN 'modal-change' WHEN 1 THEN 'numeric-change' WHEN 2 THEN 'case-only' WHEN 3 THEN 'article-only'
      WHEN 4 THEN 'cross-reference-renumber' WHEN 5 THEN 'negation-change' WHEN 6 THEN 'none' WHEN 7 THEN 'typographic-convention'
      ELSE 'numeric-change' END AS rule_id,
    CASE WHEN kind IN (0, 1, 5, 8, 9) THEN 'material' WHEN kind = 6 THEN 'undecided' ELSE 'editorial' END AS materiality
  FROM lines
)"""
MATERIALITIES = ("material", "clarifying", "editorial", "undecided")
_EDITS = ", ".join(f"CAST(coalesce(sum(n) FILTER (materiality = '{m}'), 0) AS BIGINT) AS edits_{m}" for m in MATERIALITIES)
_REVISIONS = ", ".join(f"count(*) FILTER (materiality = '{m}') AS revisions_{m}" for m in MATERIALITIES)
_FUNNEL = f"""SELECT doc_id, CAST(sum(n) AS BIGINT) AS edits, count(*) AS revisions, {_EDITS}, {_REVISIONS},
  round(sum(CASE WHEN materiality <> 'undecided' THEN n ELSE 0 END) / sum(n), 6) AS rule_coverage"""


@query(f"WITH {LINES} {_FUNNEL} FROM judged GROUP BY doc_id")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).funnel.withColumn("rule_coverage", F.round("rule_coverage", 6))


@query(f"WITH {LINES} SELECT rule_id, materiality, count(*) AS revisions, CAST(sum(n) AS BIGINT) AS edits FROM judged GROUP BY ALL")
def rule_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analysis(spark, sf_dir).classified
    return c.groupBy("rule_id", "materiality").agg(F.count("*").alias("revisions"), F.sum(F.size("edits")).alias("edits"))


@query(f"WITH {LINES} SELECT doc_id, rule_id, count(*) AS revisions FROM judged GROUP BY ALL")
def funnel_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_rule(analysis(spark, sf_dir).classified)


_PAIRS = f"""{LINES},
edits AS (
  SELECT doc_id, kind, place, unnest(CASE kind WHEN 0 THEN ['d:shall', 'a:may'] WHEN 1 THEN ['d:$10', 'a:$15'] WHEN 2 THEN ['d:Customer', 'a:customer']
    WHEN 3 THEN ['d:in a', 'a:in the'] WHEN 4 THEN ['d:section 3.1', 'a:section 3.2'] WHEN 5 THEN ['d:not'] WHEN 6 THEN ['d:rapid', 'a:quick']
    WHEN 7 THEN ['a:see'] WHEN 8 THEN ['d:ten', 'a:twelve'] ELSE ['d:20 MW', 'a:30 MW'] END) AS e FROM judged
)"""


@query(f"WITH {_PAIRS} SELECT doc_id, CASE WHEN e[1] = 'd' THEN 'deletion' ELSE 'addition' END AS kind, e[3:] AS text, count(*) AS n FROM edits GROUP BY ALL")
def edit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).edits.groupBy("doc_id", "kind", "text").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, CAST(place AS INT) AS group_id, CAST(n AS BIGINT) AS edits FROM judged")
def revision_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return E.group_edits(a.edits, a.doc_text).groupBy("doc_id", "group_id").agg(F.count("*").alias("edits"))


@query(
    f"""WITH {LINES} SELECT doc_id, 'Section ' || line || '.1. Rates' || chr(10) || before_body || chr(10) AS before,
    'Section ' || line || '.1. Rates' || chr(10) || after_body || chr(10) AS after, count(*) AS n FROM judged GROUP BY ALL"""
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).classified.groupBy("doc_id", "before", "after").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PAIRS}, told AS (
      SELECT doc_id, place, max(e[3:]) FILTER (e[1] = 'd') AS deletion, max(e[3:]) FILTER (e[1] = 'a') AS addition FROM edits GROUP BY ALL
    ) SELECT deletion, addition, count(*) AS n FROM told GROUP BY ALL"""
)
def pair_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    p = P.pair_edits(E.group_edits(a.edits, a.doc_text), ["doc_id", "group_id"], "span_start", "kind", "text")
    return p.groupBy("deletion", "addition").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS italics_in_footnotes, count(l_orderkey) FILTER ((l_partkey + l_linenumber) % 10 <> 7) AS brackets,
    CAST(0 AS BIGINT) AS unmatched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL"""
)
def edit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    d = E.diagnostics(a.regions, a.italics, S.footnotes(a.own_elements))
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("italics_in_footnotes", "brackets", "unmatched")])


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'no legend declares the mark-up' END AS reason FROM orders")
def extraction_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return E.extraction_reason(a.docs, a.regions)


@query(
    """WITH fixed AS (
      SELECT o_orderkey AS doc_id, unnest([{'id': '1', 't': 'I. Background', 'd': 1, 'r': 'preamble'}, {'id': '1/1', 't': 'A. Issues', 'd': 2, 'r': 'preamble'},
        {'id': '2', 't': 'Appendix A', 'd': 1, 'r': 'appendix'}]) AS s FROM orders
      UNION ALL SELECT o_orderkey, unnest([{'id': '1/2', 't': 'B. Compliance Procedures', 'd': 2, 'r': 'preamble'},
        {'id': '1/2/1', 't': '1. Commission Determination', 'd': 3, 'r': 'preamble'}]) FROM orders WHERE o_orderpriority = '1-URGENT'
    ) SELECT doc_id, s.id AS section_id, s.t AS title, CAST(s.d AS INT) AS depth, s.r AS region FROM fixed
    UNION ALL SELECT o_orderkey, '2/' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey), 'Section ' || l_linenumber || '.1. Rates', 2, 'appendix'
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analysis(spark, sf_dir).sections
    return s.select("doc_id", "section_id", F.element_at("heading_path", -1).alias("title"), F.col("depth").cast("int").alias("depth"), "region")


@query(
    """SELECT o_orderkey AS doc_id, unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN [1, 2, 3] ELSE [1, 2] END) AS number,
    unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN ['1', '1/1', '1/2/1'] ELSE ['1', '1/1'] END) AS section_id, false AS separate FROM orders"""
)
def numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).paragraphs.select("doc_id", "number", "section_id", "separate")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 2 END::BIGINT AS n, true AS complete FROM orders")
def paragraph_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.completeness(analysis(spark, sf_dir).paragraphs)


@query(
    """SELECT o_orderkey AS doc_id, t.tier, CASE t.tier WHEN 'T1' THEN true WHEN 'T2' THEN o_orderpriority = '1-URGENT' ELSE o_orderstatus <> 'P' END AS available
    FROM orders, (SELECT unnest(['T1', 'T2', 'T3']) AS tier) t"""
)
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).capabilities.select("doc_id", "tier", "available")


@query(
    """SELECT o_orderkey AS doc_id, '1/2/1' AS section_id, '1.1' AS cross_refs, '1.1' AS amended_refs, 3 AS paragraph_number, 'unclassified' AS disposition
    FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def determinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = analysis(spark, sf_dir).blocks
    refs = [F.array_join(c, ",").alias(c) for c in ("cross_refs", "amended_refs")]
    return b.select("doc_id", "section_id", *refs, "paragraph_number", "disposition")


@query(
    """SELECT o_orderkey AS doc_id, 1::BIGINT AS blocks, 1::BIGINT AS with_refs, 1.0::DOUBLE AS coverage, 1::BIGINT AS refs, 0::BIGINT AS statutory
    FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reference_stats(analysis(spark, sf_dir).blocks)


@query(
    """SELECT o_orderkey AS doc_id, CAST(o_orderkey % 18 + 1 AS INT) AS count, 'months' AS unit, 'publication' AS anchor,
    (date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 18 + 1 AS INT)) + to_days(CAST(day(o_orderdate) - 1 AS INT)))::DATE AS due_on
    FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def compliance_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).deadlines.select("doc_id", "count", "unit", "anchor", "due_on")


@query(
    """SELECT o_orderkey AS doc_id, 'I. Background' AS title, CASE WHEN o_orderpriority = '1-URGENT' THEN 'A. Issues; B. Compliance Procedures' ELSE 'A. Issues' END AS children,
    true AS is_primary FROM orders"""
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    o = S.outline(a.sections, a.paragraphs, least=1)
    return o.select("doc_id", "title", F.array_join(F.transform("children", lambda c: c["title"]), "; ").alias("children"), "is_primary")


#: Briefing entries: changed provisions, and decisions about provisions that no revision changed.
ENTRIES = f"""{LINES},
provisions AS (
  SELECT doc_id, place AS build_seq, 'Section ' || line || '.1. Rates' AS provision, line || '.1' AS provision_number, 1 AS revisions,
    CASE kind WHEN 0 THEN 'obligation' WHEN 1 THEN 'money' WHEN 9 THEN 'threshold' ELSE 'other' END AS category,
    CASE WHEN kind = 6 THEN 'needs-review' ELSE 'material' END AS priority,
    CASE WHEN urgent AND line = 1 THEN 'unknown' ELSE 'adopted' END AS provision_status
  FROM judged WHERE materiality <> 'editorial'
),
entries AS (
  SELECT * FROM provisions
  UNION ALL SELECT o_orderkey, 1000000000, 'B. Compliance Procedures', '1.1', 0, 'deadline', 'needs-review', 'unknown' FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT doc_id FROM provisions WHERE provision_number = '1.1')
)"""


@query(
    f"""WITH {ENTRIES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY
      list_position(['deadline', 'money', 'threshold', 'obligation', 'definition', 'other'], category),
      list_position(['material', 'needs-review', 'clarifying'], priority), revisions DESC, build_seq) AS INT) AS place,
    provision, category, priority, CAST(revisions AS BIGINT) AS revisions, provision_status FROM entries"""
)
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).briefing.select("doc_id", "place", "provision", "category", "priority", "revisions", "provision_status")


@query(f"WITH {ENTRIES} SELECT doc_id, category, count(*) AS entries FROM entries GROUP BY ALL")
def briefing_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_category(analysis(spark, sf_dir).briefing)


@query(
    f"""WITH {LINES} SELECT doc_id, count(*) AS total_provisions, count(*) FILTER (materiality <> 'editorial') AS edit_backed,
    count(*) FILTER (materiality = 'editorial') AS editorial_only FROM judged GROUP BY ALL"""
)
def briefing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return B.totals(a.classified, a.buckets, a.sections)


@query(
    f"""WITH {LINES} SELECT doc_id, 'Section ' || line || '.1. Rates' || chr(10) || before_body || chr(10) AS before, kind IN (1, 9) AS leads,
    count(*) AS n FROM judged WHERE materiality <> 'editorial' GROUP BY ALL"""
)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).passages.groupBy("doc_id", "before", "leads").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, '1/2/1' AS det_id, CAST(place AS INT) AS group_id FROM judged WHERE urgent AND line = 1 AND materiality <> 'editorial'")
def explicit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).explicit


@query(
    f"""WITH {LINES}, open AS (SELECT * FROM judged WHERE materiality <> 'editorial'), dets AS (
      SELECT o_orderkey AS doc_id, o_orderkey IN (SELECT doc_id FROM open WHERE line = 1) AS hit,
        o_orderkey IN (SELECT doc_id FROM open WHERE line = 1 AND materiality = 'material') AS material FROM orders WHERE o_orderpriority = '1-URGENT'
    ), cards AS (
      SELECT doc_id, true AS det, hit, CASE WHEN material THEN 'material' ELSE 'needs-review' END AS priority FROM dets
      UNION ALL SELECT doc_id, false, false, CASE WHEN materiality = 'material' THEN 'material' ELSE 'needs-review' END FROM open WHERE NOT (urgent AND line = 1)
    ) SELECT doc_id, count(*) FILTER (det) AS determinations, count(*) FILTER (det AND hit) AS joined_explicit, CAST(0 AS BIGINT) AS joined_implicit,
      count(*) FILTER (det AND NOT hit) AS unjoined, count(*) FILTER (NOT det) AS edit_only, count(*) AS cards,
      count(*) FILTER (priority = 'material') AS material, count(*) FILTER (priority = 'needs-review') AS needs_review, CAST(0 AS BIGINT) AS clarifying
    FROM cards GROUP BY ALL"""
)
def card_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(analysis(spark, sf_dir).cards)


@query(
    f"""WITH {LINES}, numbered AS (SELECT doc_id, kind, sum(CASE WHEN kind = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i FROM judged),
    open AS (SELECT doc_id, i FROM numbered WHERE kind = 6)
    SELECT doc_id, i::INT AS i, CASE i % 3 WHEN 0 THEN 'editorial' ELSE 'undecided' END AS materiality, CASE i % 3 WHEN 1 THEN 'omitted' WHEN 2 THEN 'invalid-output' END AS error,
      i % 3 <> 0 AS escalated FROM open WHERE doc_id % 5 <> 0 AND i < 20
    UNION ALL SELECT doc_id, i::INT, 'undecided', 'provider-error', true FROM open WHERE doc_id % 5 = 0 AND i < 20"""
)
def residual_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided revisions, asked in batches; answers leave some out, get some labels wrong, or don't come at all."""
    asked, r = _residuals(analysis(spark, sf_dir))
    met = r.join(asked.select("doc_id", "group_id", "i"), ["doc_id", "group_id"])
    return met.select("doc_id", "i", "materiality", "error", F.coalesce(F.col("escalated"), F.lit(True)).alias("escalated"))


def _residuals(a) -> tuple[DataFrame, DataFrame]:
    asked = M.batches(a.classified)
    said = F.concat(F.lit('{"i": '), F.col("i").cast("string"), F.lit(', "materiality": "'), F.when(F.col("i") % 3 == 0, "editorial").otherwise("trivial"), F.lit('", "reason": "r", "confidence": 0.9}'))
    answer = F.concat(F.lit('Sure: ```json\n{"results": ['), F.array_join(F.collect_list(F.when(F.col("i") % 3 != 1, said)), ", "), F.lit("]}\n```"))
    answers = asked.groupBy("doc_id", "batch").agg(answer.alias("answer")).where("doc_id % 5 <> 0")
    return asked, M.residuals(asked, answers)


@query(
    f"""WITH {LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, materiality ORDER BY place) - 1 AS i FROM judged),
    judged2 AS (SELECT * REPLACE (CASE WHEN materiality = 'undecided' AND doc_id % 5 <> 0 AND i < 20 AND i % 3 = 0 THEN 'editorial' ELSE materiality END AS materiality) FROM numbered)
    {_FUNNEL} FROM judged2 GROUP BY doc_id"""
)
def residual_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return M.final_funnel(a.classified, _residuals(a)[1]).withColumn("rule_coverage", F.round("rule_coverage", 6))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 2 END::BIGINT AS passed, 0::BIGINT AS suppressed, 1.0::DOUBLE AS rate FROM orders")
def citation_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numbered paragraph, cited with the section it lies in, passes the gate."""
    a = analysis(spark, sf_dir)
    return Q.self_check(a.paragraphs, a.doc_text, a.sections)


@query(
    f"""WITH {ENTRIES}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
      list_position(['deadline', 'money', 'threshold', 'obligation', 'definition', 'other'], category),
      list_position(['material', 'needs-review', 'clarifying'], priority), revisions DESC, build_seq) AS place FROM entries),
    own AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY place) AS k FROM placed WHERE priority = 'material' AND revisions > 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS number, provision, category FROM own WHERE k <= 4
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= 24"""
)
def statement_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provisions that statements are written for: four a category and 24 a document at most."""
    return B.statement_budget(analysis(spark, sf_dir).briefing).select("doc_id", "number", "provision", "category")
