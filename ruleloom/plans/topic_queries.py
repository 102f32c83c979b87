"""Queries over documents that Spark writes from the table customer: decisions that name topics instead of sections,
footnotes, unmatched brackets, separate statements and answers of a model, each with the SQL that says what they hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import briefing as B
from ruleloom.operators import cards as C
from ruleloom.operators import model as M
from ruleloom.operators import redline as E
from ruleloom.operators import structure as S
from ruleloom.plans.analysis import Analysis
from ruleloom.plans.corpus import AGENCY, LEGEND, read, shared, spread
from ruleloom.session import written
from ruleloom.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOPICS = ("Rate Schedule", "Transfer Capability", "Study Deposit")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _topic(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, TOPICS)), (n % len(TOPICS)).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml. The decision names one topic, the marked-up provision the same or another; every second document has a
    footnote with mark-up, every third a bracket that stays open, every fourth a separate statement at its end."""
    k = F.col("c_custkey")
    old, new = F.when(k % 5 != 1, "[old] ").otherwise(""), F.when(k % 5 != 0, '<E T="03">new</E> ').otherwise("")
    parts = (
        '<RULE><SUPLINF><HD SOURCE="HD1">I. Start</HD><P>1. Opening.</P><HD SOURCE="HD2">A. Topics</HD>',
        '<HD SOURCE="HD3">Commission Determination</HD><P>2. We take up Network Upgrades and ', _topic(k), " here.</P>",
        f'<HD SOURCE="HD1">Appendix A</HD><NOTE><P>{LEGEND}</P></NOTE><HD SOURCE="HD2">Section 1.1. Network Upgrades</HD><P>The ', old, new,
        "charge on Network Upgrades and ", _topic(F.floor(k / 3)), " applies.</P>",
        F.when(k % 2 == 0, '<FTNT><P>Note [kept] <E T="03">so</E>.</P></FTNT>').otherwise(""),
        F.when(k % 3 == 0, "<P>An open [bracket stays.</P>").otherwise(""),
        F.when(k % 4 == 0, '<FP>ROE, Commissioner, concurring:</FP><P>1. A <E T="03">pro forma</E> [aside].</P>').otherwise(""),
        "</SUPLINF></RULE>",
    )
    return spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("xml"))


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    def make() -> Analysis:
        docs = documents(spark, sf_dir)
        meta = docs.select(
            "doc_id", F.lit(AGENCY).alias("agency"), F.array().cast("array<string>").alias("agencies"), F.lit("final").alias("status"),
            F.lit("2024-01-31").cast("date").alias("publication_date"), F.lit(None).cast("date").alias("effective_on"),
        )
        return Analysis(meta, written(markup.project(docs), "projected"), store=written)

    return shared(spark, sf_dir, "topics", ("customer",), make)


CASES = """c AS (SELECT c_custkey AS doc_id, c_custkey % 3 = (c_custkey // 3) % 3 AS same, c_custkey % 5 AS how, c_custkey % 6 AS said,
    c_custkey % 12 = 1 AS unsure FROM customer)"""


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS italics_in_footnotes,
    (CASE WHEN c_custkey % 5 <> 1 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS brackets,
    CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS brackets_in_footnotes, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS unmatched FROM customer"""
)
def footnote_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mark-up holds in footnotes and out of pairs; a separate statement lies outside the region."""
    a = analysis(spark, sf_dir)
    d = E.diagnostics(a.regions, a.italics, S.footnotes(a.own_elements))
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("italics_in_footnotes", "brackets", "brackets_in_footnotes", "unmatched")])


@query(
    """SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 5 WHEN 0 THEN ['deletion'] WHEN 1 THEN ['addition'] ELSE ['addition', 'deletion'] END) AS kind,
    CASE kind WHEN 'deletion' THEN 'old' ELSE 'new' END AS text FROM customer"""
)
def edits_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits in footnotes and in separate statements are none of the document's."""
    return analysis(spark, sf_dir).edits.select("doc_id", "kind", "text")


@query(
    """SELECT c_custkey AS doc_id, unnest([1, 2]) AS number, false AS separate, unnest(['1', '1/1/1']) AS section_id FROM customer
    UNION ALL SELECT c_custkey, 1, true, '2/1' FROM customer WHERE c_custkey % 4 = 0"""
)
def separate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph numbers that start anew belong to a separate statement."""
    return analysis(spark, sf_dir).paragraphs.select("doc_id", "number", "separate", "section_id")


@query(f"WITH {CASES} SELECT doc_id, '1/1/1' AS det_id, 1 AS group_id, 'implicit' AS kind FROM c WHERE same")
def implicit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions without an explicit link take revisions that share their defined terms."""
    return analysis(spark, sf_dir).links.select("doc_id", "det_id", "group_id", "kind")


def _answers(blocks: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    quote = F.when(k % 6 == 4, "We  take up  Network Upgrades").when(k % 6 == 2, "We said so elsewhere").otherwise("We take up Network Upgrades")
    label = F.get(F.array(*map(F.lit, ("", "modified", "affirmed", "whatever", "sustained", ""))), (k % 6).cast("int"))
    sure = F.when(k % 12 == 1, "0.5").otherwise("0.9")
    answer = F.concat(F.lit('```json\n{"disposition": "'), label, F.lit('", "quote": "'), quote, F.lit('", "confidence": '), sure, F.lit("}\n```"))
    return blocks.where(k % 6 != 0).select("doc_id", "section_id", F.when(k % 6 == 5, "no idea").otherwise(answer).alias("answer"))


DISPOSED = f"""{CASES}, d AS (SELECT *, CASE said WHEN 1 THEN 'modified' WHEN 2 THEN 'affirmed' WHEN 4 THEN 'sustained' ELSE 'unclassified' END AS disposition,
    CASE WHEN said IN (1, 4) AND NOT unsure THEN 'medium' ELSE 'low' END AS confidence,
    CASE said WHEN 0 THEN 'provider-error' WHEN 2 THEN 'ungrounded' WHEN 3 THEN 'invalid-output' WHEN 5 THEN 'invalid-output' END AS error FROM c)"""


@query(f"WITH {DISPOSED} SELECT doc_id, disposition, confidence, confidence = 'low' AS escalated, error FROM d")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a quotation that is in the block (as it is or but for white space), one that isn't, a foreign label, none."""
    b = analysis(spark, sf_dir).blocks
    return M.dispositions(b, _answers(b)).select("doc_id", "disposition", "confidence", "escalated", "error")


_EFFECT = "CASE how WHEN 0 THEN 'removed' WHEN 1 THEN 'new' ELSE 'strengthened' END"


@query(
    f"""WITH {DISPOSED}, k AS (
      SELECT doc_id, true AS decided, CASE WHEN same THEN 'implicit' ELSE 'none' END AS join_kind, CASE WHEN same THEN {_EFFECT} ELSE 'unknown' END AS effect,
        same OR disposition = 'unclassified' AS escalated FROM d
      UNION ALL SELECT doc_id, false, 'none', {_EFFECT}, true FROM d WHERE NOT same
    ) SELECT doc_id, decided, join_kind, effect, escalated, CASE WHEN escalated THEN 'low' ELSE 'medium' END AS confidence,
      CASE WHEN escalated THEN 'needs-review' ELSE 'clarifying' END AS priority FROM k"""
)
def card_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of decisions with the model's dispositions: how they were joined, what they did, and how sure that is."""
    return _cards(spark, sf_dir).select("doc_id", F.col("det_id").isNotNull().alias("decided"), "join_kind", "effect", "escalated", "confidence", "priority")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return C.cards(M.dispositions(a.blocks, _answers(a.blocks)), a.classified, a.links)


@query(
    f"""WITH {DISPOSED}, k AS (SELECT doc_id, same, disposition FROM d)
    SELECT doc_id, 1::BIGINT AS determinations, 0::BIGINT AS joined_explicit, same::BIGINT AS joined_implicit, (NOT same)::BIGINT AS unjoined, (NOT same)::BIGINT AS edit_only,
      CASE WHEN same THEN 1 ELSE 2 END::BIGINT AS cards, 0::BIGINT AS material,
      ((same OR disposition = 'unclassified')::INT + (NOT same)::INT)::BIGINT AS needs_review, (NOT same AND disposition <> 'unclassified')::BIGINT AS clarifying FROM k"""
)
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(_cards(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) // 2 AS mid FROM documents WHERE text IS NOT NULL),
    l AS (SELECT *, greatest(0, mid - 120) AS rough, strpos(reverse(text[greatest(0, mid - 400) + 1:mid]), ' .') AS back FROM d),
    s AS (SELECT *, strpos(text[rough + 1:mid + 1], ' ') AS space FROM l),
    f AS (SELECT *, CASE WHEN mid <= 0 THEN 0 WHEN back > 0 THEN mid - back + 1 WHEN space > 0 THEN rough + space ELSE rough END AS a FROM s)
    SELECT doc_id, md5(text[a + 1:a + 900]) AS shown, a > 0 AS clipped_start, a + 900 < length(text) AS clipped_end FROM f"""
)
def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window on each document's middle that opens at a sentence, or else at a word."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    f = B.focus(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", f.alias("f")).select("doc_id", F.md5("f.text").alias("shown"), "f.clipped_start", "f.clipped_end")
