"""Cards: decisions joined to the revisions that they direct, by provision number or, failing that, by defined terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.briefing import priority
from ruleloom.operators.structure import section_at
from ruleloom.session import united, written


def provisions(sections: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, number, section_id of the numbered sections in a document's region; a number may have several."""
    r = regions.select("doc_id", "region_start", "region_end")
    s = sections.join(r, "doc_id").where("span_start >= region_start and span_start < region_end")
    return s.withColumn("number", D.provision_number(F.element_at("heading_path", -1))).where("number is not null").select("doc_id", "number", "section_id")


def explicit(blocks: DataFrame, provisions: DataFrame, classified: DataFrame) -> DataFrame:
    """doc_id, det_id, group_id: a revision with an edit in a section that the decision amends."""
    refs = blocks.select("doc_id", F.col("section_id").alias("det_id"), F.explode("amended_refs").alias("number"))
    g = classified.where("materiality <> 'editorial'").select("doc_id", "group_id", F.explode("edits").alias("e")).select("doc_id", "group_id", "e.section_id")
    return refs.join(provisions, ["doc_id", "number"]).join(g, ["doc_id", "section_id"]).select("doc_id", "det_id", "group_id").distinct()


def implicit_scores(blocks: DataFrame, classified: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, det_id, group_id, score: shared terms by the smaller set's size, at least the threshold.

    Terms are exploded and met by equality, so only pairs that share a term exist.
    """
    d = blocks.select("doc_id", F.col("section_id").alias("det_id"), D.defined_terms(F.substring("text", 1, V.TERM_CHARS)).alias("dt"))
    c = section_at(classified.where("materiality <> 'editorial'").drop("section_id"), sections, "span_start", ["heading_path"])
    topic = F.concat_ws(" ", F.array_join(F.slice(F.reverse("heading_path"), 1, 2), " "), F.col("after"))
    g = c.select("doc_id", "group_id", D.defined_terms(topic).alias("gt"))
    a = d.select("doc_id", "det_id", F.size("dt").alias("dn"), F.explode("dt").alias("term"))
    b = g.select("doc_id", "group_id", F.size("gt").alias("gn"), F.explode("gt").alias("term"))
    met = a.join(b, ["doc_id", "term"]).groupBy("doc_id", "det_id", "group_id", "dn", "gn").agg(F.count("*").alias("shared"))
    score = F.col("shared") / F.least("dn", "gn")
    return met.select("doc_id", "det_id", "group_id", score.alias("score")).where(F.col("score") >= V.TERM_OVERLAP)


def links(blocks: DataFrame, explicit: DataFrame, scores: DataFrame, store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """doc_id, det_id, group_id, kind. Decisions claim revisions in the document's order; those without an explicit link
    take the best that no earlier decision has claimed, at most TERM_GROUPS.

    All documents are claimed at once, in rounds. A decision settles as soon as it comes before all other open decisions
    at each of its best revisions, as none of these can be taken from it any more; what it takes is then gone for the
    others. The first open decision of a document always settles, and decisions that don't compete settle in the first
    round. Explicit links are certain before: they take revisions from later decisions only.
    """
    order = blocks.select("doc_id", F.col("section_id").alias("det_id"), F.struct("span_start", F.col("section_id").alias("id")).alias("det"))
    sure = explicit.join(order, ["doc_id", "det_id"])
    gone = sure.groupBy("doc_id", "group_id").agg(F.min("det").alias("gone"))
    open_ = scores.join(order, ["doc_id", "det_id"]).join(explicit.select("doc_id", "det_id").distinct(), ["doc_id", "det_id"], "left_anti")
    open_ = open_.join(gone, ["doc_id", "group_id"], "left").where(F.col("gone").isNull() | (F.col("det") < F.col("gone"))).drop("gone")
    mine, rivals = Window.partitionBy("doc_id", "det_id"), Window.partitionBy("doc_id", "group_id")
    out = sure.select("doc_id", "det_id", "group_id", F.lit("explicit").alias("kind"))
    while True:
        r = open_.withColumn("first", F.col("det") == F.min("det").over(rivals))
        r = r.withColumn("best", F.row_number().over(mine.orderBy(F.desc("score"), "group_id")) <= V.TERM_GROUPS)
        r = r.withColumn("settled", F.bool_and(F.col("first") | ~F.col("best")).over(mine))
        r = store(r.withColumn("taken", F.bool_or(F.col("settled") & F.col("best")).over(rivals)), "claims")
        took = r.where("settled and best").select("doc_id", "det_id", "group_id", F.lit("implicit").alias("kind"))
        open_ = r.where("not settled and not taken").select(open_.columns)
        if took.isEmpty():
            return out
        out = united(out, took)


def cards(blocks: DataFrame, classified: DataFrame, links: DataFrame) -> DataFrame:
    """One card per decision, and one per revision that no decision claims: no revision is lost, some are shown twice."""
    g = classified.where("materiality <> 'editorial'").select("doc_id", "group_id", "span_start", "edits", "materiality")
    d = blocks.select("doc_id", F.col("section_id").alias("det_id"), F.col("span_start").alias("det_at"), "disposition", F.col("heading_path"))
    met = d.join(links, ["doc_id", "det_id"], "left").join(g, ["doc_id", "group_id"], "left")
    agg = [
        F.array_sort(F.collect_list("group_id")).alias("groups"),
        F.coalesce(F.bool_or(F.col("materiality") == "material"), F.lit(False)).alias("material"),
        F.coalesce(F.bool_or(F.col("materiality") == "undecided"), F.lit(False)).alias("undecided"),
        F.min_by(F.struct("materiality", "edits"), F.struct("span_start", "group_id")).alias("lead"),
    ]
    with_d = met.groupBy("doc_id", "det_id", "det_at", "disposition", "heading_path").agg(F.max("kind").alias("kind"), *agg)
    alone = g.join(links.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_anti").withColumns(
        {"det_id": F.lit(None).cast("string"), "det_at": F.col("span_start"), "disposition": F.lit(None).cast("string"), "heading_path": F.lit(None).cast("array<string>"), "kind": F.lit(None).cast("string")}
    )
    without = alone.groupBy("doc_id", "det_id", "det_at", "disposition", "heading_path", "group_id").agg(F.max("kind").alias("kind"), *agg).drop("group_id")
    c = united(with_d, without)
    escalated = (F.coalesce(F.col("disposition") == "unclassified", F.lit(False))) | F.col("undecided")
    kinds = F.array_distinct(F.transform("lead.edits", lambda e: e["kind"]))
    effect = (
        F.when(F.col("lead").isNull() | F.col("lead.materiality").isNull(), "unknown")
        .when(F.col("lead.materiality") == "editorial", "clarified-no-change")
        .when(F.size(kinds) > 1, "strengthened")
        .when(F.array_contains(kinds, "addition"), "new")
        .otherwise("removed")
    )
    return c.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("d"), F.col("det_id")), F.concat(F.lit("e"), F.col("det_at").cast("string"))).alias("card_id"),
        "det_id", F.col("det_at").alias("at"), "disposition", F.coalesce("kind", F.lit("none")).alias("join_kind"), "groups", effect.alias("effect"),
        F.when(escalated, "low").otherwise("medium").alias("confidence"), escalated.alias("escalated"), priority(F.col("material"), escalated).alias("priority"),
    )


def coverage(cards: DataFrame) -> DataFrame:
    """doc_id and counts of cards by kind of join and priority."""
    det = F.col("det_id").isNotNull()
    return cards.groupBy("doc_id").agg(
        F.count_if(det).alias("determinations"),
        *[F.count_if(det & (F.col("join_kind") == k)).alias(n) for k, n in (("explicit", "joined_explicit"), ("implicit", "joined_implicit"), ("none", "unjoined"))],
        F.count_if(~det).alias("edit_only"),
        F.count("*").alias("cards"),
        *[F.count_if(F.col("priority") == p).alias(p.replace("-", "_")) for p in ("material", "needs-review", "clarifying")],
    )


def ordered(cards: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("material", "needs-review", "clarifying"))), F.col("priority"))
    return cards.orderBy("doc_id", rank, F.desc("escalated"), "at", "card_id")


def terms_text(text):
    return F.array_join(D.defined_terms(T.col(text)), ", ")
