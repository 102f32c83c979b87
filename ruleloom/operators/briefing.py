"""The briefing: revisions rolled up by provision, with decisions, passages, order and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.redline import reading
from ruleloom.operators.spans import islands, overlaps, with_text
from ruleloom.operators.structure import section_at
from ruleloom.session import united

PRIORITIES = ("material", "needs-review", "clarifying")


def priority(material: Column, undecided: Column) -> Column:
    return F.when(material, "material").when(undecided, "needs-review").otherwise("clarifying")


def focus(text: Column, at: Column, most: int = V.PASSAGE_CHARS) -> Column:
    """text, clipped_start, clipped_end: opens at the sentence (or word) that holds place at; whole if short and no place."""
    at = F.coalesce(at, F.lit(-1))
    lead = T.cut(text, F.greatest(F.lit(0), at - 400), at)
    back = F.locate(" .", F.reverse(lead))
    rough = F.greatest(F.lit(0), at - 120)
    space = F.locate(" ", T.cut(text, rough, at + 1))
    start = F.when(at <= 0, 0).when(back > 0, at - back + 1).when(space > 0, rough + space).otherwise(rough)
    end = F.least(F.length(text), start + most)
    whole = (F.length(text) <= most) & (at <= 0)
    cut = F.struct(T.cut(text, start, end).alias("text"), (start > 0).alias("clipped_start"), (end < F.length(text)).alias("clipped_end"))
    return F.when(whole, F.struct(text.alias("text"), F.lit(False).alias("clipped_start"), F.lit(False).alias("clipped_end"))).otherwise(cut)


def buckets(classified: DataFrame, sections: DataFrame) -> DataFrame:
    """Revisions that aren't editorial, by their innermost section: one row per provision."""
    c = classified.where("materiality <> 'editorial'").drop("section_id")
    c = section_at(c, sections, "span_start", ["section_id", "heading_path"]).where("section_id is not null")
    texts = F.transform("edits", lambda e: F.struct(e["span_start"].alias("at"), e["text"].alias("text")))
    b = c.groupBy("doc_id", "section_id").agg(
        F.first("heading_path").alias("heading_path"),
        F.min("group_id").alias("build_seq"),
        F.count("*").alias("revisions"),
        F.bool_or(F.col("materiality") == "material").alias("material"),
        F.bool_or(F.col("materiality") == "undecided").alias("undecided"),
        F.array_sort(F.flatten(F.collect_list(texts))).alias("texts"),
    )
    title = F.element_at("heading_path", -1)
    changed = F.substring(F.array_join(F.transform("texts", lambda t: t["text"]), " "), 1, V.CHANGED_CHARS)
    return b.select(
        "doc_id", "section_id", "heading_path", "build_seq", title.alias("provision"), D.provision_number(title).alias("provision_number"),
        D.category(changed, title).alias("category"), priority(F.col("material"), F.col("undecided")).alias("priority"), "revisions",
        F.size("texts").alias("edits"),
    )


def passages(classified: DataFrame, buckets: DataFrame, sections: DataFrame, doc_text: DataFrame, most: int = V.PASSAGES) -> DataFrame:
    """The readable passages of each provision: revisions widened, merged, reconstructed; those with its signal first."""
    wide = V.PASSAGE_CONTEXT
    s = sections.select("doc_id", "section_id", F.col("span_start").alias("s_lo"), F.col("span_end").alias("s_hi"))
    c = section_at(classified.where("materiality <> 'editorial'").drop("section_id"), sections, "span_start", ["section_id"]).where("section_id is not null")
    w = c.select("doc_id", "section_id", (F.col("span_start") - wide).alias("a"), (F.col("span_end") + wide).alias("b"))
    w = islands(w, ["doc_id", "section_id"], "a", "b", wide).groupBy("doc_id", "section_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    w = w.join(s, ["doc_id", "section_id"])
    w = w.withColumns({"lo": F.greatest("s_lo", "a"), "hi": F.least("s_hi", "b")})
    e = classified.select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.span_start", "e.span_end", "e.kind", "e.text")
    keys = ["doc_id", "section_id", "island"]
    met = overlaps(w.select(*keys, "lo", "hi"), e, "doc_id", "lo", "hi")
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "kind", "text"))).alias("edits"))
    w = w.join(met, keys).join(buckets.select("doc_id", "section_id", "category"), ["doc_id", "section_id"])
    low = F.greatest("s_lo", F.least("lo", F.array_min(F.transform("edits", lambda x: x["span_start"]))))
    high = F.least("s_hi", F.greatest("hi", F.array_max(F.transform("edits", lambda x: x["span_end"]))))
    w = with_text(w.withColumns({"start": low, "end": high}), doc_text, F.col("start"), F.col("end"))
    here = F.col("window_at")
    own = F.transform("edits", lambda x: F.struct((x["span_start"] - here).alias("span_start"), (x["span_end"] - here).alias("span_end"), x["kind"].alias("kind"), x["text"].alias("text")))
    for side, kind in (("after", "addition"), ("before", "deletion")):
        text = reading(F.col("window"), own, F.col("start") - here, F.col("end") - here, kind)
        w = w.withColumn(side, T.replace(text, r"\[[WS]*\]", ""))
    at = F.lit(None).cast("int")
    for name in V.SIGNAL_ORDER:
        at = F.when(F.col("category") == name, D.strongest_signal(F.col("after"), name)).otherwise(at)
    w = w.withColumn("at", at).withColumn("leads", F.col("at").isNotNull()).withColumn("f", focus(F.col("after"), F.col("at")))
    every = Window.partitionBy("doc_id", "section_id")
    w = w.withColumns({"place": F.row_number().over(every.orderBy(F.desc("leads"), "island")), "passages": F.count("*").over(every)})
    return w.where(F.col("place") <= most).select(*keys[:2], "place", "passages", "f.*", F.col("before"), "leads", "start", "end")


def decisions_of(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Provisions with the decisions that amend their number, in the document's order: block ids and the first disposition."""
    d = blocks.select("doc_id", F.explode("amended_refs").alias("provision_number"), F.struct("span_start", "section_id", "disposition").alias("d"))
    d = d.groupBy("doc_id", "provision_number").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    met = buckets.join(d, ["doc_id", "provision_number"], "left")
    return met.withColumns({"decisions": F.coalesce(F.transform("ds", lambda x: x["section_id"]), F.array().cast("array<string>")), "disposition": F.get("ds", F.lit(0))["disposition"]}).drop("ds")


def decision_only(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Decisions none of whose amended references is a changed provision, as entries of their own."""
    covered = buckets.where("provision_number is not null").select("doc_id", F.col("provision_number").alias("ref")).distinct()
    refs = blocks.select("doc_id", "section_id", F.explode("amended_refs").alias("ref")).join(covered, ["doc_id", "ref"], "left_semi")
    d = blocks.join(refs.select("doc_id", "section_id").distinct(), ["doc_id", "section_id"], "left_anti")
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-2)), F.element_at("heading_path", -1))
    kind = F.when(F.col("disposition") == "unclassified", "needs-review").when(F.col("disposition").isin("modified", "set-aside"), "material")
    return d.select(
        "doc_id", "section_id", "heading_path", (F.col("span_start") + F.lit(1_000_000_000)).cast("int").alias("build_seq"), title.alias("provision"),
        F.get("amended_refs", F.lit(0)).alias("provision_number"), D.category(F.substring("text", 1, V.TERM_CHARS), title).alias("category"),
        kind.otherwise("clarifying").alias("priority"), F.lit(0).cast("long").alias("revisions"), F.lit(0).alias("edits"),
        F.array("section_id").alias("decisions"), "disposition",
    )


def briefing(buckets: DataFrame, blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """All entries in order of category, priority and revisions, with place, provision_status and escalated."""
    b = decisions_of(buckets, blocks)
    out = united(b, decision_only(buckets, blocks).select(b.columns)).join(meta.select("doc_id", "status"), "doc_id", "left")
    status = D.provision_status(F.coalesce("status", F.lit("final")), F.col("disposition"), F.col("edits") > 0)
    order = Window.partitionBy("doc_id").orderBy(
        D.category_rank(F.col("category")), F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.desc("revisions"), "build_seq"
    )
    return out.withColumns({"provision_status": status, "escalated": F.col("priority") == "needs-review", "place": F.row_number().over(order)})


def totals(classified: DataFrame, buckets: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, total_provisions, edit_backed, editorial_only (the former less the latter)."""
    at = section_at(classified.select("doc_id", "span_start"), sections, "span_start", ["section_id"])
    every = at.groupBy("doc_id").agg(F.count_distinct("section_id").alias("total_provisions"))
    backed = buckets.groupBy("doc_id").agg(F.count("*").alias("edit_backed"))
    out = every.join(backed, "doc_id", "left").fillna(0, ["edit_backed"])
    return out.withColumn("editorial_only", F.col("total_provisions") - F.col("edit_backed"))


def by_category(briefing: DataFrame) -> DataFrame:
    return briefing.groupBy("doc_id", "category").agg(F.count("*").alias("entries"))


def statement_budget(briefing: DataFrame, each: int = V.STATEMENTS, most: int = V.STATEMENTS_IN_ALL) -> DataFrame:
    """The entries that statements are written for: the first material ones with edits of each category, and of those the
    first of all, in the briefing's order; with their number from 1."""
    own = briefing.where("priority = 'material' and edits > 0")
    own = own.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("place"))).where(F.col("__k") <= each)
    return own.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).where(F.col("number") <= most).drop("__k")
