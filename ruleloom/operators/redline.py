"""Marked-up edits: the region that declares them, their extraction, grouping and reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.spans import PIECE, inside, once, pattern_pairs, placed, places, with_text
from ruleloom.operators.structure import section_at
from ruleloom.session import united

DELETION = r"\[[^\[\]]*\]"


def regions(doc_text: DataFrame, bodies: DataFrame | None, convention: V.Convention) -> DataFrame:
    """doc_id, region_start, region_end, text: from the legend in the body to the first separate statement or its end.

    bodies: as structure.body_spans() gives them, unless doc_text has them beside its texts.
    """
    d = doc_text if bodies is None else doc_text.select("doc_id", "text").join(bodies, "doc_id")
    d = once(d.withColumn("body", T.cut("text", F.col("body_start"), F.col("body_end"))), at=F.regexp_instr("body", F.lit(T.pattern(convention.legend)))).where("at > 0")
    d = once(d, stop=F.regexp_instr(F.expr("substring(body, at)"), F.lit(T.pattern(convention.separate_statement))))
    start = F.col("body_start") + F.col("at") - 1
    end = F.least(F.when(F.col("stop") > 0, start + F.col("stop") - 1).otherwise(F.col("body_end")), F.col("body_end"))
    return d.select("doc_id", start.alias("region_start"), end.alias("region_end"), "text")


def regions_in_blocks(blocks: DataFrame, bodies: DataFrame, convention: V.Convention) -> DataFrame:
    """doc_id, region_start, region_end, as regions() has them, of texts that come in blocks (doc_id, piece, text)."""
    inside_body = "at >= body_start and to <= body_end"
    first = places(blocks, T.pattern(convention.legend)).join(bodies, "doc_id").where(inside_body)
    r = first.groupBy("doc_id", "body_start", "body_end").agg(F.min("at").alias("region_start"))
    stop = places(blocks, T.pattern(convention.separate_statement)).join(r, "doc_id").where("at >= region_start and to <= body_end")
    r = r.join(stop.groupBy("doc_id").agg(F.min("at").alias("stop")), "doc_id", "left")
    return r.select("doc_id", "region_start", F.least(F.coalesce("stop", "body_end"), "body_end").alias("region_end"))


def brackets_in_blocks(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, at, to, closed of each [ in the regions of texts that come in blocks: from it to the bracket after it, and
    whether that closes it; such are the innermost pairs. No text is put together, however far apart a pair's ends are."""
    found = blocks.select("doc_id", "piece", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\[\]]*[\[\]]"), F.lit(0))).alias("k", "upto"))
    end = F.sum(F.length("upto")).over(Window.partitionBy("doc_id", "piece").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    found = found.select("doc_id", (end + F.col("piece") * PIECE).cast("int").alias("to"), F.endswith("upto", F.lit("[")).alias("opens"))
    r = regions.select("doc_id", "region_start", "region_end")
    found = found.join(r, "doc_id").where("to > region_start and to <= region_end").select("doc_id", F.col("to") - 1, "opens").toDF("doc_id", "at", "opens")
    order = Window.partitionBy("doc_id").orderBy("at")
    found = found.withColumns({"__next": F.lead("at").over(order), "__opens": F.lead("opens").over(order)}).where("opens")
    return found.select("doc_id", "at", (F.col("__next") + 1).alias("to"), F.coalesce(~F.col("__opens"), F.lit(False)).alias("closed"))


def bracketed(regions: DataFrame) -> DataFrame:
    """regions with brackets instead of their texts: each innermost bracket pair with what lies before it."""
    own = T.cut("text", F.col("region_start"), F.col("region_end"))
    return regions.select("doc_id", "region_start", "region_end", pattern_pairs(own, DELETION).alias("brackets"))


def bracket_spans(regions: DataFrame) -> DataFrame:
    """doc_id, at, inner: place (from 0, in the region) and content of each innermost bracket pair. regions: with their texts, or bracketed()."""
    found = placed(regions if "brackets" in regions.columns else bracketed(regions), "doc_id", "brackets")
    return found.select("doc_id", "at", F.expr("substring(match, 2, length(match) - 2)").alias("inner"))


def edits(regions: DataFrame, italics: DataFrame, footnotes: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, edit_id, kind, text, span_start, span_end, section_id of each edit that a section holds, and that section's span."""
    r = regions.select("doc_id", "region_start", "region_end")
    gone = bracket_spans(regions).join(r, "doc_id").withColumn("span_start", F.col("region_start") + F.col("at"))
    return edits_of(gone.select("doc_id", "inner", "span_start"), r, italics, footnotes, sections)


def edits_of(brackets: DataFrame, regions: DataFrame, italics: DataFrame, footnotes: DataFrame, sections: DataFrame) -> DataFrame:
    """As edits(), of the regions' brackets: doc_id, span_start, inner."""
    added = italics.where(~F.col("in_footnote") & ~T.is_blank("text")).join(regions, "doc_id").where("span_start >= region_start and span_start < region_end")
    added = added.select("doc_id", F.lit("addition").alias("kind"), "text", "span_start", "span_end")
    met = inside(brackets, footnotes, "doc_id", "span_start", "span_start", "span_end").where(~F.col("inside") & ~T.is_blank("inner"))
    gone = met.select("doc_id", F.lit("deletion").alias("kind"), F.col("inner").alias("text"), "span_start", (F.col("span_start") + F.length("inner") + 2).alias("span_end"))
    s = sections.select("doc_id", "span_start", "section_id", F.col("span_start").alias("section_start"), F.col("span_end").alias("section_end"))
    out = section_at(united(added, gone), s, "span_start", ["section_id", "section_start", "section_end"]).where("section_id is not null")
    return out.withColumn("edit_id", F.concat(F.substring("kind", 1, 1), F.col("span_start").cast("string")))


def diagnostics_in_blocks(brackets: DataFrame, regions: DataFrame, italics: DataFrame, footnotes: DataFrame) -> DataFrame:
    """As diagnostics(), of brackets_in_blocks()."""
    r = regions.select("doc_id", "region_start", "region_end")
    noted = italics.where("in_footnote").join(r, "doc_id").where("span_start >= region_start and span_start < region_end")
    noted = noted.groupBy("doc_id").agg(F.count("*").alias("italics_in_footnotes"))
    held = inside(brackets.where("closed").select("doc_id", "at"), footnotes, "doc_id", "at", "span_start", "span_end").groupBy("doc_id").agg(F.count_if("inside").alias("brackets_in_footnotes"))
    n = brackets.groupBy("doc_id").agg(F.count_if("closed").alias("brackets"), F.count_if(~F.col("closed")).alias("unmatched"))
    out = r.select("doc_id").join(n, "doc_id", "left").join(noted, "doc_id", "left").join(held, "doc_id", "left").fillna(0)
    return out.select("doc_id", "brackets", "unmatched", "italics_in_footnotes", "brackets_in_footnotes")


def diagnostics(regions: DataFrame, italics: DataFrame, footnotes: DataFrame) -> DataFrame:
    """doc_id, italics_in_footnotes, brackets, brackets_in_footnotes, unmatched."""
    r = regions.select("doc_id", "region_start", "region_end")
    noted = italics.where("in_footnote").join(r, "doc_id").where("span_start >= region_start and span_start < region_end")
    noted = noted.groupBy("doc_id").agg(F.count("*").alias("italics_in_footnotes"))
    gone = bracket_spans(regions).join(r, "doc_id").withColumn("at", F.col("at") + F.col("region_start"))
    held = inside(gone, footnotes, "doc_id", "at", "span_start", "span_end").groupBy("doc_id").agg(F.count_if("inside").alias("brackets_in_footnotes"))
    own = T.cut("text", F.col("region_start"), F.col("region_end"))
    out = once(regions, pairs=F.regexp_count(own, F.lit(DELETION)), opened=F.regexp_count(own, F.lit(r"\[")))
    out = out.select("doc_id", F.col("pairs").alias("brackets"), F.greatest(F.lit(0), F.col("opened") - F.col("pairs")).alias("unmatched"))
    return out.join(noted, "doc_id", "left").join(held, "doc_id", "left").fillna(0)


def extraction_reason(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, reason: why a document has no edits, null where it has a region."""
    d = docs.join(regions.select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    none = F.when(F.col("convention_id").isNull(), "no redline convention is registered for this agency")
    return d.select("doc_id", F.when(F.col("found"), None).otherwise(none.otherwise("no legend declares the mark-up")).alias("reason"))


def group_edits(edits: DataFrame, doc_text: DataFrame, most: int = 0) -> DataFrame:
    """Adds group_id: an edit joins the one before it unless they overlap or over most characters (trimmed) lie between."""
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    e = edits.withColumn("__end", F.lag("span_end").over(order))
    e = with_text(e, doc_text, F.least(F.coalesce("__end", "span_start"), F.col("span_start")), F.col("span_start"))
    between = F.length(T.trim(T.cut("window", F.col("__end") - F.col("window_at"), F.col("span_start") - F.col("window_at"))))
    joins = (F.col("span_start") >= F.col("__end")) & (between <= most)
    e = e.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("window", "window_at", "__end")
    return e.withColumn("group_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def reading(text: Column, edits: Column, start: Column, end: Column, keeps: str) -> Column:
    """The text from start to end with only one kind's edits; edits: sorted structs (span_start, span_end, kind, text)."""

    def step(acc: Column, e: Column) -> Column:
        shown = F.concat(acc["out"], T.cut(text, acc["at"], e["span_start"]), F.when(e["kind"] == keeps, e["text"]).otherwise(""))
        return F.when(e["span_start"] < acc["at"], acc).otherwise(F.struct(e["span_end"].alias("at"), shown.alias("out")))

    done = F.aggregate(edits, F.struct(start.cast("int").alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], T.cut(text, done["at"], end))


def revisions(grouped: DataFrame, sections: DataFrame, doc_text: DataFrame, context: int = V.CONTEXT) -> DataFrame:
    """One row per group: its span, edits, first section, and the text before and after with some context of that section.

    Edits that come with their section's span, as edits() gives them, aren't joined to sections again."""
    e = F.struct(*[F.col(c).cast("int").alias(c) for c in ("span_start", "span_end")], "kind", "text", "section_id")
    held = "section_start" in grouped.columns
    first = F.struct(*[F.col(c).cast("int").alias(c) for c in ("span_start", "span_end")], "kind", "text", "section_id", *[c for c in ("section_start", "section_end") if held])
    g = grouped.groupBy("doc_id", "group_id").agg(
        F.min("span_start").cast("int").alias("span_start"), F.max("span_end").cast("int").alias("span_end"), F.array_sort(F.collect_list(e)).alias("edits"), F.min(first).alias("__first")
    )
    g = g.withColumn("section_id", F.col("__first.section_id"))
    if held:
        g = g.withColumns({"lo": F.col("__first.section_start"), "hi": F.col("__first.section_end")})
    else:
        s = sections.select("doc_id", "section_id", F.col("span_start").alias("lo"), F.col("span_end").alias("hi"))
        g = g.join(s, ["doc_id", "section_id"], "left")
    g = g.drop("__first")
    start = F.greatest(F.lit(0), F.col("lo"), F.col("span_start") - context)
    end = F.least(F.col("hi"), F.col("span_end") + context)
    g = with_text(g.withColumns({"__from": start, "__to": end}), doc_text, F.col("__from"), F.greatest("__to", "span_end"))
    own = F.transform("edits", lambda e: F.struct((e["span_start"] - F.col("window_at")).alias("span_start"), (e["span_end"] - F.col("window_at")).alias("span_end"), e["kind"].alias("kind"), e["text"].alias("text")))
    both = {side: reading(F.col("window"), own, F.col("__from") - F.col("window_at"), F.col("__to") - F.col("window_at"), kind) for side, kind in (("before", "deletion"), ("after", "addition"))}
    return g.select("doc_id", "group_id", "section_id", "span_start", "span_end", "edits", *[c.alias(k) for k, c in both.items()])
