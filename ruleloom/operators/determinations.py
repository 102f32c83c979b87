"""Decision blocks with their references, and the filing deadlines that they set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.citations import located
from ruleloom.operators.spans import asof, with_text


def blocks(sections: DataFrame, doc_text: DataFrame, paragraphs: DataFrame, convention: V.Convention) -> DataFrame:
    """One row per decision block: its section, references, amended references, first paragraph number, and text."""
    leaf = T.trim(F.element_at("heading_path", -1))
    s = with_text(sections.where(T.matches(leaf, convention.determination)), doc_text, F.col("span_start"), F.col("span_end"))
    own = T.cut("window", F.col("span_start") - F.col("window_at"), F.col("span_end") - F.col("window_at"))
    s = s.withColumn("text", own).drop("window", "window_at")
    # the first paragraph from the block's start on, by an as-of join in reverse
    p = paragraphs.select("doc_id", F.struct(F.col("span_start").alias("at"), "number").alias("next"), F.negative("span_start").alias("back"))
    s = asof(s.withColumn("__back", F.negative("span_start")), p, "doc_id", "__back", "back", ["next"]).drop("__back")
    number = F.when(F.col("next.at") < F.col("span_end"), F.col("next.number"))
    refs, amended = F.filter(D.cross_refs(F.col("text")), D.is_provision_ref), F.filter(D.directive_refs(F.col("text")), D.is_provision_ref)
    s = s.withColumn("paragraph_number", number).drop("next")
    return s.withColumns({"all_refs": D.cross_refs(F.col("text")), "cross_refs": refs, "amended_refs": amended, "disposition": F.lit("unclassified")})


def reference_stats(blocks: DataFrame) -> DataFrame:
    """doc_id, blocks, with_refs, coverage (0 without blocks), refs, statutory."""
    return blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(F.size("cross_refs") > 0).alias("with_refs"),
        F.avg((F.size("cross_refs") > 0).cast("int")).alias("coverage"),
        F.sum(F.size("cross_refs")).alias("refs"),
        F.sum(F.size("all_refs") - F.size("cross_refs")).alias("statutory"),
    )


def deadline_sentences(texts: DataFrame, text: str) -> DataFrame:
    """Adds seq, sentence, count, unit and anchor of each sentence of a text by which the agency directs a filing in time."""
    s = texts.select("*", F.posexplode(F.split(F.col(text), T.pattern(r"(?<=\.)[WS]+"))).alias("seq", "__raw"))
    s = s.withColumn("sentence", T.collapse("__raw")).drop("__raw")
    s = s.where(T.matches("sentence", "(?i)compliance filing") & T.matches("sentence", V.DEADLINE_DIRECTIVE) & ~T.matches("sentence", V.DEADLINE_REPORTED))
    s = s.withColumn("count", D.count_of(T.extract("sentence", V.DEADLINE_PERIOD, 1), V.DEADLINE_WORDS)).where("count is not null")
    unit = F.lower(T.extract("sentence", V.DEADLINE_PERIOD, 2))
    return s.withColumns({"unit": F.concat(F.regexp_replace(unit, r"s\z", ""), F.lit("s")), "anchor": D.anchor(F.col("sentence"))})


def deadlines(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, sentence, count, unit, anchor, due_on; a sentence counts once a document, and only if it is found in its block."""
    b = blocks.where(F.exists("heading_path", lambda h: T.matches(h, V.DEADLINE_BLOCK))).select("doc_id", "span_start", F.col("text").alias("block"))
    s = located(deadline_sentences(b, "block"), "block", "sentence").where("result = 'found'")
    one = Window.partitionBy("doc_id", "sentence").orderBy("span_start", "seq")
    s = s.withColumn("__k", F.row_number().over(one)).where("__k = 1").join(meta.select("doc_id", "publication_date", "effective_on"), "doc_id")
    day = F.when(F.col("anchor") == "publication", F.col("publication_date")).when(F.col("anchor") == "effective", F.col("effective_on"))
    return s.select("doc_id", "sentence", "count", "unit", "anchor", D.add_period(day, F.col("count"), F.col("unit")).alias("due_on"))


def described(count, unit, anchor):
    """Such as '90 days from publication'."""
    one = F.when(count == 1, F.regexp_replace(unit, r"s\z", "")).otherwise(unit)
    return F.concat_ws(" ", count.cast("string"), one, F.when(anchor != "unstated", F.concat(F.lit("from "), anchor)))
