"""Sections, numbered paragraphs, mark-up tables and capabilities of projected documents.

doc_text: doc_id, text. All spans are half-open, in code points of text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.spans import asof, inside, lengths, pattern_spans

LEVELS = range(10)


def headings(elements: DataFrame) -> DataFrame:
    """HD elements with a level and a title: doc_id, seq, title, level, span_start, and text_end where elements have it."""
    h = elements.where("tag = 'HD'").withColumn("level", D.heading_level(F.col("attrs")["SOURCE"])).where("level is not null").withColumn("title", T.collapse("text"))
    return h.where("title <> ''").select("doc_id", "seq", "title", "level", "span_start", *[c for c in elements.columns if c == "text_end"])


def section_tree(headings: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The sections that headings open; ends: doc_id, text_end, unless headings have it.

    A heading's ancestors are, for each smaller level, the last heading of that level unless one of a still smaller
    level came after it; its parent is the last heading of any smaller level. So windows suffice: no recursion and no
    stack. A heading closes all sections of its level or deeper; depth counts open sections; the region turns to
    appendix for good at the first level-1 appendix heading.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what follows is carried backwards, as a frame that opens forwards is read anew for each row
    after = Window.partitionBy("doc_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    own, upper = F.col("level"), LEVELS[:-1]
    h = headings.withColumns({f"__n{k}": F.last(F.when(own <= k, F.col("span_start")), ignorenulls=True).over(after) for k in LEVELS})
    h = h.withColumn("__end", F.coalesce(*[F.when(own == k, F.col(f"__n{k}")) for k in LEVELS])).drop(*[f"__n{k}" for k in LEVELS])
    appendix = (own == 1) & T.matches("title", r"(?i)^Appendix[WS]+[A-Z0-9]")
    h = h.withColumn("__appendix", appendix)
    h = h.withColumns({f"__s{k}": F.last(F.when(own == k, F.col("seq")), ignorenulls=True).over(before) for k in upper} | {"__seen": F.max("__appendix").over(order.rowsBetween(Window.unboundedPreceding, 0))})

    def up(k: int) -> Column:
        """Whether the last heading of level k is an ancestor."""
        above = [F.coalesce(F.col(f"__s{q}") < F.col(f"__s{k}"), F.lit(True)) for q in range(k)]
        return reduce(lambda a, b: a & b, above, F.col(f"__s{k}").isNotNull() & (own > k))

    h = h.withColumn("parent_seq", F.greatest(*[F.when(own > k, F.col(f"__s{k}")) for k in upper]))
    h = h.withColumns({f"__up{k}": up(k) for k in upper}).drop("__appendix", *[f"__s{k}" for k in upper])
    h = h.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "parent_seq").orderBy("seq")))
    h = h.withColumns({f"__x{k}": F.last(F.when(own == k, F.struct("ordinal", "title")), ignorenulls=True).over(before) for k in upper})
    ordinals = [F.when(F.col(f"__up{k}"), F.col(f"__x{k}.ordinal").cast("string")) for k in upper]
    titles = F.array_compact(F.array(*[F.when(F.col(f"__up{k}"), F.col(f"__x{k}.title")) for k in upper], F.col("title")))
    h = h if ends is None else h.join(ends, "doc_id")
    return h.select(
        "doc_id",
        "seq",
        F.concat_ws("/", *ordinals, F.col("ordinal").cast("string")).alias("section_id"),
        F.when(F.col("parent_seq").isNotNull(), F.concat_ws("/", *ordinals)).alias("parent_id"),
        titles.alias("heading_path"),
        sum((F.col(f"__up{k}").cast("int") for k in upper), F.lit(1)).alias("depth"),
        "level",
        F.when(F.col("__seen"), "appendix").otherwise("preamble").alias("region"),
        "span_start",
        F.coalesce("__end", "text_end").alias("span_end"),
    )


def sections(elements: DataFrame, doc_text: DataFrame) -> DataFrame:
    return section_tree(headings(elements), None if "text_end" in elements.columns else lengths(doc_text, "text_end"))


def section_at(points: DataFrame, sections: DataFrame, at: str, take: list[str]) -> DataFrame:
    """points with columns of the innermost section at an offset: that of the last heading before it."""
    return asof(points, sections, "doc_id", at, "span_start", take)


def paragraphs(elements: DataFrame, sections: DataFrame, pattern: str) -> DataFrame:
    """Numbered paragraphs right under the body; from the first number that doesn't rise on they are a separate opinion's."""
    p = elements.where((F.col("tag") == "P") & (F.try_element_at("ancestors", F.lit(-1)) == "SUPLINF"))
    p = p.withColumn("number", T.extract("text", pattern).cast("int")).where("number is not null")
    order = Window.partitionBy("doc_id").orderBy("seq")
    most = F.coalesce(F.max("number").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("__falls", F.col("number") <= most)
    p = p.withColumn("separate", F.max("__falls").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return section_at(p.select("doc_id", "seq", "number", "span_start", "span_end", "separate"), sections, "span_start", ["section_id"])


def completeness(paragraphs: DataFrame) -> DataFrame:
    """Whether body paragraph numbers are exactly 1 to N: doc_id, n, complete."""
    body = paragraphs.where("not separate")
    done = (F.min("number") == 1) & (F.max("number") == F.count("*")) & (F.count_distinct("number") == F.count("*"))
    return body.groupBy("doc_id").agg(F.count("*").alias("n"), done.alias("complete"))


def body_spans(elements: DataFrame, doc_text: DataFrame) -> DataFrame:
    """doc_id, body_start, body_end: the first SUPLINF, else the whole text."""
    body = elements.where("tag = 'SUPLINF'").groupBy("doc_id").agg(F.min_by(F.struct("span_start", "span_end"), "seq").alias("s"))
    out = lengths(doc_text, "n").join(body, "doc_id", "left")
    return out.select("doc_id", F.coalesce("s.span_start", F.lit(0)).alias("body_start"), F.coalesce("s.span_end", "n").alias("body_end"))


def with_body(projected: DataFrame) -> DataFrame:
    """doc_id, text, body_start, body_end of whole documents: as body_spans() has them, from the document's own row."""
    k = F.array_position(F.col("elements.tag"), "SUPLINF").cast("int") - 1  # elements come in order
    start, end = (F.when(k >= 0, F.get(F.col(f"elements.{c}"), k)) for c in ("span_start", "span_end"))
    return projected.select("doc_id", "text", F.coalesce(start, F.lit(0)).alias("body_start"), F.coalesce(end, F.length("text")).alias("body_end"))


def italics(elements: DataFrame, tag: str, attr: str, value: str) -> DataFrame:
    i = elements.where((F.col("tag") == tag) & (F.col("attrs")[attr] == value))
    return i.select("doc_id", "span_start", "span_end", F.array_contains("ancestors", "FTNT").alias("in_footnote"), "text")


def footnotes(elements: DataFrame) -> DataFrame:
    return elements.where("tag = 'FTNT'").select("doc_id", "span_start", "span_end")


def _matcher(pattern: str):
    return lambda name: T.matches(name, pattern)


def with_convention(meta: DataFrame, conventions: tuple[V.Convention, ...] = V.CONVENTIONS) -> DataFrame:
    """Adds convention_id: the first whose agency pattern matches the agency or any agency name, else null."""
    out = F.lit(None).cast("string")
    for c in reversed(conventions):
        fits = T.matches("agency", c.agency) | F.exists("agencies", _matcher(c.agency))
        out = F.when(fits, c.id).otherwise(out)
    return meta.withColumn("convention_id", out)


def capabilities(docs: DataFrame, sections: DataFrame, doc_text: DataFrame, convention: V.Convention) -> DataFrame:
    """doc_id, tier, available, reason. docs: doc_id, convention_id."""
    leaf = T.trim(F.element_at("heading_path", -1))
    found = sections.groupBy("doc_id").agg(F.count_if(T.matches(leaf, convention.determination)).alias("blocks"))
    said = pattern_spans(doc_text, "doc_id", "text", T.pattern(convention.legend)).withColumn("end", F.col("at") + F.length("match"))
    legends = inside(said, sections, "doc_id", "at", "span_start", "span_end", "end").groupBy("doc_id").agg(F.count_if("inside").alias("legends"))
    d = docs.join(found, "doc_id", "left").join(legends, "doc_id", "left").fillna(0, ["blocks", "legends"])
    known = F.col("convention_id") == convention.id
    none = F.lit("no conventions are registered for this agency")
    t2, t3 = F.coalesce(known & (F.col("blocks") > 0), F.lit(False)), F.coalesce(known & (F.col("legends") > 0), F.lit(False))
    unknown = F.col("convention_id").isNull()
    tiers = F.array(
        F.struct(F.lit("T1").alias("tier"), F.lit(True).alias("available"), F.lit("text and structure").alias("reason")),
        F.struct(F.lit("T2").alias("tier"), t2.alias("available"), F.when(unknown, none).when(t2, F.concat(F.col("blocks").cast("string"), F.lit(" decision blocks"))).otherwise("no decision blocks").alias("reason")),
        F.struct(F.lit("T3").alias("tier"), t3.alias("available"), F.when(unknown, none).when(t3, "a legend declares the mark-up").otherwise("no legend declares the mark-up").alias("reason")),
    )
    return d.select("doc_id", F.explode(tiers).alias("t")).select("doc_id", "t.*")


def outline(sections: DataFrame, paragraphs: DataFrame, least: int = V.OUTLINE_CHARS, most: int = V.OUTLINE_ENTRIES) -> DataFrame:
    """Substantive top sections: doc_id, section_id, title, size, children, is_primary (the largest of all that qualify)."""
    first = paragraphs.where("separate").groupBy("doc_id").agg(F.min("span_start").alias("at"))
    stop = section_at(first, sections, "at", ["span_start"]).select("doc_id", F.col("span_start").alias("stop"))
    title, size = F.element_at("heading_path", -1), F.col("span_end") - F.col("span_start")
    top = sections.where("depth = 1 and region = 'preamble'").join(stop, "doc_id", "left").where("stop is null or span_start < stop")
    top = top.where(~D.is_administrative(title) & (size >= least)).select("doc_id", "seq", "section_id", title.alias("title"), size.alias("size"))
    every = Window.partitionBy("doc_id")
    top = top.withColumn("place", F.row_number().over(every.orderBy("seq"))).withColumn("__best", F.max(F.struct("size", F.negative("seq").alias("s"))).over(every))
    kids = sections.where("depth = 2").groupBy("doc_id", F.col("parent_id").alias("section_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "section_id", F.element_at("heading_path", -1).alias("title")))), lambda x: F.struct(x["section_id"].alias("id"), x["title"].alias("title"))).alias("children")
    )
    out = top.where(F.col("place") <= most).join(kids, ["doc_id", "section_id"], "left")
    return out.select("doc_id", "place", "section_id", "title", "size", "children", (F.col("__best.s") == -F.col("seq")).alias("is_primary"))
