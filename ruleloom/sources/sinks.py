"""Outputs: tables with stage events, source windows, and a self-contained report of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators import briefing as B
from ruleloom.operators import citations as C
from ruleloom.operators import determinations as G
from ruleloom.operators import spans as P
from ruleloom.plans.analysis import Analysis
from ruleloom.session import united

# Limits of outputs.
WINDOW_CHARS, PAD_CHARS, PAD = 20_000, 2000, 400
PER_CATEGORY, EDITORIAL, CLIP = 12, 60, 260


def result_rows(table: DataFrame) -> DataFrame:
    """One JSON line per row."""
    return table.select(F.to_json(F.struct("*")).alias("value"))


def write_results(a: Analysis, path: str) -> None:
    """Writes the analysis's tables as JSON lines, and one event per table."""
    events = None
    for name in ("capabilities", "funnel", "briefing", "deadlines"):
        table = getattr(a, name)
        result_rows(table).write.mode("overwrite").text(f"{path}/{name}")
        done = table.sparkSession.read.text(f"{path}/{name}").agg(F.count("*").cast("string").alias("detail")).select(F.lit(name).alias("stage"), "detail", F.lit(True).alias("done"))
        events = done if events is None else events.unionByName(done)
    result_rows(events).coalesce(1).write.mode("overwrite").text(f"{path}/events")


def source_windows(doc_text: DataFrame, edits: DataFrame, asked: DataFrame, pad: int = PAD) -> DataFrame:
    """asked (doc_id, start, end) with the source around it, cut at edits, or with the error of a bad request.

    Requests meet their document's length and a piece of its text, never the whole.
    """
    pad = min(pad, PAD_CHARS)
    error = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "end must lie after start").when(F.col("end") - F.col("start") > WINDOW_CHARS, "the span is too long")
    met = asked.withColumn("error", error).join(doc_text.select("doc_id", F.length("text").alias("length")), "doc_id", "left")
    met = met.withColumn("error", F.coalesce("error", F.when(F.col("length").isNull() | (F.col("end") > F.col("length")), "out of bounds")))
    at = F.greatest(F.lit(0), F.col("start") - pad)
    good = P.with_text(met.where("error is null").withColumn("window_start", at), doc_text, F.col("window_start"), F.least(F.col("end") + pad, F.col("length")))
    own = T.cut("window", F.col("window_start") - F.col("window_at"), F.col("end") + pad - F.col("window_at"))
    good = good.select("doc_id", "start", "end", "window_start", own.alias("text")).withColumn("window_end", F.col("window_start") + F.length("text"))
    cut = P.segments(good.select("doc_id", "text", "window_start").distinct(), edits.select("doc_id", "span_start", "span_end", "kind"), "doc_id")
    cut = cut.groupBy("doc_id", "window_start", "window_end").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "segment"))).alias("segments"))
    shown = good.drop("text").join(cut, ["doc_id", "window_start", "window_end"], "left").withColumn("error", F.lit(None).cast("string"))
    bad = met.where("error is not null").select("doc_id", "start", "end", F.lit(None).cast(shown.schema["segments"].dataType).alias("segments"), "error")
    return united(shown.select(bad.columns), bad)


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _joined(order: list[str], html: Column) -> Column:
    """An aggregate: a group's pieces of HTML in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, html.alias("html")))), lambda x: x["html"]), "")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def funnel_bar(funnel: DataFrame) -> DataFrame:
    """doc_id, bar: the revisions' materialities as segments of one bar, without empty ones."""
    segments = [
        F.when(n > 0, _text(f'<i class="{m}" style="flex:', n, f'" title="{V.LABELS["materiality"][m]}: ', n, " (", F.format_number(100 * n / F.col("revisions"), 1), '%)"></i>')).otherwise("")
        for m, n in ((m, F.col(f"revisions_{m}")) for m in V.MATERIALITIES)
    ]
    return funnel.select("doc_id", _text('<div class="bar">', *segments, "</div>").alias("bar"))


def report_parts(a: Analysis) -> DataFrame:
    """One row a document: doc_id, stats, bar, tiers, deadlines, provisions, editorial, all of them HTML.

    A category lists its first PER_CATEGORY entries and says how many there are; without any entry the document's outline
    takes their place. Editorial revisions are listed up to EDITORIAL. Every list is cut before it is gathered.
    """
    f = a.funnel
    review = F.coalesce(F.col("revisions_material") + F.col("revisions_undecided"), F.lit(0))
    cited = C.self_check(a.paragraphs.select("doc_id", "span_start", "span_end"), a.doc_text, a.sections).select("doc_id", "rate")
    counts = a.docs.select("doc_id").join(a.briefing.groupBy("doc_id").agg(F.count("*").alias("entries")), "doc_id", "left")
    counts = counts.join(a.blocks.groupBy("doc_id").agg(F.count("*").alias("decisions")), "doc_id", "left").join(cited, "doc_id", "left").join(f, "doc_id", "left")
    rate = F.format_number(100 * F.coalesce("rate", F.lit(1.0)), 1)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("entries", "decisions")}
    figures = ((zero["entries"], "provisions changed"), (zero["decisions"], "determinations"), (review, "revisions to review"), (_text(rate, "%"), "citations verified"))
    stats = counts.select("doc_id", _text(*[x for n, name in figures for x in ("<b>", n, f"</b> {name}; ")]).alias("stats"))

    item = _text("<li>", escaped(F.col("provision")), ": ", D.label("priority", F.col("priority")), ", ", F.col("revisions"), " revisions</li>")
    listed = P.top_per_group(a.briefing.select("doc_id", "category", F.col("place").alias("rank"), item.alias("item")), ["doc_id", "category"], [F.col("rank")], PER_CATEGORY)
    per = listed.groupBy("doc_id", "category").agg(_joined(["rank"], F.col("item")).alias("items"), F.count("*").alias("shown")).join(B.by_category(a.briefing), ["doc_id", "category"])
    more = F.when(F.col("entries") > F.col("shown"), _text("<p>", F.col("entries") - F.col("shown"), " more</p>")).otherwise("")
    section = _text("<h2>", F.initcap("category"), " (", F.col("entries"), ")</h2><ul>", F.col("items"), "</ul>", more)
    changed = per.withColumn("rank", D.category_rank(F.col("category"))).groupBy("doc_id").agg(_joined(["rank"], section).alias("changed"))
    kids = F.array_join(F.transform("children", lambda c: _text("<li>", escaped(c["title"]), "</li>")), "")
    top = _text("<li>", escaped(F.col("title")), "<ul>", F.coalesce(kids, F.lit("")), "</ul></li>")
    outline = a.outline.groupBy("doc_id").agg(_joined(["place"], top).alias("outline"))

    marks = F.transform("edits", lambda e: F.when(e["kind"] == "deletion", _text("<del>", escaped(e["text"]), "</del>")).otherwise(_text("<ins>", escaped(e["text"]), "</ins>")))
    edited = a.classified.where("materiality = 'editorial'").select("doc_id", "group_id", _text("<li>", F.array_join(marks, " "), " ", F.col("rule_id"), "</li>").alias("item"))
    editorial = P.top_per_group(edited, ["doc_id"], [F.col("group_id")], EDITORIAL).groupBy("doc_id").agg(_joined(["group_id"], F.col("item")).alias("editorial"))
    tier = _text("<li>", F.col("tier"), F.when(F.col("available"), ": yes (").otherwise(": no ("), escaped(F.col("reason")), ")</li>")
    tiers = a.capabilities.groupBy("doc_id").agg(_joined(["tier"], tier).alias("tiers"))
    due = _text("<p><b>Due ", F.coalesce(F.col("due_on").cast("string"), G.described(F.col("count"), F.col("unit"), F.col("anchor"))), "</b> ", escaped(F.substring("sentence", 1, CLIP)), "</p>")
    deadlines = a.deadlines.groupBy("doc_id").agg(_joined(["sentence"], due).alias("deadlines"))
    out = stats
    for part in (funnel_bar(f), tiers, deadlines, changed, outline, editorial):
        out = out.join(part, "doc_id", "left")
    fallback = F.when(F.col("outline").isNotNull(), _text("<h2>Outline</h2><ul>", F.col("outline"), "</ul>")).otherwise("<p>No provision changed.</p>")
    return out.select(
        "doc_id", "stats", F.coalesce("bar", F.lit("<p>No marked-up edits.</p>")).alias("bar"), F.coalesce("tiers", F.lit("")).alias("tiers"),
        F.coalesce("deadlines", F.lit("")).alias("deadlines"), F.coalesce("changed", fallback).alias("provisions"), F.coalesce("editorial", F.lit("")).alias("editorial"),
    )


def reports(a: Analysis) -> DataFrame:
    """doc_id, html: a self-contained report of each document, written by the executors."""
    title = escaped(F.col("doc_id").cast("string"))
    page = _text(
        "<!doctype html><meta charset='utf-8'><title>", title, "</title><h1>", title, "</h1>", F.col("deadlines"), "<p>", F.col("stats"), "</p>", F.col("bar"), "<ul>", F.col("tiers"), "</ul>",
        F.col("provisions"), "<h2>Editorial</h2><ul>", F.col("editorial"), "</ul>",
    )
    return report_parts(a).select("doc_id", page.alias("html"))


def report(a: Analysis, doc: str) -> str:
    return reports(a).where(F.col("doc_id") == doc).first()["html"]


def summary(a: Analysis) -> DataFrame:
    """One row per document with what a text summary would say."""
    tiers = a.capabilities.where("available").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("tier")), " ").alias("tiers"))
    n = a.blocks.groupBy("doc_id").agg(F.count("*").alias("decisions"))
    return a.docs.select("doc_id", "status").join(tiers, "doc_id", "left").join(n, "doc_id", "left").join(a.funnel, "doc_id", "left").fillna(0)
