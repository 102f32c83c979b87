"""Citations: verification against the source, search for quotations, and the gate that suppresses what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.operators.spans import asof, lengths, with_text
from ruleloom.session import written

DETAIL = 80


def verdict(quote: Column, own: Column, length: Column, start: Column, end: Column, section_start: Column, section_end: Column) -> Column:
    """match (exact, normalized) or the first reason why a citation fails; sections may be null.

    own: what the document of that length holds from start to end.
    """
    same = F.when(own == quote, "exact").when(T.collapse(own) == T.collapse(quote), "normalized")
    reason = (
        F.when(T.is_blank(F.coalesce(quote, F.lit(""))), "empty-quote")
        .when(~in_bounds(length, start, end), "out-of-bounds")
        .when(same.isNull(), "quote-mismatch")
        .when(section_start.isNull(), "section-not-found")
        .when((start < section_start) | (start >= section_end), "outside-section")
    )
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), same).alias("match"), reason.alias("reason"))


def in_bounds(length: Column, start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end <= length) & (end > start), F.lit(False))


def verify(claims: DataFrame, doc_text: DataFrame, sections: DataFrame) -> DataFrame:
    """claims (doc_id, section_id, quote, span_start, span_end, ...) with ok, match and reason.

    A claim meets its document's length and the piece of text that holds its span, so the text isn't repeated for each
    claim, however many there are about one document.
    """
    s = sections.select("doc_id", "section_id", F.col("span_start").alias("__lo"), F.col("span_end").alias("__hi"))
    met = claims.join(lengths(doc_text, "__n"), "doc_id").join(s, ["doc_id", "section_id"], "left")
    start, end = (F.when(in_bounds(F.col("__n"), F.col("span_start"), F.col("span_end")), F.col(c).cast("int")) for c in ("span_start", "span_end"))
    met = with_text(met, doc_text, start, end)
    own = T.cut("window", start - F.col("window_at"), end - F.col("window_at"))
    v = verdict(F.col("quote"), own, F.col("__n"), F.col("span_start"), F.col("span_end"), F.col("__lo"), F.col("__hi"))
    return met.withColumn("__v", v).select(*claims.columns, "__v.*")


def gate(verified: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, passed, suppressed, rate; claims that fail are suppressed, not ranked lower."""
    return verified.groupBy(by).agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("suppressed"), F.avg(F.col("ok").cast("int")).alias("rate"))


def gate_rate(verified: DataFrame) -> DataFrame:
    """One row: passed, total, rate; 1 where there are no claims."""
    return verified.agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.coalesce(F.avg(F.col("ok").cast("int")), F.lit(1.0)).alias("rate"))


def cite(spans: DataFrame, doc_text: DataFrame, sections: DataFrame) -> DataFrame:
    """spans (doc_id, span_start, span_end, ...) with the quote they enclose and the innermost section at their start."""
    met = spans.drop("section_id").join(lengths(doc_text, "__n"), "doc_id", "left")
    start, end = (F.least(F.col(c), F.coalesce("__n", F.lit(0))) for c in ("span_start", "span_end"))
    met = with_text(met, doc_text, start, end)
    met = met.withColumn("quote", T.cut("window", start - F.col("window_at"), end - F.col("window_at"))).drop("window", "window_at", "__n")
    return asof(met, sections, "doc_id", "span_start", "span_start", ["section_id"])


def self_check(spans: DataFrame, doc_text: DataFrame, sections: DataFrame) -> DataFrame:
    """The gate over citations of all spans, such as a document's paragraphs: doc_id, passed, suppressed, rate."""
    return gate(verify(cite(spans, doc_text, sections), doc_text, sections))


def occurrences(text: Column, quote: Column) -> Column:
    """Overlapping occurrences of a literal."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(F.length(quote) > 0, F.regexp_count(text, literal)).otherwise(0)


def locate(quotes: DataFrame, doc_text: DataFrame, on: str = "doc_id", quote: str = "quote") -> DataFrame:
    """quotes with result (found, ambiguous, not-found), match, occurrences, start (from 0, exact matches only) and
    original_start (that of either match, in the text as it is).

    The exact search comes first; only where it finds nothing are both sides normalised. Texts without the quote's
    normal form cost one substring search; occurrences are counted only where there is one.
    """
    met = quotes.join(doc_text.select(on, F.col("text").alias("__text")), on)
    return located(met, "__text", quote).drop("__text")


def locate_within(quotes: DataFrame, doc_text: DataFrame, sections: DataFrame, quote: str = "quote") -> DataFrame:
    """As locate(), only in the section that scope names where it isn't null, with section_id: the innermost at the match.

    quotes: doc_id, scope, quote. A scope that the document lacks has the result section-not-found.
    """
    own = sections.select("doc_id", F.col("section_id").alias("scope"), F.col("span_start").alias("__lo"), F.col("span_end").alias("__hi"))
    met = quotes.join(doc_text.select("doc_id", F.col("text").alias("__text")), "doc_id").join(own, ["doc_id", "scope"], "left")
    lost = F.col("scope").isNotNull() & F.col("__lo").isNull()
    met = met.withColumns({"__lost": lost, "__own": F.when(F.col("__lo").isNull(), F.col("__text")).otherwise(T.cut("__text", F.col("__lo"), F.col("__hi")))}).drop("__text")
    out = located(met, "__own", quote).drop("__own")
    shift = F.coalesce("__lo", F.lit(0))
    clear = {c: F.when(~F.col("__lost"), F.col(c) + shift) for c in ("start", "original_start")}
    clear |= {"match": F.when(~F.col("__lost"), F.col("match")), "occurrences": F.when(F.col("__lost"), 0).otherwise(F.col("occurrences"))}
    out = out.withColumns(clear | {"result": F.when(F.col("__lost"), "section-not-found").otherwise(F.col("result"))}).drop("__lost", "__lo", "__hi")
    return asof(out, sections, "doc_id", "original_start", "span_start", ["section_id"])


def _times(text: Column, quote: Column, at: Column) -> Column:
    """Occurrences of a literal whose first place from 1 is known; a second search tells whether it is the only one."""
    more = F.when(F.call_function("locate", quote, text, at + 1) == 0, 1).otherwise(occurrences(text, quote))
    return F.when(at > 0, more).otherwise(0)


def located(met: DataFrame, text: str, quote: str) -> DataFrame:
    """A null text or quote counts as empty; an empty quote isn't found."""
    met = met.withColumns({"__t": F.coalesce(F.col(text), F.lit("")), "__q": T.trim(F.coalesce(F.col(quote), F.lit("")))})
    met = met.withColumn("__at", F.when(F.col("__q") != "", F.instr(F.col("__t"), F.col("__q"))))
    # each normal form is a column of its own, so it is computed once, and only where the exact search found nothing
    met = met.withColumns({"__normal": F.when(F.col("__at") == 0, T.collapse("__t")), "__want": F.when(F.col("__at") == 0, T.collapse("__q"))})
    met = met.withColumn("__nat", F.instr(F.col("__normal"), F.col("__want")))
    met = met.withColumns({"__exact": _times(F.col("__t"), F.col("__q"), F.col("__at")), "__loose": _times(F.col("__normal"), F.col("__want"), F.col("__nat"))})
    n, first = F.col("__exact") + F.col("__loose"), F.col("__at") - 1
    words = F.replace(F.replace("__want", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(rf"\E{T.WS}+\Q"))
    loose_start = F.regexp_instr("__t", F.concat(F.lit(r"\Q"), words, F.lit(r"\E"))) - 1
    out = {
        "occurrences": n,
        "match": F.when(n == 1, F.when(F.col("__exact") == 1, "exact").otherwise("normalized")),
        "result": F.when(n == 0, "not-found").when(n == 1, "found").otherwise("ambiguous"),
        "start": F.when(F.col("__exact") == 1, first),
        "original_start": F.when(F.col("__exact") == 1, first).when((n == 1), loose_start),
    }
    return met.withColumns(out).drop("__t", "__q", "__at", "__normal", "__want", "__nat", "__exact", "__loose")


#: Words of a window, and characters of one for quotes of fewer than three words.
WINDOW = 3


def _windows(x: Column, w: int) -> Column:
    """Hashes of all w neighbours in an array of strings; each has the places before it folded in."""
    out = F.transform(x, lambda y: F.xxhash64(y))
    for k in range(2, w + 1):  # null where the array ends
        out = F.zip_with(out, F.slice(x, k, 1 << 30), lambda h, y: F.when(h.isNotNull() & y.isNotNull(), F.xxhash64(h, y)))
    return F.filter(out, lambda h: h.isNotNull())


def contained(quotes: DataFrame, docs: DataFrame, quote_id: str, doc_id: str, quote: str = "quote", text: str = "text", normal: bool = False) -> DataFrame:
    """docs with quote_id and quote of each quote that its text holds, for any number of quotes: exactly (trimmed), or, if
    normal, but for white space. Null and blank quotes are in no text.

    Where a text holds a quote, it holds the quote's inner words whole, so also all windows of these (of characters, for
    quotes of one or two words). The texts' windows are listed once; those of quotes are kept and counted, each quote
    takes its rarest as its anchor, and only texts that hold the anchor are searched. Common phrases, such as openings
    that many quotes share, are no anchors unless a quote has no other words.
    """
    form = T.collapse if normal else T.trim
    q = quotes.select(F.col(quote_id).alias("__quote"), form(quote).alias("q"))
    words, chars = F.split("q", f"{T.WS}+"), F.split("q", "")
    inner, n = F.size(words) - 2, F.length("q")
    asked = q.where(n > 0).select("__quote", (inner > 0).alias("by_words"), F.least(F.lit(WINDOW), F.when(inner > 0, inner).otherwise(n)).alias("w"), words.alias("words"), chars.alias("chars"))
    kinds = [(r["by_words"], r["w"]) for r in asked.select("by_words", "w").distinct().collect()]  # at most 2 * WINDOW
    if not kinds:
        return docs.join(quotes.select(quote_id, quote).limit(0), F.lit(False))

    def hashes(x: Column, kind: tuple[bool, int]) -> Column:
        return F.transform(_windows(x, kind[1]), lambda h: F.xxhash64(h, F.lit(kind[0]), F.lit(kind[1])))

    of_quote = F.lit(None).cast("array<bigint>")
    for kind in kinds:
        own = hashes(F.slice("words", 2, F.size("words") - 2), kind) if kind[0] else hashes(F.col("chars"), kind)
        of_quote = F.when((F.col("by_words") == kind[0]) & (F.col("w") == kind[1]), own).otherwise(of_quote)
    keys = written(asked.select("__quote", F.explode(F.array_distinct(of_quote)).alias("h")), "quote-windows")
    body = docs.select(F.col(doc_id).alias("__doc"), (T.collapse(text) if normal else F.col(text)).alias("t"))
    body = body.select("__doc", *[F.split("t", by).alias(name) for by, name in ((f"{T.WS}+", "words"), ("", "chars")) if any(k[0] == (name == "words") for k in kinds)])
    listed = F.array_distinct(F.concat(*[hashes(F.col("words" if k[0] else "chars"), k) for k in kinds]))
    held = written(body.select("__doc", F.explode(listed).alias("h")).join(keys.select("h").distinct(), "h", "left_semi"), "text-windows")
    counts = held.groupBy("h").agg(F.count("*").alias("texts"))
    anchors = keys.join(counts, "h", "left").groupBy("__quote").agg(F.min_by("h", F.struct("texts", "h")).alias("h"), F.count_if(F.col("texts").isNull()).alias("lost"))
    met = written(anchors.where("lost = 0").select("__quote", "h").join(held, "h").select("__doc", "__quote").distinct(), "anchored")
    out = docs.join(met, F.col(doc_id).eqNullSafe(F.col("__doc"))).join(quotes.select(quote_id, quote), F.col(quote_id).eqNullSafe(F.col("__quote")))
    return out.where(F.contains(form(text), form(quote))).drop("__doc", "__quote")


def normal_tokens(texts: DataFrame, by: str, text: str) -> DataFrame:
    """The words of each text with their place in it and in its normal form: by, k, token, at, normal_at.

    Texts are dealt by their key once; places are running sums over their words, so a long text takes linear time.
    """
    t = texts.select(by, text).repartition(by)
    whole, own = (F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in (f"{T.WS}*{T.NON_WS}+", f"{T.NON_WS}+"))
    each = F.zip_with(whole, own, lambda w, o: F.struct(F.length(w).alias("all"), o.alias("token")))
    upto = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = t.select(by, F.posexplode(each).alias("k", "e")).select(by, "k", "e.*")
    e = e.withColumns({"at": F.sum("all").over(upto), "normal_at": F.sum(F.length("token") + 1).over(upto) - 1})
    return e.select(by, "k", "token", *[(F.col(c) - F.length("token")).cast("int").alias(c) for c in ("at", "normal_at")])


def originals(points: DataFrame, tokens: DataFrame, by: str, normal_at: str) -> DataFrame:
    """points with original_at: the place in the text of a place in its normal form (both from 0), a space standing for the
    next word's start; null where the normal form has no such place.

    tokens: as normal_tokens() gives them. Any number of points meets a text's words in one as-of join.
    """
    after = F.lead("at").over(Window.partitionBy(by).orderBy("k"))
    t = tokens.select(by, "normal_at", F.struct("normal_at", "at", F.length("token").alias("n"), after.alias("next")).alias("__token")).withColumnRenamed("normal_at", "__start")
    met = asof(points, t, by, normal_at, "__start", ["__token"])
    within = F.col(normal_at) - F.col("__token.normal_at")
    at = F.when(within < F.col("__token.n"), F.col("__token.at") + within).when(within == F.col("__token.n"), F.col("__token.next"))
    return met.withColumn("original_at", at).drop("__token")


def clipped(quote: Column, most: int = DETAIL) -> Column:
    return F.when(F.length(quote) > most, F.concat(F.substring(quote, 1, most), F.lit("…"))).otherwise(quote)
