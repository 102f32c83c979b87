"""Joins and groupings over spans: as-of, islands, source segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.session import united


def asof(points: DataFrame, marks: DataFrame, by: str, at: str, start: str, take: list[str]) -> DataFrame:
    """points with the columns take of the last mark of the same by whose start is at or before at.

    One exchange by key: both sides are united and the last mark is carried forward, so no pair is ever formed.
    """
    held = F.struct(*[F.col(c) for c in take])
    kind = marks.select(held.alias("h")).schema["h"].dataType.simpleString()
    left = points.withColumns({"__at": F.col(at), "__mark": F.lit(None).cast(kind), "__kind": F.lit(1)})
    empty = {c: F.lit(None).cast(points.schema[c].dataType) for c in points.columns if c != by}
    right = marks.select(F.col(by), held.alias("__mark"), F.col(start).alias("__at"), F.lit(0).alias("__kind")).withColumns(empty)
    w = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = united(left, right.select(left.columns)).withColumn("__mark", F.last("__mark", ignorenulls=True).over(w))
    return met.where("__kind = 1").select(*points.columns, *[F.col("__mark")[c].alias(c) for c in take])


def inside(points: DataFrame, ranges: DataFrame, by: str, at: str, start: str, end: str, until: str | None = None) -> DataFrame:
    """points with inside: whether some half-open range of the same by holds at, or all from at to until; ranges may overlap.

    A sweep over starts and points in order carries the furthest end so far, so no pair is ever formed.
    """
    left = points.withColumns({"__at": F.col(at), "__end": F.lit(None).cast(ranges.schema[end].dataType), "__kind": F.lit(1)})
    empty = {c: F.lit(None).cast(points.schema[c].dataType) for c in points.columns if c != by}
    right = ranges.select(F.col(by), F.col(start).alias("__at"), F.col(end).alias("__end"), F.lit(0).alias("__kind")).withColumns(empty)
    w = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = united(left, right.select(left.columns)).withColumn("inside", F.coalesce(F.max("__end").over(w) >= (F.col(until) if until else F.col("__at") + 1), F.lit(False)))
    return met.where("__kind = 1").select(*points.columns, "inside")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row: a plain column may be worked out anew wherever it is used."""
    named = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("__once", F.explode(F.array(named))).select("*", "__once.*").drop("__once")


def pattern_pairs(text: Column, pattern: str) -> Column:
    """Each match of a pattern, with the length of the text between it and the one before: array of skip, match."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("match")))


def placed(paired: DataFrame, by: str, pairs: str) -> DataFrame:
    """by, at, match: place (from 0) and text of each of pattern_pairs(), by running lengths."""
    e = paired.select(by, F.posexplode(pairs).alias("k", "p")).select(by, "k", "p.*")
    upto = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.length("match")).over(upto)
    return e.select(by, (end - F.length("match")).cast("int").alias("at"), "match")


def pattern_spans(texts: DataFrame, by: str, text: str, pattern: str) -> DataFrame:
    """by, at, match: place (from 0) and text of each match, by running lengths of the parts between them and the matches."""
    return placed(texts.select(by, pattern_pairs(F.col(text), pattern).alias("pairs")), by, "pairs")


def islands(spans: DataFrame, by: list[str], start: str, end: str, gap: int | Column = 0) -> DataFrame:
    """Adds island: spans that overlap or lie within gap of what came before share a number, from 0."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("__new", F.when(F.col(start) - before <= gap, 0).otherwise(1))
    total = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return fresh.withColumn("island", total.cast("int")).drop("__new")


def merge_spans(spans: DataFrame, by: list[str], start: str, end: str, gap: int | Column = 0) -> DataFrame:
    """The islands' outer spans: by, island, start, end, n."""
    return islands(spans, by, start, end, gap).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


#: Characters from one piece of a text to the next; a piece holds twice as many. Short spans meet small pieces.
SHORT, SMALL, PIECE = 1 << 8, 1 << 11, 1 << 16


def overlaps(windows: DataFrame, spans: DataFrame, by: str, lo: str, hi: str, size: int = SMALL) -> DataFrame:
    """Pairs of windows (lo to hi) and spans (span_start to span_end) of the same by that overlap: all columns of both.

    Both are dealt into buckets by their places, so only neighbours meet; a pair counts in the first bucket they share.
    """

    def dealt(df: DataFrame, a: str, b: str, first: str) -> DataFrame:
        k = F.floor(F.col(a) / size).cast("int")
        return df.withColumn(first, k).withColumn("__k", F.explode(F.sequence(k, F.floor(F.greatest(F.col(a), F.col(b) - 1) / size).cast("int"))))

    met = dealt(windows, lo, hi, "__w").join(dealt(spans, "span_start", "span_end", "__s"), [by, "__k"])
    return met.where((F.col("__k") == F.greatest("__w", "__s")) & (F.col("span_start") < F.col(hi)) & (F.col("span_end") > F.col(lo))).drop("__k", "__w", "__s")


def segments(windows: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """Cuts each window's text at the spans that touch it; the segments joined give the window's text again.

    windows: by, text, window_start; spans: by, span_start, span_end, kind. Result: by, window_start, window_end, seq, kind,
    segment. Windows that open at one place may end at several.
    Spans that end before what is already shown are left out, as each character is shown once.
    """
    w = windows.withColumn("window_end", F.col("window_start") + F.length("text"))
    met = overlaps(w.select(by, "window_start", "window_end").distinct(), spans.select(by, "span_start", "span_end", "kind"), by, "window_start", "window_end")
    touching = met.groupBy(by, "window_start", "window_end").agg(
        F.array_sort(F.collect_list(F.struct("span_start", "span_end", "kind"))).alias("spans")
    )
    kind = "struct<at:int,out:array<struct<kind:string,a:int,b:int>>>"
    empty = F.array().cast("array<struct<span_start:int,span_end:int,kind:string>>")
    full = w.join(touching, [by, "window_start", "window_end"], "left").withColumn("spans", F.coalesce(F.col("spans").cast("array<struct<span_start:int,span_end:int,kind:string>>"), empty))

    def piece(kind_: Column, a: Column, b: Column) -> Column:
        return F.array(F.struct(kind_.alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b")))

    def step(acc: Column, s: Column) -> Column:
        a, b = F.greatest(s["span_start"], F.col("window_start")), F.least(s["span_end"], F.col("window_end"))
        shown = F.concat(acc["out"], piece(F.lit("unchanged"), acc["at"], a), piece(s["kind"], F.greatest(a, acc["at"]), b))
        return F.when(b <= acc["at"], acc).otherwise(F.struct(b.cast("int").alias("at"), shown.alias("out")))

    start = F.struct(F.col("window_start").cast("int").alias("at"), F.array().cast("array<struct<kind:string,a:int,b:int>>").alias("out")).cast(kind)
    done = full.withColumn("__acc", F.aggregate("spans", start, step))
    pieces = F.concat(F.col("__acc.out"), piece(F.lit("unchanged"), F.col("__acc.at"), F.col("window_end")))
    out = done.select(by, "window_start", "window_end", "text", F.posexplode(F.filter(pieces, lambda p: p["b"] > p["a"])).alias("seq", "p"))
    text = F.substring(F.col("text"), F.col("p.a") - F.col("window_start") + 1, F.col("p.b") - F.col("p.a"))
    return out.select(by, "window_start", "window_end", "seq", F.col("p.kind").alias("kind"), text.alias("segment"))


def pieces(doc_text: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """doc_id, __size, __piece, window: overlapping pieces of each text, for each size cut in one pass. Those of size n begin
    at multiples of n and hold twice as much, so a span of up to n characters lies in one. A text of up to two of the
    smallest size is one piece of it; size 0 is the whole text, where it is longer than two of the largest.
    """
    n = F.length("text")

    def cut(size: int) -> Column:
        found = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{0,{2 * size}}})).{{1,{size}}}"), F.lit(1))
        return F.transform(found, lambda x, k: _piece(size, k, x))

    whole = F.when(n > 2 * sizes[-1], F.array(_piece(0, F.lit(0), F.col("text")))).otherwise(F.array().cast(PIECES))
    every = F.when(n <= 2 * sizes[0], F.array(_piece(sizes[0], F.lit(0), F.col("text")))).otherwise(F.concat(*map(cut, sizes), whole))
    return doc_text.select("doc_id", F.explode(every).alias("__p")).select("doc_id", "__p.*")


PIECES = "array<struct<__size:int,__piece:int,window:string>>"


def _piece(size: int, k: Column, text: Column) -> Column:
    return F.struct(F.lit(size).cast("int").alias("__size"), k.cast("int").alias("__piece"), text.alias("window"))


def pieces_of_blocks(blocks: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """As pieces(), of texts that come in blocks (doc_id, piece, text) of the largest size; without whole texts."""
    block = sizes[-1]
    after = blocks.select("doc_id", (F.col("piece") - 1).alias("piece"), F.col("text").alias("__after"))
    held = blocks.join(after, ["doc_id", "piece"], "left").select("doc_id", "piece", F.concat("text", F.coalesce("__after", F.lit(""))).alias("text"))

    def cut(size: int) -> Column:
        if size == block:
            return F.array(_piece(block, F.col("piece"), F.col("text")))
        each = block // size
        found = F.regexp_extract_all(F.substring("text", 1, block + size), F.lit(f"(?s)(?=(.{{0,{2 * size}}})).{{1,{size}}}"), F.lit(1))
        return F.transform(F.slice(found, 1, each), lambda x, k: _piece(size, F.col("piece") * each + k, x))

    return held.select("doc_id", F.explode(F.concat(*map(cut, sizes))).alias("__p")).select("doc_id", "__p.*")


def in_blocks(doc_text: DataFrame) -> bool:
    """Whether texts come in blocks of PIECE characters (doc_id, piece, text), so that none need ever be a row."""
    return "piece" in doc_text.columns


def lengths(doc_text: DataFrame, name: str) -> DataFrame:
    """doc_id and the length of each text, which may come in blocks."""
    if in_blocks(doc_text):
        return doc_text.groupBy("doc_id").agg(F.sum(F.length("text")).cast("int").alias(name))
    return doc_text.select("doc_id", F.length("text").alias(name))


def with_text(spans: DataFrame, doc_text: DataFrame, start: Column, end: Column, sizes: int | tuple[int, ...] = ()) -> DataFrame:
    """spans with window, some of their document's text from window_at on that holds start to end, which lie in the text; an
    empty window where either is null.

    Each span meets one piece, of the smallest size that holds it, so a document of many spans is neither walked from its
    start nor copied for each; only spans that no piece holds meet the whole text. sizes: one, or several in ascending order.
    doc_text may come in blocks; then a span that no piece holds is put together from those that it touches.
    """
    sizes = (sizes,) if isinstance(sizes, int) else sizes or ((SHORT, SMALL, PIECE) if in_blocks(doc_text) else (SMALL, PIECE))
    at = []
    for n in sizes:
        k = F.floor(start / n).cast("int")
        at += [F.when(end <= 2 * n, F.struct(F.lit(n).alias("size"), F.lit(0).alias("piece"))), F.when(end - k * n <= 2 * n, F.struct(F.lit(n).alias("size"), k.alias("piece")))]
    place = F.when(start.isNotNull() & end.isNotNull(), F.coalesce(*at, F.struct(F.lit(0).alias("size"), F.lit(0).alias("piece"))))
    s = spans.withColumn("__p", place).withColumns({"__size": F.col("__p.size"), "__piece": F.col("__p.piece")}).drop("__p")
    s = s.withColumn("window_at", F.coalesce(F.col("__size") * F.col("__piece"), F.lit(0)))
    keys = ["doc_id", "__size", "__piece"]
    if not in_blocks(doc_text):
        return s.join(pieces(doc_text, sizes), keys, "left").withColumn("window", F.coalesce("window", F.lit(""))).drop(*keys[1:])
    near = s.where("__size is null or __size > 0").join(pieces_of_blocks(doc_text, sizes), keys, "left").withColumn("window", F.coalesce("window", F.lit(""))).drop(*keys[1:])
    block, far = sizes[-1], s.where("__size = 0").drop("__size", "__piece", "window_at")
    far = far.withColumns({"__a": F.floor(start / block).cast("int"), "__b": F.floor((end - 1) / block).cast("int")})
    asked = far.select("doc_id", "__a", "__b").distinct().withColumn("piece", F.explode(F.sequence("__a", "__b")))
    texts = asked.join(doc_text, ["doc_id", "piece"]).groupBy("doc_id", "__a", "__b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("window")
    )
    far = far.withColumn("window_at", F.col("__a") * block).join(texts, ["doc_id", "__a", "__b"], "left").withColumn("window", F.coalesce("window", F.lit("")))
    return united(near, far.select(near.columns))


def texts_of(spans: DataFrame, doc_text: DataFrame, sizes: tuple[int, ...] = (SHORT, PIECE)) -> DataFrame:
    """spans (doc_id, span_start, span_end, ...) with the text that they enclose; most are taken to be short."""
    met = with_text(spans, doc_text, F.col("span_start"), F.col("span_end"), sizes)
    own = T.cut("window", F.col("span_start") - F.col("window_at"), F.col("span_end") - F.col("window_at"))
    return met.withColumn("text", own).drop("window", "window_at")


def places(blocks: DataFrame, pattern: str, size: int = PIECE) -> DataFrame:
    """doc_id, at, to of a pattern's matches in texts that come in blocks of that size; matches are as long as a block at most.

    Each block is searched together with the next; matches that begin in the next are left to it.
    """
    both = pieces_of_blocks(blocks, (size,)).select("doc_id", F.col("__piece").alias("piece"), pattern_pairs(F.col("window"), pattern).alias("pairs"))
    e = both.select("doc_id", "piece", F.posexplode("pairs").alias("k", "p")).select("doc_id", "piece", "k", "p.*")
    end = F.sum(F.col("skip") + F.length("match")).over(Window.partitionBy("doc_id", "piece").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("to", end.cast("int")).withColumn("at", F.col("to") - F.length("match"))
    # a match at a later block's very start may lack what is before it, and was found with the block before
    e = e.where((F.col("at") <= size) & ((F.col("at") > 0) | (F.col("piece") == 0)))
    return e.select("doc_id", (F.col("at") + F.col("piece") * size).alias("at"), (F.col("to") + F.col("piece") * size).alias("to"))


def collapse_repeats(rows: DataFrame, by: list[str], key: Column, text: str, seq: str, clip: int = 260) -> DataFrame:
    """Rows with equal keys as one: first text (clipped), number, first place."""
    return rows.groupBy(*by, key.alias("key")).agg(
        F.substring(F.min_by(text, seq), 1, clip).alias("text"), F.count("*").alias("n"), F.min(seq).alias("first_seq")
    )


def pair_edits(edits: DataFrame, by: list[str], seq: str, kind: str, text: str) -> DataFrame:
    """A deletion and the addition right after it as one row, else each alone: by, seq, deletion, addition."""
    w = Window.partitionBy(*by).orderBy(seq)
    e = edits.select(*by, seq, kind, text, F.lead(kind).over(w).alias("__nk"), F.lead(text).over(w).alias("__nt"), F.lag(kind).over(w).alias("__pk"))
    pair = (F.col(kind) == "deletion") & (F.col("__nk") == "addition")
    used = (F.col(kind) == "addition") & (F.col("__pk") == "deletion")
    e = e.where(~F.coalesce(used, F.lit(False)))
    return e.select(
        *by, seq,
        F.when(F.col(kind) == "deletion", F.col(text)).alias("deletion"),
        F.when(F.coalesce(pair, F.lit(False)), F.col("__nt")).when(F.col(kind) == "addition", F.col(text)).alias("addition"),
    )


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
