"""Operators that must stay linear where a document holds much of one thing, against plain walks."""

import random

import pytest

from ruleloom.operators import cards, citations, spans
from tests.util import one


def walk(order, sure, scored):
    """Decisions in order, one after another; sure and scored: by decision."""
    claimed, out = set(), set()
    for d in order:
        if sure.get(d):
            mine, kind = sure[d], "explicit"
        else:
            free = [(-s, g) for g, s in scored.get(d, {}).items() if g not in claimed]
            mine, kind = [g for _, g in sorted(free)[:6]], "implicit"
        claimed.update(mine)
        out |= {(d, g, kind) for g in mine}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_in_rounds(spark, seed):
    """Ties, more than six candidates, explicit links between, decisions at one place, and a chain as long as the document."""
    rng = random.Random(seed)
    blocks, explicit, scores, want = [], [], [], set()
    for doc in range(6):
        order = [f"d{i:02}" for i in range(25)]
        sure = {d: rng.sample(range(40), rng.randint(1, 3)) for d in order if rng.random() < 0.2}
        scored = {d: {g: rng.choice([0.4, 0.5, 1.0]) for g in rng.sample(range(40), rng.randint(0, 15))} for d in order}
        if doc == 5:
            sure, scored = {}, {d: {i: 1.0, i + 1: 0.5} for i, d in enumerate(order)}
        blocks += [(doc, d, i // 2) for i, d in enumerate(order)]
        explicit += [(doc, d, g) for d, gs in sure.items() for g in gs]
        scores += [(doc, d, g, s) for d, gs in scored.items() for g, s in gs.items()]
        want |= {(doc, *x) for x in walk(order, sure, scored)}
    got = cards.links(
        spark.createDataFrame(blocks, "doc_id int, section_id string, span_start int"), spark.createDataFrame(explicit, "doc_id int, det_id string, group_id int"),
        spark.createDataFrame(scores, "doc_id int, det_id string, group_id int, score double"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_claims_without_decisions(spark):
    empty = [spark.createDataFrame([], s) for s in ("doc_id int, section_id string, span_start int", "doc_id int, det_id string, group_id int", "doc_id int, det_id string, group_id int, score double")]
    assert cards.links(*empty).count() == 0


def test_inside_overlapping_ranges(spark):
    rng = random.Random(4)
    points = [(d, rng.randint(0, 100), i) for d in range(4) for i in range(60)]
    ranges = [(d, a, a + rng.randint(0, 12)) for d in range(3) for a in (rng.randint(0, 100) for _ in range(12))]
    got = spans.inside(spark.createDataFrame(points, "k int, at int, i int"), spark.createDataFrame(ranges, "k int, a int, b int"), "k", "at", "a", "b")
    assert {tuple(r) for r in got.collect()} == {(k, at, i, any(k == d and a <= at < b for d, a, b in ranges)) for k, at, i in points}
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_overlaps_in_buckets(spark):
    """Each pair once, whatever buckets it touches; empty windows and spans as the comparison has them."""
    rng = random.Random(8)

    def some(n, longest):
        return [(d, i, a, a + rng.randint(0, longest)) for d in range(3) for i, a in enumerate(rng.randint(0, 200) for _ in range(n))]

    windows, ranges = some(25, 60), some(40, 30)
    got = spans.overlaps(spark.createDataFrame(windows, "k int, w int, lo int, hi int"), spark.createDataFrame(ranges, "k int, s int, span_start int, span_end int"), "k", "lo", "hi", size=16)
    rows = [(r["k"], r["w"], r["s"]) for r in got.collect()]
    want = {(d, w, s) for d, w, lo, hi in windows for e, s, a, b in ranges if d == e and a < hi and b > lo}
    assert set(rows) == want and len(rows) == len(want)


def test_spans_meet_the_smallest_piece_that_holds_them(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(1000))
    asked = [(1, a, b) for a, b in ((0, 3), (5, 30), (39, 41), (100, 300), (0, 1000), (990, 1000), (999, 2000), (1200, 1300), (30, 5000))]
    from pyspark.sql import functions as F

    from ruleloom.functions import text as T

    got = spans.with_text(spark.createDataFrame(asked, "doc_id int, a int, b int"), one(spark, doc_id=1, text=text), F.col("a"), F.col("b"), sizes=(20, 150))
    got = got.select("a", "b", T.cut("window", F.col("a") - F.col("window_at"), F.col("b") - F.col("window_at")).alias("own"), F.length("window").alias("n"))
    rows = {(r["a"], r["b"]): (r["own"], r["n"]) for r in got.collect()}
    assert {k: v[0] for k, v in rows.items()} == {(a, b): text[a:b] for _, a, b in asked}
    assert rows[5, 30][1] == 40 and rows[100, 300][1] == 300


def test_verify_joins_no_whole_text(spark):
    text, n = "x" * 200_000 + "The fee  applies." + "y" * 1000, 200_000
    claims = [("1", "The fee applies.", n, n + 17), ("1", "The fee  applies.", n, n + 17), ("1", "another", n, n + 17), ("2", "The fee  applies.", n, n + 17), ("9", "The fee  applies.", n, n + 17), ("1", " ", n, n + 17), ("1", "x", 5, 300_000), ("1", "x", None, 3), ("1", text, 0, len(text))]
    c = spark.createDataFrame([(7, *x) for x in claims], "doc_id int, section_id string, quote string, span_start int, span_end int")
    s = spark.createDataFrame([(7, "1", 0, len(text)), (7, "2", 0, 10)], "doc_id int, section_id string, span_start int, span_end int")
    got = {(r["section_id"], r["quote"][:20], r["span_start"]): r["match"] or r["reason"] for r in citations.verify(c, one(spark, doc_id=7, text=text), s).collect()}
    assert got == {
        ("1", "The fee applies.", n): "normalized", ("1", "The fee  applies.", n): "exact", ("1", "another", n): "quote-mismatch", ("2", "The fee  applies.", n): "outside-section",
        ("9", "The fee  applies.", n): "section-not-found", ("1", " ", n): "empty-quote", ("1", "x", 5): "out-of-bounds", ("1", "x", None): "out-of-bounds", ("1", text[:20], 0): "exact",
    }


WORDS = ["fee", "rate", "the", "of", "a", "é", "tariff", "\\E", "x.y", "(z"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", " ", "\n\t", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def collapse(t):
    return " ".join(t.split())


@pytest.mark.parametrize("normal", [False, True])
def test_quotes_in_a_corpus(spark, normal):
    """Quotes of one word or many, doubled spaces, common openings, Unicode's white space, none and blank ones."""
    rng, docs = random.Random(9), [*odd_texts(60, 1), None, ""]
    quotes = ["the fee of", "fee", "e", "of  a", " ", "", None, "never said here at all", "the rate of a tariff"]
    for t in docs[:40]:
        a = rng.randint(0, len(t))
        quotes.append(t[a : a + rng.randint(1, 40)])
        quotes.append(collapse(t[a : a + 25]).replace(" ", "  "))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    form = collapse if normal else str.strip
    want = {(i, j) for i, t in enumerate(docs) if t is not None for j, x in enumerate(quotes) if x and form(x) and form(x) in form(t)}
    rows = [(r["doc_id"], r["quote_id"]) for r in citations.contained(q, d, "quote_id", "doc_id", normal=normal).collect()]
    assert set(rows) == want and len(rows) == len(want) > 100


def test_located_positions(spark):
    docs = odd_texts(40, 6)
    rng, pairs = random.Random(3), []
    for t in docs:
        a = rng.randint(0, len(t))
        x = t[a : a + rng.randint(1, 30)]
        pairs += [(t, x), (t, collapse(x)), (t, collapse(x).replace(" ", " \n ")), (t, "aa")]
    pairs += [(None, "x"), ("x", None), ("aaa", "aa"), ("a  aa  a", "a a")]
    met = citations.located(spark.createDataFrame(pairs, "text string, quote string"), "text", "quote")
    for r in met.collect():
        t, q = r["text"] or "", (r["quote"] or "").strip()
        hay, need = (t, q) if q in t else (collapse(t), collapse(q))
        n = sum(hay.startswith(need, i) for i in range(len(hay))) if q else 0
        assert (r["occurrences"], r["result"]) == (n, "not-found" if n == 0 else "found" if n == 1 else "ambiguous")
        if n == 1:
            assert r["match"] == ("exact" if q in t else "normalized")
            rest = t[r["original_start"] :]
            assert (rest if q in t else collapse(rest)).startswith(need) and not rest[0].isspace()


def test_places_in_normal_form(spark):
    docs = [*odd_texts(20, 8), "", "  ", "plain"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    points = spark.createDataFrame([(i, p) for i, t in enumerate(docs) for p in range(len(collapse(t)) + 2)], "doc_id int, p int")
    got = citations.originals(points, citations.normal_tokens(d, "doc_id", "text"), "doc_id", "p")
    for r in got.collect():
        t = docs[r["doc_id"]]
        c = collapse(t)
        if r["p"] >= len(c):
            assert r["original_at"] is None
        else:
            at = r["p"] + (c[r["p"]] == " ")
            assert t[r["original_at"]] == c[at] and len("".join(t[: r["original_at"]].split())) == len(c[:at].replace(" ", ""))
