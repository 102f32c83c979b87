import pytest
from pyspark.sql import functions as F

from ruleloom.functions import decisions as D
from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators import rules as R
from ruleloom.operators import spans as P
from ruleloom.operators.briefing import focus


def ask(spark, column, *inputs):
    """The column's value for each input, which is in column x."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.fixture(scope="module", autouse=True)
def _column(spark):
    global X
    X = F.col("x")


def test_white_space_is_that_of_ecmascript(spark):
    spaces = "\t\n\x0b\x0c\r          　﻿"
    assert ask(spark, T.collapse(X), f"{spaces}a{spaces}b{spaces}", "", "\x85a") == ["a b", "", "\x85a"]
    assert ask(spark, T.trim(X), f"{spaces}a b{spaces}", None) == ["a b", None]
    assert ask(spark, T.is_blank(X), spaces, "", " x") == [True, True, False]


def test_cut_clips(spark):
    assert ask(spark, T.cut(X, -3, 2), "abc", "") == ["ab", ""]
    assert ask(spark, T.cut(X, 1, 99), "a😀c") == ["😀c"]
    assert ask(spark, T.cut(X, 2, 1), "abc") == [""]


def test_search_gives_places_from_zero(spark):
    assert ask(spark, T.search(X, "b+"), "abb", "x") == [1, None]


@pytest.mark.parametrize(
    ("action", "kind", "status"),
    [
        ("Order on rehearing.", "Rule", "amended"), ("Order on rehearing.", "Notice", "notice"), ("Notice of proposed rulemaking.", "Rule", "proposed"),
        ("Proposed rule; extension", "Rule", "proposed"), ("Final rule.", "Proposed Rule", "final"), ("Final order.", "Rule", "final"), ("", "Proposed Rule", "proposed"),
        ("Correction", "Rule", "final"), ("Other", "Other", "final"),
    ],
)
def test_document_status(spark, action, kind, status):
    assert ask(spark, D.document_status(X, F.lit(kind)), action) == [status]


def test_provision_refs(spark):
    assert ask(spark, D.is_provision_ref(X), "3.1", "99", "205", "x") == [True, True, False, False]
    assert ask(spark, D.provision_number(X), "Section 3.1.2. Title", "5 Title", "7.", "Appendix", "12") == ["3.1.2", "5", "7", None, None]


def test_directive_and_declining_sentences(spark):
    text = "We modify section 3.1 here. We decline to adopt section 3.2. The existing requirements in section 2.3 stay; accordingly, we revise section 4.5 and section 4.5."
    assert ask(spark, D.directive_refs(X), text) == [["3.1"]]
    assert ask(spark, D.cross_refs(X), text) == [["3.1", "3.2", "2.3", "4.5"]]
    assert ask(spark, D.sentences(X), "In sec. 3.1 a. We b; (c) d: e") == [["In sec. 3.1 a.", "We b;", "(c) d: e"]]


def test_defined_terms(spark):
    text = "The Cluster Study of the Interconnection Customer and A Network Upgrade. Alone."
    assert ask(spark, D.defined_terms(X), text) == [["cluster study of the interconnection customer", "network upgrade"]]


def test_administrative_headings(spark):
    titles = ["IV. Information Collection Statement", "A. Table of Contents", "3) Effective Date", "II. Discussion", "Compliance Procedures"]
    assert ask(spark, D.is_administrative(X), *titles) == [True, True, True, False, True]


@pytest.mark.parametrize(
    ("changed", "title", "category"),
    [
        ("costs and MW", "Section 1. Definitions", "definition"), ("within ten (10) Business Days", "", "deadline"), ("day and year first above written", "", "other"),
        ("system security", "", "other"), ("security deposit", "", "money"), ("at least one", "", "other"), ("at least 3", "", "threshold"), ("X shall mean Y", "", "definition"),
        ("shall not", "", "obligation"), ("will", "", "other"), ("naïve 5 percent", "", "threshold"),
    ],
)
def test_category(spark, changed, title, category):
    assert ask(spark, D.category(X, F.lit(title)), changed) == [category]


def test_confidence_table(spark):
    def level(rule, agree, said, foreign):
        f = [F.lit(v).cast(t) for v, t in ((rule, "boolean"), (agree, "boolean"), (said, "double"), (foreign, "boolean"))]
        return spark.range(1).select(D.confidence(*f).alias("c")).first()["c"]

    assert tuple(level(False, None, 0.9, True)) == ("low", True)
    assert tuple(level(True, False, None, False)) == ("low", True)
    assert tuple(level(True, None, None, None)) == ("high", False)
    assert tuple(level(False, True, 0.1, False)) == ("high", False)
    assert tuple(level(False, None, 0.69, False)) == ("low", True)
    assert tuple(level(False, None, None, False)) == ("medium", False)


@pytest.mark.parametrize(
    ("day", "count", "unit", "due"),
    [("2024-01-31", 1, "months", "2024-03-02"), ("2023-01-31", 1, "months", "2023-03-03"), ("2024-02-29", 1, "years", "2025-03-01"), ("2023-09-06", 90, "days", "2023-12-05"), ("2024-06-11", 12, "months", "2025-06-11")],
)
def test_periods_run_over(spark, day, count, unit, due):
    assert str(ask(spark, D.add_period(X.cast("date"), F.lit(count), F.lit(unit)), day)[0]) == due


def test_counts_in_words(spark):
    assert ask(spark, D.count_of(X, V.DEADLINE_WORDS), "Ninety", "15", "one hundred eighty", "umpteen") == [90, 15, 180, None]


def test_json_salvage(spark):
    k = F.try_variant_get(D.json_salvage(X), "$.k", "int")
    assert ask(spark, k, '{"k": 1}', 'x ```json\n{"k": 2}\n``` y', 'so {"k": 3}!', "none", "{broken", None) == [1, 2, 3, None, None, None]


def test_resolve_input(spark):
    got = ask(spark, D.resolve_input(X), "https://www.federalregister.gov/documents/2024/04/16/2024-06563/x", "2024-06563", " rm22-14 ", "https://example.org/2024-06563", "", "what is this?", None)
    assert [(g["kind"], g["value"]) for g in got] == [("document", "2024-06563"), ("document", "2024-06563"), ("docket", "RM22-14"), (None, None), (None, None), (None, None), (None, None)]
    assert [g["error"] is None for g in got] == [True, True, True, False, False, False, False]


@pytest.mark.parametrize(
    ("before", "after", "added", "rule"),
    [
        ("a  b", "a b", ["x"], "whitespace-only"), ("The Customer", "the customer", ["x"], "case-only"), ("in a week", "in the week", ["x"], "article-only"),
        ("words ", "words i.e.", ["i.e."], "typographic-convention"), ("see section 9.6 x", "see section 9. 7 x", ["7"], "cross-reference-renumber"),
        ("may ship", "may not ship", ["not"], "negation-change"), ("non-profit", "profit", ["x"], "negation-change"), ("shall pay", "may pay", ["may"], "modal-change"),
        ("pay $10", "pay $15", ["15"], "numeric-change"), ("ten days", "ten (10) days", ["(10)"], "none"), ("25 percent", "twenty-five percent", ["x"], "none"),
        ("exceeding 5 MW", "exceeding fifteen MW", ["x"], "numeric-change"), ("rapid", "quick", ["quick"], "none"),
    ],
)
def test_rules(spark, before, after, added, rule):
    edits = F.array(*[F.struct(F.lit("addition").alias("kind"), F.lit(a).alias("text")) for a in added])
    assert spark.range(1).select(R.rule_of(F.lit(before), F.lit(after), edits).alias("r")).first()["r"] == rule


def test_numeric_values(spark):
    assert ask(spark, R.numeric_values(X), "twenty-five of $1,250.50, 25 and 1.2.3", "none") == [[1.2, 3.0, 25.0, 1250.5], []]


def test_focus(spark):
    long = "First one. " + "w " * 300 + "end. The signal is here" + " x" * 600
    at = long.index("signal")
    text = ask(spark, focus(X, F.lit(at)), long)[0]
    assert text["text"].startswith("The signal is here") and len(text["text"]) == 900 and text["clipped_start"] and text["clipped_end"]
    assert tuple(ask(spark, focus(X, F.lit(None)), "short")[0]) == ("short", False, False)


def test_text_of_spans_from_pieces(spark):
    """Whatever the pieces' size, a span gets the text that its document has there."""
    texts = {1: "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(57)), 2: "short", 3: "x" * 20}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    rows = [(i, a, b) for i, t in texts.items() for a in range(0, len(t) + 1, 3) for b in (a, a + 1, a + 9, len(t)) if a <= b <= len(t)]
    spans = spark.createDataFrame(rows, "doc_id int, a int, b int")
    for size in (5, 20, 1 << 16):
        out = P.with_text(spans, docs, F.col("a"), F.col("b"), size).collect()
        assert len(out) == len(rows) and all(r["window"][r["a"] - r["window_at"] : r["b"] - r["window_at"]] == texts[r["doc_id"]][r["a"] : r["b"]] for r in out)
