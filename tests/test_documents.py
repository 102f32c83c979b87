"""Analyses of small XML documents, with invariants."""

import datetime

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import citations as C
from ruleloom.operators import model as M
from ruleloom.operators import spans as P
from ruleloom.operators import structure as S
from ruleloom.plans.analysis import Analysis
from ruleloom.session import written
from ruleloom.sources import markup, sinks

AGENCY = "DEPARTMENT OF ENERGY Federal Energy Regulatory Commission"
LEGEND = "<NOTE><P>Deletions are in brackets and additions are in italics</P></NOTE>"
RICH = f"""<RULE><PREAMB><HD SOURCE="HED">Notice</HD></PREAMB><SUPLINF><HD SOURCE="HD1">I. Start</HD><P>1. One thin.<SU>3</SU></P>
<FTNT><P><SU>3</SU> A note [kept] <E T="03">so</E>.</P></FTNT><HD SOURCE="HD3">Deep</HD><P>2. Two 😀 here.</P><HD SOURCE="HD2"> </HD><HD SOURCE="HD2">A. Side</HD>
<P>Within.</P><HD SOURCE="HD3">Commission Determination</HD><P>3. We modify section 1.1 now. We require a compliance filing within 1 month of the date of publication.</P>
<HD SOURCE="HD1">Appendix A</HD>{LEGEND}<HD SOURCE="HD2">Section 1.1. Rates</HD><P>You [shall] <E T="03">may</E> pay [[inner]] and [open.</P>
<HD SOURCE="HD2">Section 2. Terms</HD><P>Old <E T="03">see</E><PRTPAGE P="9">page</PRTPAGE> text.</P>
<FP>ROE, Commissioner, concurring:</FP><P>1. A <E T="03">pro forma</E> [aside].</P></SUPLINF></RULE>"""


@pytest.fixture(scope="module")
def a(spark, tmp_path_factory):
    rows = [("rich", RICH, AGENCY), ("other", RICH, "ANOTHER AGENCY"), ("none", None, AGENCY), ("bad", "<RULE><P>cut", AGENCY)]
    df = spark.createDataFrame(rows, "doc_id string, xml string, agency string")
    path = str(tmp_path_factory.mktemp("p") / "projected")
    markup.project(df).write.parquet(path)
    meta = df.select("doc_id", "agency", F.array().cast("array<string>").alias("agencies"), F.lit("final").alias("status"), F.lit(datetime.date(2024, 1, 31)).alias("publication_date"), F.lit(None).cast("date").alias("effective_on"))
    return Analysis(meta, spark.read.parquet(path), store=written)


@pytest.fixture(scope="module")
def lazy(a):
    """The same without written stages: one plan from the projected documents on."""
    return Analysis(a.meta, a.projected)


def got(df, *columns):
    return [tuple(r) for r in df.where("doc_id = 'rich'").select(*columns).collect()]


def test_projection(a):
    text = a.doc_text.where("doc_id = 'rich'").first()["text"]
    assert "One thin.\n" in text and "3 A note" in text and "page" not in text and "\n\n\n" not in text.replace("\n\n", "\n", 1)
    e = a.elements.where("doc_id = 'rich'").collect()
    assert all(text[r["span_start"] : r["span_end"]] == r["text"] for r in e)
    assert a.projected.where("error is not null").select("doc_id").first()[0] == "bad"


def test_sections_close_and_nest(a):
    s = a.sections.orderBy("span_start")
    assert got(s, "section_id", F.array_join("heading_path", " > "), "depth", "region") == [
        ("1", "I. Start", 1, "preamble"), ("1/1", "I. Start > Deep", 2, "preamble"), ("1/2", "I. Start > A. Side", 2, "preamble"),
        ("1/2/1", "I. Start > A. Side > Commission Determination", 3, "preamble"), ("2", "Appendix A", 1, "appendix"),
        ("2/1", "Appendix A > Section 1.1. Rates", 2, "appendix"), ("2/2", "Appendix A > Section 2. Terms", 2, "appendix"),
    ]


def test_paragraphs_and_completeness(a):
    assert sorted(got(a.paragraphs, "number", "separate")) == [(1, False), (1, True), (2, False), (3, False)]
    assert got(S.completeness(a.paragraphs), "n", "complete") == [(3, True)]


def test_unknown_agencies_have_text_only(a):
    c = {(r["doc_id"], r["tier"]): r["available"] for r in a.capabilities.collect()}
    assert c["rich", "T2"] and c["rich", "T3"] and c["other", "T1"] and not c["other", "T2"] and not c["other", "T3"]
    assert a.edits.where("doc_id <> 'rich'").isEmpty() and a.blocks.where("doc_id = 'other'").isEmpty()


def test_edits_stay_in_their_region(a, lazy):
    e = sorted(got(a.edits, "span_start", "kind", "text"))
    assert sorted(got(lazy.edits, "span_start", "kind", "text")) == e and sorted(got(lazy.blocks, "section_id", "paragraph_number")) == sorted(got(a.blocks, "section_id", "paragraph_number"))
    assert [x[1:] for x in e] == [("deletion", "shall"), ("addition", "may"), ("deletion", "inner"), ("addition", "see")]


def test_revisions_conserve_edits(a):
    c = a.classified.where("doc_id = 'rich'").orderBy("group_id").collect()
    assert [(r["rule_id"], len(r["edits"])) for r in c] == [("modal-change", 2), ("none", 1), ("typographic-convention", 1)]
    f = a.funnel.where("doc_id = 'rich'").first()
    assert f["edits"] == sum(f[f"edits_{m}"] for m in ("material", "clarifying", "editorial", "undecided")) == 4
    assert f["revisions"] == sum(f[f"revisions_{m}"] for m in ("material", "clarifying", "editorial", "undecided")) == 3
    assert abs(f["rule_coverage"] - 0.75) < 1e-9


def test_blocks_deadlines_and_cards(a):
    assert got(a.blocks, "amended_refs", "paragraph_number") == [(["1.1"], 3)]
    assert a.deadlines.isEmpty()  # its block isn't under compliance procedures
    assert sorted(got(a.cards, "card_id", "join_kind", "groups", "priority")) == [("d1/2/1", "explicit", [1, 2], "material")]


def test_briefing(a):
    b = got(a.briefing.orderBy("place"), "provision", "category", "priority", "revisions", "decisions")
    assert b == [("Section 1.1. Rates", "obligation", "material", 2, ["1/2/1"])]
    p = a.passages.where("doc_id = 'rich'").first()
    assert "shall" in p["before"] and "shall" not in p["text"] and "may" in p["text"] and len(p["text"]) <= 900


def test_every_paragraph_can_be_cited(a):
    claims = a.paragraphs.join(a.doc_text, "doc_id").select("doc_id", "section_id", F.expr("substring(text, span_start + 1, span_end - span_start)").alias("quote"), "span_start", "span_end")
    v = C.verify(claims, a.doc_text, a.sections)
    assert v.where("not ok").isEmpty() and C.gate_rate(v).first()["rate"] == 1.0
    assert C.gate_rate(v.limit(0)).first()["rate"] == 1.0
    for bad in (F.concat(F.lit("x"), F.expr("substring(quote, 2)")), F.expr("replace(quote, ' ', '')")):
        assert C.verify(claims.withColumn("quote", bad), a.doc_text, a.sections).where("ok").isEmpty()
    loose = claims.withColumn("quote", F.regexp_replace("quote", " ", "  "))
    assert {r["match"] for r in C.verify(loose, a.doc_text, a.sections).collect()} == {"normalized"}


def test_locate(spark):
    docs = spark.createDataFrame([(1, "aa b c aaa"), (2, r"x\Ey x")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "aa"), (1, "b c"), (1, "zz"), (1, " "), (2, r"x\Ey"), (2, "x")], "doc_id int, quote string")
    r = {x["quote"]: (x["result"], x["occurrences"], x["match"], x["start"]) for x in C.locate(q, docs).collect()}
    assert r["aa"] == ("ambiguous", 3, None, None) and r["b c"] == ("found", 1, "normalized", None) and r["zz"][0] == r[" "][0] == "not-found"
    assert r[r"x\Ey"] == ("found", 1, "exact", 0) and r["x"][:2] == ("ambiguous", 2)


def test_segments_give_the_window_again(spark):
    w = spark.createDataFrame([(1, "abcdefghij", 5)], "k int, text string, window_start int")
    s = spark.createDataFrame([(1, 0, 6, "deletion"), (1, 7, 10, "addition"), (1, 8, 9, "deletion"), (1, 9, 12, "deletion"), (1, 14, 99, "addition"), (1, 20, 30, "deletion")], "k int, span_start int, span_end int, kind string")
    out = [(r["kind"], r["segment"]) for r in P.segments(w, s, "k").orderBy("seq").collect()]
    assert out == [("deletion", "a"), ("unchanged", "b"), ("addition", "cde"), ("deletion", "fg"), ("unchanged", "hi"), ("addition", "j")]
    assert "".join(x for _, x in out) == "abcdefghij"


def test_merge_spans(spark):
    def merged(spans, gap):
        df = spark.createDataFrame([(1, a, b) for a, b in spans], "k int, a int, b int")
        return [(r["a"], r["b"]) for r in P.merge_spans(df, ["k"], "a", "b", gap).orderBy("a").collect()]

    assert merged([(0, 10), (5, 20), (30, 40)], 0) == [(0, 20), (30, 40)]
    assert merged([(0, 10), (15, 20)], 5) == [(0, 20)]
    assert merged([(30, 40), (0, 100), (101, 102)], 0) == [(0, 100), (101, 102)]


def test_dispositions_are_checked(spark, a):
    def said(answer):
        rows = [("rich", "1/2/1", answer)] if answer else []
        d = M.dispositions(a.blocks, spark.createDataFrame(rows, "doc_id string, section_id string, answer string")).first()
        return d["disposition"], d["error"], d["confidence"], d["escalated"]

    assert said('{"disposition": "modified", "quote": "We modify section 1.1 now.", "confidence": 0.9}') == ("modified", None, "medium", False)
    assert said('{"disposition": "modified", "quote": "We never said so.", "confidence": 0.9}') == ("modified", "ungrounded", "low", True)
    assert said('{"disposition": "unclear", "quote": "We modify", "confidence": 0.9}') == ("unclassified", "invalid-output", "low", True)
    assert said("not JSON") == ("unclassified", "invalid-output", "low", True)
    assert said(None)[1] == "provider-error"


def test_report_and_source_window(spark, a, tmp_path):
    html = sinks.report(a, "rich")
    assert "Section 1.1. Rates" in html and "<script" not in html
    w = sinks.source_windows(a.doc_text, a.edits, spark.createDataFrame([("rich", 0, 10), ("rich", 5, 5), ("rich", 0, 30000)], "doc_id string, start int, end int"), pad=5)
    rows = sorted((r["start"], r["end"], r["error"] is None) for r in w.collect())
    assert rows == [(0, 10, True), (0, 30000, False), (5, 5, False)]
    sinks.write_results(a, str(tmp_path / "out"))
    assert {r["stage"] for r in spark.read.json(str(tmp_path / "out" / "events")).collect()} >= {"funnel", "briefing"}
