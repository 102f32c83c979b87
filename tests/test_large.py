"""Steps that must stay cheap where there are many documents, or where no document fits into a row."""

import random

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import vocabulary as V
from ruleloom.operators import citations, redline, rules, spans
from ruleloom.operators import structure as S
from ruleloom.plans import dense_queries, topic_queries
from ruleloom.plans.analysis import Analysis, InBlocks
from ruleloom.session import written
from ruleloom.sources import markup
from tests.test_documents import AGENCY, RICH
from tests.util import SF, one


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_worked_out_once_for_their_text(spark):
    """Whatever gives the spans is in the plan once, not once for each kind of piece."""
    rows = spark.createDataFrame([(1, 0, 4), (1, 2, 9)], "doc_id int, a int, b int")
    asked = rows.withColumn("b", F.col("b") + F.crc32(F.lit("once")) * 0)
    got = spans.with_text(asked, one(spark, doc_id=1, text="some text here"), F.col("a"), F.col("b"))
    assert got._jdf.queryExecution().analyzed().toString().count("crc32") == 1
    assert {r["window"] for r in got.collect()} == {"some text here"}


def test_a_short_text_is_one_piece(spark):
    rows = spans.pieces(spark.createDataFrame([(1, "x" * 4096), (2, "y" * 4097), (3, "")], "doc_id int, text string"), (spans.SMALL, spans.PIECE)).collect()
    assert sorted((r["doc_id"], r["__size"], r["__piece"]) for r in rows) == [(1, 2048, 0), (2, 2048, 0), (2, 2048, 1), (2, 2048, 2), (2, 65536, 0), (3, 2048, 0)]


def test_quotes_beyond_a_short_text_are_clipped(spark):
    cited = spark.createDataFrame([(1, 3, 9000), (1, 20, 30)], "doc_id int, span_start int, span_end int")
    held = spark.createDataFrame([(1, "1", 0, 8)], "doc_id int, section_id string, span_start int, span_end int")
    got = citations.cite(cited, one(spark, doc_id=1, text="abcdefgh"), held)
    assert sorted((r["span_end"], r["quote"], r["section_id"]) for r in got.collect()) == [(30, "", "1"), (9000, "defgh", "1")]


def test_marks_are_searched_once(spark):
    """The legend and the separate statement are each looked for once a document."""
    c = V.CONVENTIONS[0]
    text = "Opens. Deletions are in brackets and additions are in italics. Old [x] text. ROE, Commissioner, concurring: no."
    docs = spark.createDataFrame([(1, text, 0, len(text)), (2, "none", 0, 4)], "doc_id int, text string, body_start int, body_end int")
    found = redline.regions(docs, None, c)
    assert plan(found).count("regexp_instr") == 2
    assert [tuple(r)[:3] for r in found.collect()] == [(1, text.index("Deletions"), text.index("ROE"))]


def test_white_space_is_collapsed_once(spark):
    """A revision's two readings are collapsed once each, and not again for each rule; else only single words are."""
    r = spark.createDataFrame([("a  b", "a b"), ("It is not so", "It is so"), ("The fee\u00a0is", "A  fee is")], "before string, after string")
    got = rules.classified(r.withColumn("edits", F.array(F.struct(F.lit("deletion").alias("kind"), F.lit("x").alias("text")))))
    assert plan(got).count("{2,}|[") == 2 + 4
    assert {x["before"]: x["rule_id"] for x in got.collect()} == {"a  b": "whitespace-only", "It is not so": "negation-change", "The fee\u00a0is": "article-only"}


def tree(levels):
    """Sections by a stack: id, parent's id, depth."""
    stack, kids, out = [], {}, []
    for level in levels:
        while stack and stack[-1][0] >= level:
            stack.pop()
        up = stack[-1][1] if stack else None
        kids[up] = kids.get(up, 0) + 1
        own = f"{up}/{kids[up]}" if up else str(kids[up])
        stack.append((level, own))
        out.append((own, up, len(stack)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_section_tree_is_that_of_a_stack(spark, seed):
    rng = random.Random(seed)
    docs = {d: [rng.choice([0, 1, 2, 3, 5, 9]) for _ in range(40)] for d in range(5)}
    rows = [(d, i, f"T{i}", level, 10 * i, 400) for d, levels in docs.items() for i, level in enumerate(levels)]
    s = S.section_tree(spark.createDataFrame(rows, "doc_id int, seq int, title string, level int, span_start int, text_end int"))
    got = {(r["doc_id"], r["seq"]): r for r in s.collect()}
    for d, levels in docs.items():
        for i, (own, up, depth) in enumerate(tree(levels)):
            r = got[d, i]
            end = next((10 * j for j in range(i + 1, len(levels)) if levels[j] <= levels[i]), 400)
            assert (r["section_id"], r["parent_id"], r["depth"], r["span_end"], r["heading_path"][-1], len(r["heading_path"])) == (own, up, depth, end, f"T{i}", depth)
    assert plan(s).count("lambdafunction") <= 2


def test_documents_of_a_small_table_come_in_many_parts(spark):
    assert topic_queries.documents(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def in_blocks(spark, texts):
    rows = [(d, k, t[k * spans.PIECE : (k + 1) * spans.PIECE]) for d, t in texts.items() for k in range(-(-len(t) // spans.PIECE))]
    return spark.createDataFrame(rows, "doc_id int, piece int, text string")


def test_spans_get_their_text_from_blocks(spark):
    """Short and long ones, across blocks, at the text's end, and longer than any two blocks."""
    rng, n = random.Random(5), 5 * spans.PIECE + 77
    texts = {1: "".join(chr(97 + rng.randrange(26)) for _ in range(n)), 2: "short"}
    asked = [(1, a, min(n, a + rng.choice([0, 3, 500, 5000, 70_000, 200_000]))) for a in (rng.randrange(n) for _ in range(150))]
    asked += [(1, k * spans.PIECE + a, k * spans.PIECE + b) for k in (1, 2) for a, b in ((-1, 1), (-3, 0), (0, 2), (-spans.PIECE, spans.PIECE))] + [(1, 0, n), (1, n - 1, n), (2, 1, 3), (2, 0, 5)]
    got = spans.texts_of(spark.createDataFrame(sorted(set(asked)), "doc_id int, span_start int, span_end int"), in_blocks(spark, texts)).collect()
    assert len(got) == len(set(asked)) and all(r["text"] == texts[r["doc_id"]][r["span_start"] : r["span_end"]] for r in got)


def test_marks_and_brackets_in_blocks(spark):
    """The legend and a statement across the ends of blocks, pairs with ends in two blocks, and what lies outside the region."""
    c, legend = V.CONVENTIONS[0], "Deletions are in brackets and additions are in italics"
    head = "[no] " + "x" * (spans.PIECE - 20) + " " + legend + ". [a] [[b] open [ "
    first = head + "y" * (2 * spans.PIECE - len(head) - 4) + "[far" + "z" * spans.PIECE + "] "
    text = first + " " * (4 * spans.PIECE - len(first) - 6) + "A, ROE, Commissioner, concurring: [late]"
    texts = {1: text, 2: "no legend [x]", 3: legend + " [cut"}
    bodies = spark.createDataFrame([(d, 0, len(t)) for d, t in texts.items()], "doc_id int, body_start int, body_end int")
    whole = redline.regions(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), bodies, c)
    blocks = in_blocks(spark, texts)
    r = redline.regions_in_blocks(blocks, bodies, c)
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, whole.drop("text").collect()))
    start = {x["doc_id"]: x["region_start"] for x in r.collect()}
    got = redline.brackets_in_blocks(blocks, r).collect()
    want = [(x["doc_id"], x["at"] + start[x["doc_id"]], len(x["inner"]) + 2) for x in redline.bracket_spans(whole).collect()]
    assert sorted((x["doc_id"], x["at"], x["to"] - x["at"]) for x in got if x["closed"]) == sorted(want) and len(want) == 3
    assert sum(not x["closed"] for x in got) == 3


def test_analysis_in_blocks_is_that_of_whole_documents(spark):
    long = RICH.replace("<P>Within.</P>", "<P>Within.</P>" + "<P>Filler goes on [so].</P>" * 6000)
    docs = spark.createDataFrame([("rich", RICH), ("long", long)], "doc_id string, xml string")
    meta = docs.select("doc_id", F.lit(AGENCY).alias("agency"), F.array().cast("array<string>").alias("agencies"))
    a = Analysis(meta, written(markup.project(docs), "projected"), store=written)
    blocks, parts, _ = markup.project_chunks(docs.withColumn("chunk", F.lit(0)))
    b = InBlocks(meta, blocks, store=written, parts=parts)
    for name in ("sections", "paragraphs", "edits", "blocks", "classified"):
        x, y = getattr(a, name), getattr(b, name)
        assert sorted(map(str, x.collect())) == sorted(map(str, y.select(x.columns).collect())), name
    d = redline.diagnostics(a.regions, a.italics, S.footnotes(a.own_elements))
    assert sorted(map(str, d.collect())) == sorted(map(str, b.diagnostics.select(d.columns).collect()))


@pytest.mark.parametrize("make", [dense_queries.noticed, dense_queries.orders_book, lambda s, d: dense_queries.ledgers(s, d)[0]])
def test_no_document_of_a_whole_table_is_a_row(spark, make):
    made = make(spark, SF.replace("sf0.001", "sf0.01"))
    held = made.doc_text if isinstance(made, InBlocks) else made
    assert held.agg(F.max(F.length("text"))).first()[0] <= spans.PIECE and held.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1
