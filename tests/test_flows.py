"""Streams that fail and go on, a store that is read through, reports, agreement's examples, source windows."""

import collections
import datetime

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import model as M
from ruleloom.operators import spans as P
from ruleloom.sources import records, sinks
from ruleloom.streaming import stages

EVENTS = "key string, at int, value string"


def follow(spark, path):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    stages.follow_latest(stream, ["key"], F.struct("at", "value"), "value", str(path / "out"), str(path / "progress")).awaitTermination()
    return {r["key"]: (r["value"], r["n"]) for r in stages.current(spark, str(path / "out"), ["key"]).collect()}


def test_stream_goes_on_after_a_stop_and_after_a_failure(spark, tmp_path):
    """Later arrivals may be older; a batch that was written but not committed is run again and counts once."""

    def arrive(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive([("a", 1, "x"), ("b", 5, "y")])
    arrive([("a", 3, "z"), ("b", 4, "old")])
    assert follow(spark, tmp_path) == {"a": ("z", 2), "b": ("y", 2)}
    arrive([("a", 2, "late"), ("c", 1, "new")])
    want = {"a": ("z", 3), "b": ("y", 2), "c": ("new", 1)}
    assert follow(spark, tmp_path) == want
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert follow(spark, tmp_path) == want
    assert follow(spark, tmp_path) == want  # nothing new


def test_ingest_counts_a_batch_once(spark, tmp_path):
    def go():
        stages.ingest(spark, str(tmp_path / "in"), "k int", lambda d: {"twice": d.union(d)}, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / "twice")).count()

    spark.range(5).select(F.col("id").cast("int").alias("k")).write.parquet(str(tmp_path / "in"))
    assert go() == 10
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert go() == 10


def test_store_is_read_through(spark, tmp_path):
    asked = []

    def fetch(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        return keys.where("key <> 'gone'").select("key", F.concat(F.lit('{"name": "new '), "key", F.lit('"}')).alias("value"))

    def read(version, *keys):
        got = records.read_through(spark.createDataFrame([(k,) for k in keys], "key string"), str(tmp_path), version, "name string", fetch)
        return {r["key"]: (r["record"]["name"], r["fetched"]) for r in got.collect()}

    old = [("a", '{"name": "A"}'), ("b", '{"na'), ("c", "null"), ("d", '"text"'), ("e", None), ("f", '{"other": 1}')]
    spark.createDataFrame(old, "key string, value string").write.parquet(f"{tmp_path}/v2/gen=0")
    spark.createDataFrame([("a", '{"name": "half"}')], "key string, value string").write.parquet(f"{tmp_path}/v2/gen=7")
    (tmp_path / "v2" / "gen=7" / "_SUCCESS").unlink()  # a write that never finished
    assert read(2, "a", "b", "c", "d", "e", "f", "g", "gone") == {
        "a": ("A", False), "f": (None, False), **{k: (f"new {k}", True) for k in "bcdeg"},
    }
    assert asked == [["b", "c", "d", "e", "g", "gone"]]
    assert read(2, "a", "b", "g") == {"a": ("A", False), "b": ("new b", False), "g": ("new g", False)} and asked[-1] == []
    assert read(3, "a") == {"a": ("new a", True)} and read(3, "a") == {"a": ("new a", False)}  # another shape, another version
    assert read(9) == {}


def test_disagreements_are_the_first_few(spark):
    rows = [(g, i, f"r{i}", "x", "y" if i % 3 else ("x" if i % 2 else None), f"  a  {i} " + "b" * 80, "c") for g in ("p", "q") for i in range(200)]
    pairs = spark.createDataFrame(rows, "g string, i int, rule_id string, rule_label string, model_label string, before string, after string")
    out = M.disagreements(pairs, "g", "i")
    got = {r["g"]: [(x["rule_id"], x["before"]) for x in r["examples"]] for r in out.collect()}
    want = [(f"r{i}", (f"a {i} " + "b" * 80)[:60]) for i in (1, 2, 4, 5, 7, 8)]
    assert got == {"p": want, "q": want}
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_windows_that_open_at_one_place(spark):
    w = spark.createDataFrame([(1, "abcdef", 0), (1, "abcdefghij", 0)], "k int, text string, window_start int")
    s = spark.createDataFrame([(1, 4, 8, "deletion")], "k int, span_start int, span_end int, kind string")
    got = collections.defaultdict(list)
    for r in P.segments(w, s, "k").orderBy("window_end", "seq").collect():
        got[r["window_end"]].append((r["kind"], r["segment"]))
    assert got == {6: [("unchanged", "abcd"), ("deletion", "ef")], 10: [("unchanged", "abcd"), ("deletion", "efgh"), ("unchanged", "ij")]}


def test_source_windows_meet_pieces(spark):
    text = "".join(chr(97 + i % 26) for i in range(70_000))
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    edits = spark.createDataFrame([("d", 50, 60, "addition")], "doc_id string, span_start int, span_end int, kind string")
    asked = spark.createDataFrame([("d", 40, 55), ("d", 45, 70), ("d", 60_000, 69_990), ("d", 69_990, 70_000), ("d", 69_990, 70_001), ("d", None, 5), ("e", 0, 1)], "doc_id string, start int, end int")
    got = {(r["doc_id"], r["start"], r["end"]): "".join(x["segment"] for x in r["segments"]) if r["segments"] else r["error"] for r in sinks.source_windows(docs, edits, asked, pad=100).collect()}
    assert got["d", 40, 55] == text[:155] and got["d", 45, 70] == text[:170] and got["d", 60_000, 69_990] == text[59_900:] and got["d", 69_990, 70_000] == text[69_890:]
    assert got["d", 69_990, 70_001] == got["e", 0, 1] == "out of bounds"


@pytest.mark.parametrize("sign", ["&", "<", ">", '"', "'"])
def test_reports_escape(spark, sign):
    got = spark.range(1).select(sinks.escaped(F.lit(f"a{sign}b")).alias("x")).first()["x"]
    import html

    assert html.unescape(got) == f"a{sign}b" and got.startswith("a&")


def test_reports_cut_lists_and_fall_back(spark, monkeypatch):
    """Lists are cut with the number of what is left out; a document without changes shows its outline."""
    from types import SimpleNamespace

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    monkeypatch.setattr(sinks.C, "self_check", lambda *a: frame([("x", 0.5)], "doc_id string, rate double"))
    edits = "array<struct<kind:string,text:string>>"
    a = SimpleNamespace(
        docs=frame([("x",), ("y",)], "doc_id string"),
        funnel=frame([("x", 4, 1, 0, 2, 1)], "doc_id string, revisions long, revisions_material long, revisions_clarifying long, revisions_editorial long, revisions_undecided long"),
        briefing=frame([("x", i, f"Section {i} <b>", "money", "material", 1) for i in range(1, 16)], "doc_id string, place int, provision string, category string, priority string, revisions long"),
        blocks=frame([("x",)], "doc_id string"), paragraphs=frame([], "doc_id string, span_start int, span_end int"), doc_text=None, sections=None,
        outline=frame([("y", 1, "Top & more", [("1/1", "Kid")]), ("y", 2, "Next", None)], "doc_id string, place int, title string, children array<struct<id:string,title:string>>"),
        classified=frame([("x", i, "editorial", [("deletion", "a<"), ("addition", "b")], "case-only") for i in range(70)], f"doc_id string, group_id int, materiality string, edits {edits}, rule_id string"),
        capabilities=frame([("x", "T1", True, "fine"), ("y", "T2", False, "none")], "doc_id string, tier string, available boolean, reason string"),
        deadlines=frame([("x", "File it.", 2, "months", "publication", datetime.date(2024, 3, 1)), ("x", "Or this.", 1, "days", "unstated", None)], "doc_id string, sentence string, count int, unit string, anchor string, due_on date"),
    )
    parts = {r["doc_id"]: r for r in sinks.report_parts(a).collect()}
    x, y = parts["x"], parts["y"]
    assert x["provisions"].count("<li>") == 12 and "Money (15)" in x["provisions"] and "<p>3 more</p>" in x["provisions"] and "Section 1 &lt;b&gt;" in x["provisions"]
    assert x["editorial"].count("<li>") == 60 and "<del>a&lt;</del> <ins>b</ins> case-only" in x["editorial"]
    assert x["stats"].startswith("<b>15</b> provisions changed; <b>1</b> determinations; <b>2</b> revisions to review; <b>50.0%</b>")
    assert x["bar"].count("<i ") == 3 and '<i class="editorial" style="flex:2" title="Editorial only: 2 (50.0%)">' in x["bar"]
    assert "<b>Due 2024-03-01</b> File it." in x["deadlines"] and "<b>Due 1 day</b> Or this." in x["deadlines"]
    assert y["provisions"] == "<h2>Outline</h2><ul><li>Top &amp; more<ul><li>Kid</li></ul></li><li>Next<ul></ul></li></ul>" and y["bar"] == "<p>No marked-up edits.</p>" and y["tiers"] == "<li>T2: no (none)</li>"
    html = {r["doc_id"]: r["html"] for r in sinks.reports(a).collect()}
    assert len(html) == 2 and html["x"].startswith("<!doctype html>") and "<script" not in html["x"]


def test_written_tables_and_shared_analyses(spark, tmp_path):
    """A rewritten file makes a new analysis, whatever its time and rows; each session drops its own tables."""
    from ruleloom import session
    from ruleloom.plans import corpus

    other = spark.newSession()
    mine = session.written(other.range(3), "mine")
    made, path = [], str(tmp_path / "t.parquet")

    def get(n):
        other.range(n, n + 5).write.mode("overwrite").parquet(path)
        return corpus.shared(other, str(tmp_path), "x", ("t",), lambda: made.append(n) or n)

    assert [get(1), get(100_000)] == [1, 100_000]
    assert corpus.shared(other, str(tmp_path), "x", ("t",), lambda: 0) == 100_000
    assert mine.count() == 3 and session.drop_written(spark.newSession()) == 0
    assert corpus.drop_shared(other) == 1 and corpus.shared(other, str(tmp_path), "x", ("t",), lambda: 7) == 7
    with pytest.raises(Exception, match="NOT_EXIST|PATH_NOT_FOUND"):
        mine.collect()
