"""Documents that come in chunks, against the same documents read whole."""

import random
import resource
import tracemalloc

from pyspark.sql import functions as F

from ruleloom.sources import markup
from tests.test_documents import RICH

ODD = [RICH, None, "", "<RULE><P>cut", "<a>é😀日本</a>", "<RULE><P>one</P></RULE><x/>", "<RULE><P>a &amp; b<![CDATA[ <c> ]]></P><FTNT><P><SU>1</SU> n</P></FTNT>t<SU>1</SU></RULE>", "<RULE>" + "<P>long text goes on</P>" * 500 + "</RULE>"]


def test_chunks_give_what_the_whole_gives(spark):
    """Cut anywhere, in pieces of one character too; chunks arrive in any order; faults, null and empty documents."""
    rng, chunks = random.Random(2), []
    for i, xml in enumerate(ODD):
        at, k = 0, 0
        while at < len(xml or ""):
            n = rng.choice([1, 3, 50, 400])
            chunks.append((i, k, xml[at : at + n]))
            at, k = at + n, k + 1
        if not xml:
            chunks.append((i, 0, xml))
    rng.shuffle(chunks)
    blocks, elements, faults = markup.project_chunks(spark.createDataFrame(chunks, "doc_id int, chunk int, xml string"), block=7)
    whole = markup.project(spark.createDataFrame(list(enumerate(ODD)), "doc_id int, xml string")).persist()
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    got = {i: "" for i in texts}
    for r in blocks.orderBy("doc_id", "piece").collect():
        assert 0 < len(r["text"]) <= 7
        got[r["doc_id"]] += r["text"]
    assert got == texts
    columns = ["doc_id", "seq", "tag", "attrs", "ancestors", "span_start", "span_end"]

    def key(r):
        return (r["doc_id"], r["seq"])

    want = sorted(markup.elements(whole).collect(), key=key)
    assert sorted(elements.select(columns).collect(), key=key) == sorted(markup.elements(whole).select(columns).collect(), key=key)
    own = {key(r): r["text"] for r in markup.block_texts(elements, blocks, ["seq"], 7).collect()}
    assert own == {key(r): r["text"] for r in want}
    assert {r["doc_id"] for r in faults.where("error <> ''").collect()} >= {3, 5}


def test_a_large_document_takes_little_memory():
    """100 MB of mark-up pass through in blocks; neither its text nor its elements pile up."""
    paragraph = "<P>" + "A fee of ten dollars applies to each request. " * 20 + '<E T="03">new</E></P>'
    chunk = paragraph * 100

    def rows():
        yield 1, "<RULE><SUPLINF>"
        for _ in range((100 << 20) // len(chunk)):
            yield 1, chunk
        yield 1, "</SUPLINF></RULE>"

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    tracemalloc.start()
    texts = elements = 0
    for _, found in markup.streamed(rows(), 1 << 16):
        texts += sum(len(r[1]) for r in found if r[0] is not None)
        elements += sum(r[2] is not None for r in found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts > 90 << 20 and elements > 200_000
    assert peak < 16 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10


def test_files_come_in_lines(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RICH)
    (tmp_path / "b.xml").write_text("<RULE>\n<P>two\nlines</P>\n</RULE>\n")
    blocks, elements, _ = markup.project_chunks(markup.read_chunks(spark, str(tmp_path / "*.xml")))
    got = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in blocks.collect()}
    assert got["a.xml"] == markup.read_xml(RICH + "\n")[0] and got["b.xml"] == "\ntwo\nlines\n\n"
    assert elements.where(F.col("doc_id").endswith("b.xml")).count() == 2
