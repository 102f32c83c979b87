"""Mark-up to text: XML documents, or loose HTML, as text with exact element spans.

Spark's XML reader drops the order of mixed content and its XPath functions give no offsets, so the XML parser runs in
mapInArrow over documents; it is the only Python on this path. A document that isn't well-formed keeps the text up
to the fault and says so in error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ruleloom.functions import text as T
from ruleloom.functions import vocabulary as V
from ruleloom.operators.spans import PIECE
from ruleloom.session import written

#: Documents, or rows of a document in chunks, that are built together, and characters that a parser is fed at once.
TOGETHER, FED = 64, 1 << 20
ELEMENT = "struct<seq:int,tag:string,attrs:map<string,string>,ancestors:array<string>,span_start:int,span_end:int,text:string>"


class _Reader:
    """What expat reads as text and spans: which text counts, and where elements open and close in it."""

    def __init__(self) -> None:
        self.size = 0
        self.last = ""
        self.path: tuple[str, ...] = ()
        self.skipping = 0
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.chars

    def keep(self, text: str) -> None:
        raise NotImplementedError

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        raise NotImplementedError

    def closed(self) -> None:
        raise NotImplementedError

    def add(self, text: str) -> None:
        if text:
            self.keep(text)
            self.size += len(text)
            self.last = text[-1]

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        mark = tag == V.FOOTNOTE_MARK and V.FOOTNOTE not in self.path
        if self.skipping or mark or tag in V.SKIPPED_TAGS:
            self.skipping += 1
        self.opened(tag, attrs)
        self.path += (tag,)

    def chars(self, text: str) -> None:
        if not self.skipping:
            self.add(text)

    def end(self, tag: str) -> None:
        self.path = self.path[:-1]
        self.skipping -= self.skipping > 0
        if tag in V.BLOCK_TAGS and self.last != "\n":
            self.add("\n")
        self.closed()


class _Known:
    """Tags, attributes and ancestors of elements as numbers: each is kept once, as few of them differ in many documents."""

    def __init__(self) -> None:
        self.tags: dict[str, int] = {}
        self.attrs: dict[tuple, int] = {(): 0}
        self.paths: dict[tuple[str, ...], int] = {}

    @staticmethod
    def number(known: dict, x) -> int:
        return known.setdefault(x, len(known))

    def columns(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        pairs, paths = list(self.attrs), list(self.paths)
        flat = [p for x in pairs for p in x]
        attrs = pa.MapArray.from_arrays(_offsets(list(map(len, pairs))), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))
        above = pa.ListArray.from_arrays(_offsets(list(map(len, paths))), pa.array([t for x in paths for t in x], pa.string()))
        return pa.array(list(self.tags), pa.string()), attrs, above


class _Projection(_Reader):
    """A whole document: its text, and its elements as columns, in order of their starts; known: as numbers in it."""

    def __init__(self, known: _Known) -> None:
        super().__init__()
        self.known = known
        self.parts: list[str] = []
        self.tags: list[int] = []
        self.attrs: list[int] = []
        self.paths: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.open: list[int] = []
        self.keep = self.parts.append

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        known = self.known
        self.open.append(len(self.tags))
        self.tags.append(known.number(known.tags, tag))
        self.attrs.append(known.number(known.attrs, tuple(attrs.items())) if attrs else 0)
        self.paths.append(known.number(known.paths, self.path))
        self.starts.append(self.size)
        self.ends.append(self.size)

    def closed(self) -> None:
        self.ends[self.open.pop()] = self.size


class _Stream(_Reader):
    """A document that comes in chunks: text is handed on in blocks, elements as they close; what is open is all that stays."""

    def __init__(self, block: int) -> None:
        super().__init__()
        self.block, self.blocks, self.seq = block, 0, 0
        self.parts: list[str] = []
        self.waiting = 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []  # as ROW has them, without doc_id
        self.error: str | None = None

    def keep(self, text: str) -> None:
        self.parts.append(text)
        self.waiting += len(text)
        if self.waiting >= self.block:
            self.cut(self.block)

    def cut(self, least: int) -> None:
        """Hands on all whole blocks, and with least 1 the rest."""
        text, at = "".join(self.parts), 0
        while len(text) - at >= least:
            self.rows.append((self.blocks, text[at : at + self.block], *[None] * 7))
            at += self.block
            self.blocks += 1
        self.parts, self.waiting = [text[at:]], max(0, len(text) - at)

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        self.open.append((self.seq, tag, list(attrs.items()), self.path, self.size))
        self.seq += 1

    def closed(self) -> None:
        self.rows.append((None, None, *self.open.pop(), self.size, None))

    def feed(self, xml: str, last: bool = False) -> None:
        """Chunks may end anywhere between two characters; after a fault the rest of the document is passed over."""
        try:
            for at in range(0, max(1, len(xml)), FED):
                if self.error is None:
                    self.parser.Parse(xml[at : at + FED].encode(), last and at + FED >= len(xml))
        except expat.ExpatError as e:
            self.error = str(e)
            self.parser.buffer_text = False

    def finish(self) -> None:
        """As for a whole document, text up to a fault stays; an element that never closes ends where it starts."""
        self.feed("", last=True)
        self.cut(1)
        for held in self.open:
            self.rows.append((None, None, *held, held[-1], None))
        self.rows.append((*[None] * 8, self.error or ""))


def read_xml(xml: str, known: _Known | None = None) -> tuple[str, _Projection, str | None]:
    p, error = _Projection(known or _Known()), None
    try:
        p.parser.Parse(xml.encode(), True)
    except expat.ExpatError as e:
        error = str(e)
        p.parser.buffer_text = False  # hands on what it holds
    return "".join(p.parts), p, error


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _elements(texts: list[str], found: list[_Projection], known: _Known) -> pa.Array:
    """The elements of each document as one list column, built from flat columns."""

    def flat(name: str) -> pa.Array:
        return pa.array(list(chain.from_iterable(getattr(p, name) for p in found)), pa.int32())

    tags, attrs, above = known.columns()
    columns = {
        "seq": pa.array(list(chain.from_iterable(range(len(p.tags)) for p in found)), pa.int32()),
        "tag": tags.take(flat("tags")),
        "attrs": attrs.take(flat("attrs")),
        "ancestors": above.take(flat("paths")),
        "span_start": flat("starts"),
        "span_end": flat("ends"),
        "text": pa.array([t[a:b] for t, p in zip(texts, found, strict=True) for a, b in zip(p.starts, p.ends, strict=True)], pa.string()),
    }
    return pa.ListArray.from_arrays(_offsets([len(p.tags) for p in found]), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def project(raw: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """doc_id, text, elements, error of each document; a null document gives an empty text.

    Elements carry their own text, so that no later step cuts it out of the document's; nested ones share it, so the
    column has about as many times the document's size as elements nest.
    """
    kind = raw.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text string, elements array<{ELEMENT}>, error string"
    own = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                known = _Known()
                read = [read_xml(xml, known) if xml else ("", _Projection(known), None) for xml in some.column(1).to_pylist()]
                texts, found = [r[0] for r in read], [r[1] for r in read]
                columns = [some.column(0), pa.array(texts, pa.string()), _elements(texts, found, known), pa.array([r[2] for r in read], pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, own, strict=True)], schema=own)

    return raw.select(F.col(id_col).alias("doc_id"), F.col(xml_col).alias("xml")).mapInArrow(run, schema)


def elements(projected: DataFrame, *more: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per element: doc_id, seq, tag, attrs, ancestors, span_start, span_end, text, and more columns of its document.

    fields: those that are wanted, if not all; only they are read, as Spark doesn't look through an explode for several.
    """
    each = F.arrays_zip(*[F.col(f"elements.{f}").alias(f) for f in fields]) if fields else F.col("elements")
    return projected.select("doc_id", *more, F.explode(each).alias("e")).select("doc_id", *more, "e.*")


ROW = "piece int, text string, seq int, tag string, attrs map<string,string>, ancestors array<string>, span_start int, span_end int, error string"


def streamed(rows: Iterator[tuple], block: int) -> Iterator[tuple[object, list[tuple]]]:
    """(doc_id, rows as in ROW) of chunks (doc_id, xml), which come in order, each document's together.

    Memory holds a chunk, a block of text and the elements that are open, whatever the document's size.
    """
    reader, doc = None, None
    for own, xml in rows:
        if reader is None or own != doc:
            if reader is not None:
                reader.finish()
                yield doc, reader.rows
            reader, doc = _Stream(block), own
        reader.feed(xml or "")
        if len(reader.rows) >= TOGETHER:
            yield doc, reader.rows
            reader.rows = []
    if reader is not None:
        reader.finish()
        yield doc, reader.rows


def project_chunks(chunks: DataFrame, order: str = "chunk", block: int = PIECE, store: Callable[[DataFrame, str], DataFrame] = written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents too large for a row: blocks (doc_id, piece, text), elements (as elements() gives them, without their
    text) and faults (doc_id, error, which is empty where there is none). chunks: doc_id, xml, and their order.

    A document is read by one task, as mark-up must be, which hands its parser's state on from chunk to chunk; no row and
    no task ever holds a document. All of block's characters lie in one row, so spans find theirs by division.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {ROW}"
    own = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["doc_id"], r["xml"]) for batch in batches for at in range(0, batch.num_rows, TOGETHER) for r in batch.slice(at, TOGETHER).to_pylist())
        for doc, found in streamed(rows, block):
            columns = zip(*[(doc, *row) for row in found], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own)

    read = chunks.select("doc_id", "xml", order).repartition("doc_id").sortWithinPartitions("doc_id", order).select("doc_id", "xml")
    found = store(read.mapInArrow(run, schema), "chunks")
    blocks, faults = found.where("piece is not null").select("doc_id", "piece", "text"), found.where("error is not null").select("doc_id", "error")
    return blocks, found.where("seq is not null").drop("piece", "text", "error"), faults


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), chunk and xml of XML files of any size: a chunk is a line."""
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("doc_id"), place.alias("chunk"), F.concat("value", F.lit("\n")).alias("xml"))


def block_texts(spans: DataFrame, blocks: DataFrame, by: list[str], block: int = PIECE) -> DataFrame:
    """spans (doc_id, span_start, span_end, ...) with text, put together from the blocks that they touch; by tells the spans
    of a document apart. A block's row is met by the spans in it, so take the spans that are wanted only."""
    last = F.floor(F.greatest(F.col("span_start"), F.col("span_end") - 1) / block).cast("int")
    each = spans.withColumn("piece", F.explode(F.sequence(F.floor(F.col("span_start") / block).cast("int"), last)))
    met = each.join(blocks.withColumnRenamed("text", "__text"), ["doc_id", "piece"], "left")
    shift = F.col("piece") * block
    part = F.coalesce(T.cut("__text", F.col("span_start") - shift, F.col("span_end") - shift), F.lit(""))
    texts = met.groupBy("doc_id", *by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", part.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return spans.join(texts, ["doc_id", *by])


def html_tokens(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Loose HTML as tokens: id, seq, token, is_tag, tag, closing, text_start (characters of text before it)."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit("<[^>]*>|[^<]+"), F.lit(0))
    t = pages.select(F.col(id_col), F.posexplode(found).alias("seq", "token"))
    is_tag = F.col("token").startswith("<")
    t = t.withColumn("is_tag", is_tag).withColumn("tag", F.lower(F.nullif(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1), F.lit(""))))
    t = t.withColumn("closing", F.col("token").startswith("</"))
    before = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("text_start", F.coalesce(F.sum(F.when(~F.col("is_tag"), F.length("token")).otherwise(0)).over(before), F.lit(0)))
