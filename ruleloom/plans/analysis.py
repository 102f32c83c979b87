"""The whole analysis of many documents as one set of lazy tables, keyed by doc_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import vocabulary as V
from ruleloom.operators import briefing as B
from ruleloom.operators import cards as C
from ruleloom.operators import determinations as G
from ruleloom.operators import redline as E
from ruleloom.operators import rules as R
from ruleloom.operators import structure as S
from ruleloom.operators.spans import texts_of
from ruleloom.sources import markup


@dataclass
class Analysis:
    """meta: as records.meta() gives it; projected: as markup.project() gives it (best a written table).

    store, such as session.written, keeps the steps that several others read; without it all is one lazy plan.
    """

    meta: DataFrame
    projected: DataFrame
    convention: V.Convention = V.CONVENTIONS[0]
    store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df

    @cached_property
    def docs(self) -> DataFrame:
        return S.with_convention(self.meta)

    @cached_property
    def doc_text(self) -> DataFrame:
        return self.projected.select("doc_id", "text")

    @cached_property
    def elements(self) -> DataFrame:
        return markup.elements(self.projected)

    @cached_property
    def known(self) -> DataFrame:
        """Documents of the convention; others have no paragraphs, decisions or edits."""
        return self.docs.where(F.col("convention_id") == self.convention.id).select("doc_id")

    @cached_property
    def own_elements(self) -> DataFrame:
        return self.elements.join(self.known, "doc_id", "left_semi")

    @cached_property
    def sections(self) -> DataFrame:
        sized = self.projected.select("doc_id", "elements", F.length("text").alias("text_end"))
        sized = markup.elements(sized, "text_end", fields=("seq", "tag", "attrs", "span_start", "text"))
        return self.store(S.sections(sized, self.doc_text), "sections")

    @cached_property
    def paragraphs(self) -> DataFrame:
        own = markup.elements(self.projected, fields=("seq", "tag", "ancestors", "span_start", "span_end", "text")).join(self.known, "doc_id", "left_semi")
        return S.paragraphs(own, self.sections, self.convention.paragraph)

    @cached_property
    def capabilities(self) -> DataFrame:
        return S.capabilities(self.docs.select("doc_id", "convention_id"), self.sections, self.doc_text, self.convention)

    @cached_property
    def regions(self) -> DataFrame:
        return E.regions(S.with_body(self.projected), None, self.convention).join(self.known, "doc_id", "left_semi")

    @cached_property
    def bracketed(self) -> DataFrame:
        """Regions of all documents and their brackets, found in each document's own row."""
        return self.store(E.bracketed(E.regions(S.with_body(self.projected), None, self.convention)), "regions")

    @cached_property
    def own_bracketed(self) -> DataFrame:
        return self.bracketed.join(self.known, "doc_id", "left_semi")

    @cached_property
    def italics(self) -> DataFrame:
        return S.italics(self.own_elements, *self.convention.addition)

    @cached_property
    def edits(self) -> DataFrame:
        # regions are of known documents only, so what meets them needn't be
        added = S.italics(markup.elements(self.projected, fields=("tag", "attrs", "ancestors", "span_start", "span_end", "text")), *self.convention.addition)
        notes = S.footnotes(markup.elements(self.projected, fields=("tag", "span_start", "span_end")))
        return E.edits(self.own_bracketed, added, notes, self.sections)

    @cached_property
    def classified(self) -> DataFrame:
        return self.store(R.classified(E.revisions(E.group_edits(self.edits, self.doc_text), self.sections, self.doc_text)), "classified")

    @cached_property
    def blocks(self) -> DataFrame:
        own = self.sections.join(self.known, "doc_id", "left_semi")
        return self.store(G.blocks(own, self.doc_text, self.paragraphs, self.convention), "blocks")

    @cached_property
    def deadlines(self) -> DataFrame:
        return G.deadlines(self.blocks, self.docs)

    @cached_property
    def outline(self) -> DataFrame:
        return S.outline(self.sections, self.paragraphs)

    @cached_property
    def buckets(self) -> DataFrame:
        return B.buckets(self.classified, self.sections)

    @cached_property
    def briefing(self) -> DataFrame:
        return B.briefing(self.buckets, self.blocks, self.docs)

    @cached_property
    def passages(self) -> DataFrame:
        return B.passages(self.classified, self.buckets, self.sections, self.doc_text)

    @cached_property
    def funnel(self) -> DataFrame:
        return R.funnel(self.classified)

    @cached_property
    def explicit(self) -> DataFrame:
        return C.explicit(self.blocks, C.provisions(self.sections, self.own_bracketed), self.classified)

    @cached_property
    def links(self) -> DataFrame:
        return C.links(self.blocks, self.explicit, C.implicit_scores(self.blocks, self.classified, self.sections))

    @cached_property
    def cards(self) -> DataFrame:
        return C.cards(self.blocks, self.classified, self.links)


@dataclass
class InBlocks(Analysis):
    """The analysis of documents that no row can hold. projected: their blocks of text (doc_id, piece, text; PIECE characters
    each), parts: their elements without text, both as markup.project_chunks() gives them. Texts are cut out for the
    elements that a step reads, so edits, sections, paragraphs and decisions of any document are found; what reads whole
    texts (capabilities) isn't there.
    """

    parts: DataFrame | None = None

    @cached_property
    def doc_text(self) -> DataFrame:
        return self.projected

    @cached_property
    def elements(self) -> DataFrame:
        return texts_of(self.parts, self.projected)

    def _read(self, which: Column, known: bool = True) -> DataFrame:
        some = self.parts.where(which)
        return texts_of(some.join(self.known, "doc_id", "left_semi") if known else some, self.projected)

    @cached_property
    def own_elements(self) -> DataFrame:
        return self._read(F.lit(True))

    @cached_property
    def sections(self) -> DataFrame:
        return self.store(S.sections(self._read(F.col("tag") == "HD", known=False), self.projected), "sections")

    @cached_property
    def paragraphs(self) -> DataFrame:
        direct = (F.col("tag") == "P") & (F.try_element_at("ancestors", F.lit(-1)) == "SUPLINF")
        return S.paragraphs(self._read(direct), self.sections, self.convention.paragraph)

    @cached_property
    def regions(self) -> DataFrame:
        bodies = S.body_spans(self.parts, self.projected).join(self.known, "doc_id", "left_semi")
        return self.store(E.regions_in_blocks(self.projected, bodies, self.convention), "regions")

    own_bracketed = property(lambda self: self.regions)

    @cached_property
    def brackets(self) -> DataFrame:
        return self.store(E.brackets_in_blocks(self.projected, self.regions), "brackets")

    @cached_property
    def footnotes(self) -> DataFrame:
        return S.footnotes(self.parts)

    def _marked(self) -> Column:
        tag, attr, value = self.convention.addition
        return (F.col("tag") == tag) & (F.col("attrs")[attr] == value)

    @cached_property
    def italics(self) -> DataFrame:
        return S.italics(self._read(self._marked()), *self.convention.addition)

    @cached_property
    def edits(self) -> DataFrame:
        gone = self.brackets.where("closed").select("doc_id", F.col("at").alias("span_start"), F.col("to").alias("span_end"))
        gone = texts_of(gone, self.projected).select("doc_id", "span_start", F.expr("substring(text, 2, length(text) - 2)").alias("inner"))
        added = S.italics(self._read(self._marked() & ~F.array_contains("ancestors", "FTNT"), known=False), *self.convention.addition)
        return E.edits_of(gone, self.regions, added, self.footnotes, self.sections)

    @cached_property
    def diagnostics(self) -> DataFrame:
        marks = S.italics(self.parts.withColumn("text", F.lit(None).cast("string")), *self.convention.addition)
        return E.diagnostics_in_blocks(self.brackets, self.regions, marks, self.footnotes)
