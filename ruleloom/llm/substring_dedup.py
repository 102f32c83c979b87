"""Substring dedup by hashing lines and paragraphs, then passages inside lines.

A text's units are its lines, or its sentences where lines are cut further after a sentence's end mark; they are
normalised (case, white space). From each unit a run goes on, and another back, over as few units as have min_words
words together, as a paragraph of short lines; a unit with as many words is a run by itself. Any passage of whole
units with min_words words or more, such as a line, a paragraph or a list of short lines, is a union of such runs, so
no unit is too short to count. Runs are digested with 128 bits. Of runs with equal digests, in all documents, the
first stays: that of the smallest id (null ids last), then the smallest offset. The others' units are removed, but for
those that overlap the first; spans of units are given in the original text's characters.

With passage_words, passages inside units follow: runs of so many words or more, wherever they begin and end. Words
are split at ASCII white space, and A-Z lower-cased. Each window of passage_words words has an anchor, the first of its
runs of half as many words with the smallest hash; equal windows have equal anchors. So only windows whose anchor occurs
twice are digested (128 bits), and all of these: no repeat is missed. Windows whose words have all gone with whole units
take no part. Of equal windows the first stays, as above, and the others' words are removed.

A null text counts as empty. Rows that agree in id and text count as one document: their units are the same
occurrences, so they stay or go alike. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import BROADCAST_BYTES, WORD, join_one, scratch
from ruleloom.llm.text_arrays import encoded, mix, word_hashes

#: Shorter runs of sentences recur by chance.
MIN_WORDS = 6
#: A passage has so many words, as whole lines together or inside lines; stock lines shorter than that are no copies.
PASSAGE_WORDS = 50
_WORD = re.compile(WORD)
_DOC = ["_id", "_row"]
#: Repeated windows are many beside the texts they come from, so few of them are broadcast.
WINDOW_BYTES = 16 << 20
_BASE, _SALT = 0xD1342543DE82EF95, np.uint64(0x2545F4914F6CDD1D)
_UNITS = {"sentence": re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)"), "line": re.compile(r"[^\n]+")}


def units(text: str, kind: str = "sentence") -> Iterator[tuple[int, int, str]]:
    """Start and end of each unit without white space at its ends, and its normal form."""
    for m in _UNITS[kind].finditer(text):
        raw = m.group()
        words = raw.lower().split()
        if words:
            a = m.start() + len(raw) - len(raw.lstrip())
            yield a, a + len(raw.strip()), " ".join(words)


def runs(found: list[tuple[int, int, str]], least: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and normal form of the shortest runs of units, from each on and back, that have so many words."""
    words = [normal.count(" ") + 1 for _, _, normal in found]
    seen, last, n = set(), 0, 0
    for i, w in enumerate(words):  # [i, last) has n words
        while n < least and last < len(words):
            n, last = n + words[last], last + 1
        if n < least:
            break
        seen.add((i, last))
        n -= w
    first, n = len(words), 0
    for k in range(len(words), 0, -1):  # [first, k) has n words
        while n < least and first:
            first -= 1
            n += words[first]
        if n < least:
            break
        seen.add((first, k))
        n -= words[k - 1]
    for i, k in sorted(seen):
        yield found[i][0], found[k - 1][1], "\n".join(x[2] for x in found[i:k])


def within(found: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The units that lie in one of the spans; both in order of their starts."""
    out, k, reach = [], 0, -1
    for a, b in found:
        while k < len(spans) and spans[k][0] <= a:
            reach, k = max(reach, spans[k][1]), k + 1
        if b <= reach:
            out.append((a, b))
    return out


def islands(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, made of runs of 1, 2, 4 ... words; h: the words' hashes."""
    if len(h) < n:
        return h[:0]
    out, done, part, size = np.zeros(len(h), h.dtype), 0, h, 1
    while True:
        if n & size:
            m = len(h) - done - size + 1
            out = out[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + m]
            done += size
        if done == n:
            return out
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


def anchors(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of n words the anchor: the smallest hash of its runs of half as many words, and its first place."""
    half = max(1, n // 2)
    least = grams(h, half)[: max(0, len(h) - half + 1)]
    at, size, want = np.arange(len(least)), 1, n - half + 1
    if len(least) < want:
        return least[:0], at[:0]
    while size < want:
        step = min(size, want - size)
        less = least[step:] < least[:-step]
        least, at = np.where(less, least[step:], least[:-step]), np.where(less, at[step:], at[:-step])
        size += step
    return least, at


def places(text: str) -> np.ndarray:
    """Start and end of each word."""
    return np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans and the white space after each, up to the line's end."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at] in " \t":
            at += 1
    out.append(text[at:])
    return "".join(out)


def _later(found: DataFrame, by: list[str], name: str, broadcast: int | None = None) -> DataFrame:
    """found's spans (by, a, b, digest) that repeat an earlier one; what overlaps the first itself is cut off."""
    at = F.struct(F.col(by[0]).isNull().alias("null"), *by, "a", "b")
    first = found.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch(first, f"repeated-{name}")
    more = join_one(found, first, "digest", "n", 96, broadcast).where(~at.eqNullSafe(F.col("first")))
    # the first stays whole where another overlaps it
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in by))
    return more.withColumn("a", F.when(same, F.greatest("a", "first.b")).otherwise(F.col("a"))).where("a < b").select(*by, "a", "b")


def _gathered(spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, and the spans of each document, in order, those that overlap or touch as one."""
    w = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    s = s.groupBy(*by, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return s.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias(name))


def _met(rows: DataFrame, per_doc: DataFrame, how: str = "left") -> DataFrame:
    """rows with the spans that per_doc, a written table, has for them."""
    spans = [f.name for f in per_doc.schema if f.dataType.typeName() == "array"]
    n, docs = per_doc.agg(F.coalesce(F.sum(sum(F.greatest(F.size(c), F.lit(0)) for c in spans)), F.lit(0)), F.count("*")).first()
    per_doc = per_doc.withColumnsRenamed({"_id": "_sid", "_row": "_srow"})
    if 32 * n + 128 * docs <= BROADCAST_BYTES:
        per_doc = F.broadcast(per_doc)
    return rows.join(per_doc, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_row") == F.col("_srow")), how).drop("_sid", "_srow")


def _pairs(spans: list | None) -> list[tuple[int, int]]:
    return [] if spans is None else [(int(x["a"]), int(x["b"])) for x in spans]


def _passages(rows: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """Per document gone, and passages: the words, as spans of their numbers, of later copies of windows of n words.

    rows: _id, _row, _text; gone: by document, the spans that go with whole units.
    """
    kind = rows.schema["_id"].dataType.simpleString()

    def windows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' hashes, their documents, and where documents begin."""
        h, first = word_hashes(encoded(batch["_text"]))
        return h, np.repeat(np.arange(len(batch)), np.diff(first)), first

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, doc, first = windows(batch)
            removed = np.zeros(len(h) + 1, np.int64)
            for d, (text, spans) in enumerate(zip(batch["_text"], batch["gone"], strict=True)):
                if spans is not None:
                    start, end = places(text).T
                    for a, b in _pairs(spans):
                        removed[1 + first[d] + np.searchsorted(start, a) : 1 + first[d] + np.searchsorted(end, b, "right")] = 1
            removed = np.cumsum(removed)
            least, at = anchors(h, n)
            i = np.flatnonzero((doc[: len(least)] == doc[n - 1 :]) & (removed[n:] - removed[:-n] < n)) if len(least) else at
            begins = np.flatnonzero(np.append(True, (at[i[1:]] != at[i[:-1]]) | (i[1:] != i[:-1] + 1))) if len(i) else i
            k = np.diff(np.append(begins, len(i)))
            i = i[begins]
            own = batch[["_id", "_row"]].take(doc[i]).reset_index(drop=True)
            yield own.assign(a=i - first[doc[i]], b=i - first[doc[i]] + k, anchor=least[i].view(np.int64))

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, doc, first = windows(batch)
            spans = [(first[d] + a, first[d] + b) for d, s in enumerate(batch["near"]) for a, b in _pairs(s)]
            i = np.concatenate([np.arange(0), *(np.arange(a, b) for a, b in spans)])
            two = np.stack([grams(h, n), grams(mix(h ^ _SALT), n)], 1)[i].tobytes()
            at = i - first[doc[i]]
            digest = [two[x : x + 16] for x in range(0, len(two), 16)]
            yield pd.DataFrame({"no": batch["no"].to_numpy()[doc[i]], "a": at, "b": at + n, "digest": digest})

    found = scratch(_met(rows, gone).mapInPandas(anchored, f"_id {kind}, _row long, a int, b int, anchor long"), "anchors")
    twice = scratch(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors-repeated")
    near = _gathered(join_one(found, twice, "anchor", "n", 48), _DOC, "near")
    # in order, one number stands for id and row in all windows
    near = scratch(near.orderBy(F.col("_id").isNull(), *_DOC).withColumn("no", F.monotonically_increasing_id()), "near")
    found = scratch(_met(rows, near, "inner").mapInPandas(digested, "no long, a int, b int, digest binary"), "windows")
    passages = _gathered(_later(found, ["no"], "windows", WINDOW_BYTES), ["no"], "passages")
    both = gone.unionByName(near.select("no", *_DOC).join(passages, "no").drop("no"), allowMissingColumns=True)
    return scratch(both.groupBy(*_DOC).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("gone", "passages"))), "passages")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "sentence", passage_words: int | None = None) -> DataFrame:
    """One row per row: id, n_units, n_removed (spans), removed (spans), kept_text. unit: line or sentence.

    passage_words: copies of so many words go even inside units; spans that overlap count as one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, row, text in zip(batch["_id"], batch["_row"], batch["_text"], strict=True):
                for a, b, normal in runs(list(units(text, unit)), min_words):
                    out.append((i, row, a, b, xxhash.xxh3_128_digest(normal)))
            yield pd.DataFrame(out, columns=["_id", "_row", "a", "b", "digest"]).astype({"_id": batch["_id"].dtype})

    found = scratch(rows.mapInPandas(cut, f"_id {kind}, _row long, a int, b int, digest binary"), "units")
    gone = scratch(_gathered(_later(found, _DOC, "units"), _DOC, "gone"), "gone")
    none = F.lit(None).cast(gone.schema["gone"].dataType)
    met = _met(rows, _passages(rows, gone, passage_words) if passage_words else gone.withColumn("passages", none))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, found, all_ = batch["_text"].tolist(), [], []
            for text, gone, more in zip(texts, batch["gone"], batch["passages"], strict=True):
                found.append([(a, b) for a, b, _ in units(text, unit)])
                cut = within(found[-1], _pairs(gone)) if gone is not None else []
                if more is not None:
                    at = places(text)
                    cut = islands(cut + [(int(at[a, 0]), int(at[b - 1, 1])) for a, b in _pairs(more)])
                all_.append(cut)
            yield pd.DataFrame(
                {
                    "_id": batch["_id"],
                    "n_units": [len(f) for f in found],
                    "n_removed": [len(s) for s in all_],
                    "removed": [[{"start": a, "end": b} for a, b in s] for s in all_],
                    "kept_text": [_without(t, s) if s else t for t, s in zip(texts, all_, strict=True)],
                }
            )

    out = met.select("_id", "_text", "gone", "passages").mapInPandas(
        clean, f"_id {kind}, n_units long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    )
    return out.withColumnRenamed("_id", id_col)
