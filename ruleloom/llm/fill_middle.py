"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text's cuts fall between units: its lines, or its code points. Of its UTF-8 bytes only the exceptions are indexed:
where a character of several bytes stands, and how many bytes beyond one the characters up to it take. A binary
search in that index converts cuts between bytes and code points; between two exceptions both run in step, so an
ASCII text has an empty index and its conversion is arithmetic.

A null text counts as empty and stays plain, as does a text that holds a sentinel. A null id is drawn as an empty one.
Draws depend on the row's id only: rows that repeat an id cut their texts by the same draw, and equal rows give equal
results. Texts of any length are cut whole. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Exceptions:
    """The characters of several bytes in a UTF-8 text: the code points and bytes before each, and the excess bytes up to it."""

    def __init__(self, raw: np.ndarray):
        self.at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at_byte]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(own)])
        self.at_char = self.at_byte - self.excess[:-1]

    def char(self, byte: int) -> int:
        """The code points before a byte at which a character begins."""
        return int(byte - self.excess[np.searchsorted(self.at_byte, byte)])

    def byte(self, char: int) -> int:
        """The bytes before a code point."""
        return int(char + self.excess[np.searchsorted(self.at_char, char)])


def line_ends(raw: np.ndarray) -> np.ndarray:
    """The bytes up to the end of each line; the last line may lack its line feed."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    return ends if not len(raw) or raw[-1] == 0x0A else np.append(ends, len(raw))


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: bytes, doc_id, seed: int, unit: str, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), and the output."""
    raw = np.frombuffer(text, np.uint8)
    index = Exceptions(raw)
    ends = line_ends(raw) if unit == "line" else None
    n = index.char(len(text)) if ends is None else len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (index.byte(c) for c in cuts) if ends is None else (int(ends[c - 1]) if c else 0 for c in cuts)
    chars_a, chars_b = cuts if ends is None else (index.char(a), index.char(b))
    prefix, middle, suffix = PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:]
    spm = h4 % 100 < spm_percent
    return n, "spm" if spm else "psm", chars_a, chars_b - chars_a, (suffix + prefix if spm else prefix + suffix) + middle


def fill_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """One row per row: id, n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    unit: cuts fall between lines ("line") or code points ("char"); n counts them. Rows stay in their partitions.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            done = [transform(t.as_py(), i.as_py(), seed, unit, fim_percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["_id", *names])

    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("_id").alias(id_col), *names[:-1], F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which output was made. A cut text holds no sentinel, so output holds each of them once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame) -> DataFrame:
    """fill_middle's rows with SHA-256 digests of the output and of the text restored from it, instead of the output."""
    sha = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return df.select("*", *sha).drop("output")
