"""Document fingerprints: quartile bucket digests.

A text's UTF-8 byte triplets are hashed into buckets and counted. The quartiles of these counts divide the buckets into
four classes of two bits each; with a byte for the logarithm of the length they make the digest, in hexadecimal. Two
digests differ by the sum of their classes' distances (opposite classes count 6, not 3) and of their lengths'; the
likeness is 1 less that sum over the largest possible one, so from 0 to 1.

A null text counts as empty. Texts of under three bytes have counts of 0 in all buckets; their length tells them
apart. Equal texts have equal digests. "Next" is the next row in ascending order of id, equal ids by text; after the
last comes the first, so a single row is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import scratch

BUCKETS = 512
#: Bytes of text whose triplets are counted at once.
PIECE = 1 << 20
_HEAD = 2  # hexadecimal digits of the length


def _count(texts: list[bytes]) -> np.ndarray:
    """Triplets in each bucket, for each text."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PIECE):
            size += len(texts[upto])
            upto += 1
        for lo in range(0, max(1, size), 4 * PIECE) if upto == at + 1 else (0,):
            group = [texts[at][lo : lo + 4 * PIECE + 2]] if upto == at + 1 else texts[at:upto]
            b = np.frombuffer(b"".join(group), np.uint8).astype(np.uint32)
            if len(b) < 3:
                continue
            h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 9)).astype(np.int64)
            ends = np.cumsum([len(t) for t in group])
            of = np.repeat(np.arange(len(group)), np.diff(ends, prepend=0))[:-2]
            own = np.ones(len(bucket), bool)  # triplets across two texts don't count
            for e in ends[:-1]:
                own[max(0, e - 2) : e] = False
            flat = np.bincount(of[own] * BUCKETS + bucket[own], minlength=len(group) * BUCKETS)
            out[at:upto] += flat.reshape(-1, BUCKETS)
        at = upto
    return out


def digests(texts: list[bytes]) -> np.ndarray:
    """A row for each text: the length's byte, then two bits a bucket, packed."""
    counts = _count(texts)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = sum((counts > q[:, k : k + 1]).astype(np.uint8) for k in range(3))
    packed = (code[:, ::4] << 6) | (code[:, 1::4] << 4) | (code[:, 2::4] << 2) | code[:, 3::4]
    length = np.minimum(255, np.round(12 * np.log1p([len(t) for t in texts]))).astype(np.uint8)
    return np.concatenate([length[:, None], packed], axis=1)


_CLASS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
#: The difference of two packed bytes, four buckets each.
_BYTE = sum(_CLASS[(np.arange(256)[:, None] >> s) & 3, (np.arange(256)[None] >> s) & 3] for s in (0, 2, 4, 6)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1, for rows of digests."""
    apart = _BYTE[a[:, 1:], b[:, 1:]].sum(axis=1, dtype=np.int64)
    size = np.minimum(255, np.abs(a[:, 0].astype(int) - b[:, 0]))
    return 1 - (apart + size) / (6 * BUCKETS + 255)


def _compare(ids, texts: list[str], nexts: list[str]) -> pd.DataFrame:
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
    raw = [t.encode() for t in edited]
    own, near = digests([t.encode() for t in texts]), digests(raw)
    after = digests([t.encode() for t in nexts])
    return pd.DataFrame(
        {
            "_id": ids,
            "n_chars": np.array([len(t) for t in texts], "i8"),
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in near],
            "near_edited": likeness(own, near),
            "near_next": likeness(own, after),
        }
    )


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are put in order of id once, by range; each partition pairs its rows with their next ones as they stream
    past. A partition's last row meets the next partition's first one in a join of one row per partition.
    """
    kind, spark = df.schema[id_col].dataType.simpleString(), df.sparkSession

    schema = f"_id {kind}, _kind int, _part int, _text string, {_COLUMNS}"
    names = [x.split()[0] for x in schema.split(", ")]

    def mark(i, text: str, kind: int, part: int) -> pd.DataFrame:
        """A partition's first (1) or last row (2), with its text."""
        row = dict.fromkeys(names) | {"_id": i, "_kind": kind, "_part": part, "_text": text, "n_chars": 0, "near_edited": 0.0, "near_next": 0.0}
        return pd.DataFrame({k: np.array([v], object) if k.endswith(("_text", "print", "sha256")) else [v] for k, v in row.items()})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch["_id"].tolist(), batch["_text"].tolist()
            if not ids:
                continue
            if last is None:
                yield mark(ids[0], texts[0], 1, part)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1])
            for i in range(0, len(ids) - 1, 128):
                j = min(i + 128, len(ids) - 1)
                met = _compare(ids[i:j], texts[i:j], texts[i + 1 : j + 1])
                yield met.assign(_kind=0, _part=part, _text=np.full(len(met), None, object))[names]
        if last is not None:
            yield mark(*last, 2, part)

    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id", "_hash")
    ordered = ordered.sortWithinPartitions("_id", "_hash").select("_id", "_text")
    met = scratch(ordered.mapInPandas(pairs, schema), "fingerprints")
    heads = met.where("_kind = 1").select(F.col("_part").alias("_to"), F.col("_text").alias("_next"))
    order = Window.orderBy("_part")  # one row per partition
    parts = met.where("_kind = 1").select("_part")
    parts = parts.withColumn("_to", F.coalesce(F.lead("_part").over(order), F.min("_part").over(Window.partitionBy(F.lit(0)))))
    tails = met.where("_kind = 2").select("_id", "_part", "_text").join(parts, "_part").join(heads, "_to").select("_id", "_text", "_next")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _compare(b["_id"].tolist(), b["_text"].tolist(), b["_next"].tolist())

    out = met.where("_kind = 0").drop("_kind", "_part", "_text").unionByName(tails.mapInPandas(ends, f"_id {kind}, {_COLUMNS}"))
    return out.withColumnRenamed("_id", id_col)
