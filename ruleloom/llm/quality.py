"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its words' hashed frequencies (square roots, scaled to length 1) and some statistics of its
form and size. The score is the logistic of b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise part takes
linear time by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on at most SAMPLE labelled rows, drawn by hash, in one task; the model's size is fixed. Every row is then
scored on its whole text in one pass without a shuffle. A null text counts as empty; such texts get the score that
their statistics give. A null id is never held out and has no label. Of rows that share a labelled id one text, that
of the least hash, is learnt. Labels other than 0 and 1 are left out; of several labels of an id the smallest counts.
Without usable labels every score is 0.5, and with one label only all scores are equal. Equal texts have equal scores.
An empty table gives an empty result; extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.text_arrays import encoded, words

THRESHOLD = 0.3
#: Rows that the model is fitted on, at most.
SAMPLE = 6000
HASHED = 1 << 16
RANK = 4
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-5
#: Names of the statistics; their features follow the hashed words.
STATISTICS = ("log words", "word bytes", "upper", "punctuation", "digits", "other", "distinct words", "repeated lines", "line words", "commonest word", "stops", "few words")
SIZE = HASHED + len(STATISTICS)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def _line_stats(t: bytes) -> tuple[float, float]:
    lines = [x for x in (y.strip() for y in t.split(b"\n")) if x]
    return (1 - len(set(lines)) / len(lines), float(len(lines))) if lines else (0.0, 0.0)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of all features that aren't 0, in order of texts."""
    of, word, count = [], [], []
    for _, _, _, h, d in words(texts):
        key, c = np.unique((d.astype(np.int64) << 16) | (h >> np.uint64(48)).astype(np.int64), return_counts=True)
        of.append(key >> 16)
        word.append(key & 0xFFFF)
        count.append(c)
    of, word, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (of, word, count))
    if len(of) and (np.diff((of << 16) | word) <= 0).any():  # a long text came in pieces
        key, back = np.unique((of << 16) | word, return_inverse=True)
        of, word, count = key >> 16, key & 0xFFFF, np.bincount(back, count).astype(np.int64)
    n = np.bincount(of, count, len(texts))
    distinct = np.bincount(of, minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, of, count)
    value = np.sqrt(count / np.maximum(n, 1)[of])
    stats = np.zeros((len(texts), len(STATISTICS)))
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        size = max(1, len(b))
        c = np.bincount(b, minlength=256)
        upper, mark, digit, stop = (c[x].sum() / size for x in (_UPPER, _MARK, _DIGIT, _STOP))
        repeated, lines = _line_stats(t)
        other = c[128:].sum() / size
        stats[i] = [0, (size / max(1, n[i])) / 16, upper * 3, mark * 5, digit * 5, other * 3, 0, repeated, n[i] / max(1.0, lines) / 50, 0, stop * 20, 0]
    stats[:, 0] = np.log1p(n) / 8
    stats[:, 6] = distinct / np.maximum(n, 1)
    stats[:, 9] = most / np.maximum(n, 1) * 3
    stats[:, 11] = n < 5
    stats = np.clip(stats, 0, 3)
    of = np.concatenate([of, np.repeat(np.arange(len(texts)), len(STATISTICS))])
    word = np.concatenate([word, np.tile(np.arange(HASHED, SIZE), len(texts))])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(of, kind="stable")
    return of[order], word[order], value[order]


def raw_scores(bias: float, w: np.ndarray, v: np.ndarray, of: np.ndarray, i: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """w: (SIZE,), v: (RANK, SIZE). Linear in the number of features."""
    out = bias + np.bincount(of, w[i] * x, n)
    for f in v:
        vx = f[i] * x
        out += 0.5 * (np.bincount(of, vx, n) ** 2 - np.bincount(of, vx * vx, n))
    return out


def fit(texts_of: np.ndarray, i: np.ndarray, x: np.ndarray, labels: np.ndarray, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Mini-batch AdaGrad on the logistic loss; the features of text t are those with texts_of == t, in order."""
    rng = np.random.default_rng(seed)
    mean = labels.mean() if len(labels) else 0.5
    both = len(labels) > 0 and 0 < mean < 1
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (RANK, SIZE)) * both
    bias = float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((RANK, SIZE), 1e-2), 1e-2
    first = np.searchsorted(texts_of, np.arange(len(labels) + 1))
    for _ in range(EPOCHS if both else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = first[some + 1] - first[some]
            take = np.repeat(first[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            of, ii, xx = np.repeat(np.arange(len(some)), sizes), i[take], x[take]
            u, at_u = np.unique(ii, return_inverse=True)
            ws, vs = w[u], v[:, u]
            sums = np.array([np.bincount(of, f[at_u] * xx, len(some)) for f in vs])
            raw = bias + np.bincount(of, ws[at_u] * xx, len(some))
            raw += 0.5 * (sums**2 - np.array([np.bincount(of, (f[at_u] * xx) ** 2, len(some)) for f in vs])).sum(axis=0)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            g = np.bincount(at_u, err[of] * xx, len(u)) + DECAY * ws
            gw[u] += g * g
            w[u] = ws - RATE * g / np.sqrt(gw[u])
            for f in range(RANK):
                g = np.bincount(at_u, err[of] * xx * (sums[f][of] - vs[f][at_u] * xx), len(u)) + DECAY * vs[f]
                gv[f, u] += g * g
                v[f, u] = vs[f] - RATE * g / np.sqrt(gv[f, u])
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / np.sqrt(gb)
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> bytes:
    """The model as bytes of a fixed size: bias, w and v as 32-bit floats. labels: id and 0 or 1, others are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    n = known.count()
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 40))
    drawn = known.where(order < F.lit(int(min(1.0, 1.1 * sample / max(n, 1)) * (1 << 40)))).orderBy(order, id_col).limit(sample)
    drawn = drawn.select(F.col(id_col).alias("_id"), F.col("_y").cast("int").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))  # no more rows than labels

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                of, i, x = features(encoded(b["_text"]))
                cut = np.searchsorted(of, np.arange(len(b) + 1))
                part = [slice(a, z) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pd.DataFrame({"_id": b["_id"].astype(str), "_y": b["_y"], "i": [i[p].astype("<i4").tobytes() for p in part], "x": [x[p].astype("<f4").tobytes() for p in part]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([pd.DataFrame({"_id": [], "_y": [], "i": [], "x": []}), *batches]).sort_values(["_id", "_y", "i"], kind="stable")
        parts = [np.frombuffer(b, "<i4") for b in all_["i"]]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, int)
        i = np.concatenate([np.zeros(0, "<i4"), *parts]).astype(np.int64)
        x = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(b, "<f4") for b in all_["x"])]).astype(float)
        bias, w, v = fit(of, i, x, all_["_y"].to_numpy(float))
        yield pd.DataFrame({"model": [np.concatenate([[bias], w, v.ravel()]).astype("<f4").tobytes()]})

    described = rows.mapInPandas(describe, "_id string, _y int, i binary, x binary")
    found = described.repartition(1).mapInPandas(learn, "model binary").collect()  # at most sample rows
    return bytes(found[0]["model"]) if found else np.zeros(1 + SIZE * (RANK + 1), "<f4").tobytes()


@lru_cache(1)
def _loaded(model: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    a = np.frombuffer(model, "<f4").astype(float)
    return float(a[0]), a[1 : 1 + SIZE], a[1 + SIZE :].reshape(RANK, SIZE)


def score(df: DataFrame, model: bytes, text: Column) -> Column:
    """A column of scores from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, w, v = _loaded(shared.value)
        for texts in batches:
            of, i, x = features(encoded(texts.fillna("")))
            raw = raw_scores(bias, w, v, of, i, x, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    return scored(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id, held_out, score, predicted. Labels of held-out ids aren't learnt."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns as they were."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col)
    whole = docs.select(F.struct("*").alias("_whole"), score(docs, model, F.coalesce(F.col(text_col), F.lit(""))).alias("_score"))
    return whole.where(F.col("_score") >= threshold).select("_whole.*")
