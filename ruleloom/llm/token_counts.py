"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

A text is cut into pre-tokens where no piece of the vocabulary can reach across. A batch's new pre-tokens lie in one
ragged numpy array; in each round every sequence applies its best pair (lowest rank, leftmost first) at the same
time, until none has a pair left. The symbols that survive are counted; a character outside the vocabulary counts
as its UTF-8 bytes. Pre-tokens recur, so each worker remembers counts up to a fixed number of them.

A null text counts as empty: 0 bytes, 0 tokens. Control strings inside texts are ordinary text, as in the library.
Whole texts are counted whatever their length; a long sequence without a safe cut is merged by a heap instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LIMIT = 4096
#: Pre-tokens that a worker remembers; about 40 MB.
REMEMBERED = 400_000
#: Longer sequences are merged one by one.
LONG = 256


class PieceCounter:
    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        number = {p: k for k, p in enumerate(pieces)}
        #: equal scores share a rank, so that the leftmost of them goes first
        self.rank = np.unique([-sp.get_score(i) for i in ids], return_inverse=True)[1].astype(np.int64)
        self.n = len(pieces)
        self.symbol = np.full(0x110000, -1, np.int32)
        pairs, inner = {}, set()
        for p, k in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = k
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                inner.add((number[p[i - 1]], number[p[i]]))
                if a is not None and b is not None:
                    pairs[a * self.n + b] = k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.inner = np.array(sorted(a * self.n + b for a, b in inner), np.int64)
        self.pairs = pairs
        self.known: dict[str, int] = {}

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_piece[at], -1)

    def merged(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit; a unit stands alone, its spaces already replaced."""
        out = np.zeros(len(units), np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(cp):
            return out
        unit = np.repeat(np.arange(len(units)), lens)
        sym = self.symbol[cp]
        lost = sym < 0
        n_bytes = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        np.add.at(out, unit[lost], n_bytes[lost])
        key = sym[:-1].astype(np.int64) * self.n + sym[1:]
        at = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
        cut = np.ones(len(cp), bool)
        cut[1:] = (unit[1:] != unit[:-1]) | lost[1:] | lost[:-1] | (self.inner[at] != key)
        seq = np.cumsum(cut) - 1
        sym, seq, unit = sym[~lost], seq[~lost], unit[~lost]
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        size = np.diff(np.append(first, len(seq)))
        for i in np.flatnonzero(size > LONG):
            out[unit[first[i]]] += self._by_heap(sym[first[i] : first[i] + size[i]].tolist())
        keep = np.repeat(size <= LONG, size)
        self._rounds(sym[keep], seq[keep], unit[keep], out)
        return out

    def _rounds(self, sym: np.ndarray, seq: np.ndarray, unit: np.ndarray, out: np.ndarray) -> None:
        none = np.iinfo(np.int64).max
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(seq[1:] == seq[:-1], self._lookup(sym[:-1], sym[1:]), -1)
        while len(sym):
            order = np.where(made >= 0, (self.rank[made] << 32) | np.arange(len(sym)), none)
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            best = np.minimum.reduceat(order, first)
            open_ = best != none
            size = np.diff(np.append(first, len(seq)))
            np.add.at(out, unit[first[~open_]], size[~open_])
            at = best[open_] & 0xFFFFFFFF
            sym[at] = made[at]
            keep = np.repeat(open_, size)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, seq, unit, made = sym[keep], seq[keep], unit[keep], made[keep]
            left, right = at[at > 0] - 1, at[at + 1 < len(sym)]
            left = left[seq[left] == seq[left + 1]]
            ends = right[seq[right] != seq[right + 1]]
            right = right[seq[right] == seq[right + 1]]
            made[left] = self._lookup(sym[left], sym[left + 1])
            made[right] = self._lookup(sym[right], sym[right + 1])
            made[ends] = -1
            if len(sym):
                made[-1] = -1

    def _by_heap(self, sym: list[int]) -> int:
        """The same merges for one long sequence, in n log n steps."""
        n = len(sym)
        nxt, prev, alive, count = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n, n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if j >= 0 and (k := self.pairs.get(sym[i] * self.n + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[k]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = self.pairs[a * self.n + b], False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            count -= 1
            offer(i)
            offer(prev[i])
        return count

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Every pre-token begins with the space sign, the first by the model's own prefix."""
        known, cut, new = self.known, [], {}
        for t in texts:
            parts = (SPACE + t.replace(" ", SPACE)).split(SPACE)[1:] if t else []
            if "" in parts:  # runs of spaces belong to one pre-token
                parts = _with_runs(parts)
            cut.append(parts)
            new.update(dict.fromkeys([p for p in parts if p not in known], 0))
        units = list(new)
        for i in range(0, len(units), 50_000):
            some = units[i : i + 50_000]
            new.update(zip(some, self.merged([SPACE + u for u in some]).tolist(), strict=True))
        if len(known) + len(new) > REMEMBERED:
            for p in {p for parts in cut for p in parts} - new.keys():
                new[p] = known[p]
            known.clear()
        if len(new) <= REMEMBERED:
            known.update(new)
        else:
            known = new
        return [sum(map(known.__getitem__, parts)) for parts in cut]


def _with_runs(parts: list[str]) -> list[str]:
    """Joins each run of spaces with the word after it."""
    out, run = [], ""
    for i, p in enumerate(parts):
        if p == "" and i < len(parts) - 1:
            run += SPACE
        else:
            out.append(run + p)
            run = ""
    return out


@lru_cache(2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_count(text: Column, model_path: str) -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_path)
        for texts in batches:
            yield pd.Series(c.counts(texts.fillna("").tolist()), dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col(text_col), model_path).alias("n_tokens")
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
