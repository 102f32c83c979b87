"""Best-fit packing into sequences of fixed length, with swap-based local search.

Documents become token ids with an end id; only longer ones are cut, the short piece first. Pieces are dealt by hash
into blocks of bounded size. In a block, pieces go, longest first, to the fullest sequence that still takes them;
then local search moves a piece, exchanges one for one or two for one between underfull sequences, whenever that
raises the sum of squared fills, until sequences run empty or nothing raises it. What is left underfull in all
blocks is dealt anew into fewer blocks and packed again, until a round saves nothing or one block holds it.

A null text counts as empty: its piece is the end id alone. Rows that are equal give equal pieces. An empty table
gives an empty result. No step sees more than one block; only counts reach the driver.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import scratch

LENGTH = 2048
END = 0
#: Pieces of a block.
BLOCK = 20_000
#: Pre-tokens that a worker remembers with their ids; about 80 MB.
REMEMBERED = 300_000
#: A sequence with less room is as good as full and isn't packed again.
SLACK = 16
SEARCH_ROUNDS = 4
#: For each sequence the search tries so many of the emptiest others; they run empty and make way for the next.
TRIES = 24


class ByteTokens(dict):
    """Ids as the tokenizers library gives them for a byte-level vocabulary, computed by word with memory.

    A word with the space before it never depends on its neighbours. The library's tiktoken twin has the same merges
    and splits and is faster on single words; special strings inside texts become their ids, as in the library.
    As a dict it maps words to their ids, little-endian 32-bit, and works out those that are missing.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str) -> None:
        import json

        import tiktoken

        super().__init__()
        with open(tokenizer_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def __missing__(self, word: str) -> bytes:
        found = self[word] = np.array(self.code.encode_ordinary(" " + word), "<u4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        if "  " in text or text.endswith(" ") or any(s in text for s in self.special):
            return np.array(self.code.encode(text, allowed_special="all"), "<u4").tobytes()
        head, *rest = text.split(" ")
        if len(self) > REMEMBERED:
            self.clear()
        first = np.array(self.code.encode_ordinary(head), "<u4").tobytes()
        return first + b"".join(map(self.__getitem__, rest))


@lru_cache(1)
def byte_tokens(tokenizer_path: str, ranks_path: str, pattern: str) -> ByteTokens:
    return ByteTokens(tokenizer_path, ranks_path, pattern)


def pieces(df: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece of each row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = byte_tokens(tokenizer_path, ranks_path, pattern), END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for i, text in zip(batch["_id"], batch["_text"], strict=True):
                ids = tokens.ids(text) + end
                n = len(ids) // 4
                first = n % length or length
                for k, (a, b) in enumerate(zip([0, *range(first, n, length)], [first, *range(first + length, n + 1, length)], strict=True)):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Numbers of the pieces in each sequence: longest first, each to the fullest sequence that takes it."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, out = 0, []  # bit r of rooms: some sequence has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            s = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            out[s].append(i)
        else:
            room, s = length, len(out)
            out.append([i])
        if room - n:
            by_room[room - n].append(s)
            rooms |= 1 << (room - n)
    return out


def local_search(bins: list[list[int]], sizes: list[int], length: int = LENGTH, rounds: int = SEARCH_ROUNDS) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges between underfull sequences; empty ones go.

    For a sequence a that is fuller than b, putting d more tokens into a and d fewer into b raises the sum by
    2 d (fill a - fill b + d) > 0. So each step looks for the largest d that a has room for: a piece of b (move), a
    piece of b for a smaller one of a, or two pieces of b for one of a.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    open_ = [k for k in range(len(bins)) if fill[k] < length]
    for _ in range(rounds):
        changed = False
        open_.sort(key=lambda k: (-fill[k], k))
        for at, a in enumerate(open_):
            for b in reversed(open_[max(at + 1, len(open_) - TRIES) :]):
                if fill[a] >= length:
                    break
                while bins[b] and fill[a] < length and (step := _step(bins[a], bins[b], sizes, length - fill[a])):
                    give, take = step
                    d = sum(sizes[i] for i in take) - sum(sizes[i] for i in give)
                    bins[a] = [i for i in bins[a] if i not in give] + take
                    bins[b] = [i for i in bins[b] if i not in take] + give
                    fill[a], fill[b], changed = fill[a] + d, fill[b] - d, True
                if bins[b] and fill[b] > fill[a]:
                    break
        open_ = [k for k in open_ if bins[k] and fill[k] < length]
        if not changed:
            break
    return [b for b in bins if b]


def _step(a: list[int], b: list[int], sizes: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """What a gives and takes so that it gains the most, at most room and at least 1."""
    best, out = 0, None
    for i in b:
        if best < sizes[i] <= room:
            best, out = sizes[i], ([], [i])
    if best == room:
        return out
    for j in a:
        most = room + sizes[j]
        for i in b:
            if best < sizes[i] - sizes[j] <= room:
                best, out = sizes[i] - sizes[j], ([j], [i])
        if len(b) > 1 and best < room:
            mine = sorted(b, key=sizes.__getitem__)
            lo, hi = 0, len(mine) - 1
            while lo < hi:  # the pair with the largest sum up to most
                both = sizes[mine[lo]] + sizes[mine[hi]]
                if both > most:
                    hi -= 1
                else:
                    if both - sizes[j] > best:
                        best, out = both - sizes[j], ([j], [mine[lo], mine[hi]])
                    lo += 1
    return out


def _pack_block(length: int):
    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "_row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = block["length"].tolist()
        bins = best_fit(sizes, length)
        fills = [sum(sizes[i] for i in b) for b in bins]
        under = [k for k, f in enumerate(fills) if f < length - SLACK]
        searched = local_search([bins[k] for k in under], sizes, length)
        left = set(under)
        bins = [b for k, b in enumerate(bins) if k not in left] + searched
        seq, offset, done = np.zeros(len(block), "i8"), np.zeros(len(block), "i8"), np.zeros(len(block), bool)
        for k, b in enumerate(bins):
            at, full = 0, sum(sizes[i] for i in b) >= length - SLACK
            for i in b:
                seq[i], offset[i], done[i] = k, at, full
                at += sizes[i]
        number = block["_block"].iloc[0] if len(block) else 0
        return block.assign(sequence_id=(int(number) << 32) + seq, offset=offset, _done=done)

    return pack


def pack(cut: DataFrame, id_col: str = "doc_id", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """cut: the result of pieces(). One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    names = ["_id", "piece", "start", "length", "ids_crc32"]
    kind = cut.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, _row long, _block long, sequence_id long, offset long, _done boolean"
    left = cut.withColumn("_row", F.xxhash64("_id", "piece", "ids_crc32", "length"))
    left = scratch(left, "pieces")
    # a piece of full length is a sequence of its own, numbered by where it lies in the written table
    full = left.where(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id())
    whole = [full.select(*names, F.negative(F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = left.where(F.col("length") < length)
    n, first = left.count(), 0
    while True:
        blocks = max(1, -(-n // block))
        dealt = left.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(first)), F.lit(blocks)) + first)
        packed = scratch(dealt.groupBy("_block").applyInPandas(_pack_block(length), schema), "packed")
        rest = packed.where("not _done").count()
        last = blocks == 1 or rest < 2 or rest > 0.9 * n
        whole.append((packed if last else packed.where("_done")).select(*names, "sequence_id", "offset"))
        if last:
            break
        left, n, first = packed.where("not _done").select(*names, "_row"), rest, first + blocks
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
