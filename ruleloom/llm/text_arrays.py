"""Words of many texts at once, as numpy arrays.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased; UTF-8 texts come as bytes. A word's
64-bit hash is a polynomial in its bytes' random codes modulo 2**64, mixed with its length; words of over 128
bytes are hashed by xxhash instead, as such polynomials have known collisions for long strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash

PIECE = 1 << 17
LONG = 128
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = mix(np.arange(1, 257, dtype=U))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * PIECE
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, U)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), U))


def _batches(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of about PIECE bytes: numbers of the texts, and the texts or pieces of long ones, cut at white space."""
    ids: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for piece in [t] if len(t) <= PIECE else _pieces(t):
            if group and size + len(piece) > PIECE:
                yield ids, group
                ids, group, size = [], [], 0
            ids.append(i)
            group.append(piece)
            size += len(piece) + 1
    if group:
        yield ids, group


def _pieces(t: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(t):
        end = min(len(t), at + PIECE)
        while at < end < len(t) and not _SPACE[t[end]]:
            end -= 1
        if end == at:  # a word of over PIECE bytes
            end = at + 1
            while end < len(t) and not _SPACE[t[end]]:
                end += 1
        yield t[at:end]
        at = end


def words(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: lower-cased bytes, words' starts and ends in them, their hashes, and their texts' numbers."""
    for ids, group in _batches(texts):
        raw = np.frombuffer(b"\n" + b"\n".join(group) + b"\n", np.uint8)
        low = _LOWER[raw]
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        lens = np.fromiter(map(len, group), np.int64, len(group)) + 1
        first = np.concatenate([[1], 1 + np.cumsum(lens)[:-1]])
        of = np.asarray(ids, np.int64)[np.searchsorted(first, start, side="right") - 1]
        yield low, start, end, _hashes(low, start, end), of


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(low) > 2 * PIECE:  # holds a word that is longer still
        return np.array([xxhash.xxh3_64_intdigest(low[a:b].tobytes()) for a, b in zip(start, end, strict=True)], U)
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(low) + 1, U)
        np.cumsum(_CODES[low] * up[: len(low)], out=sums[1:])
        out = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - start > LONG):
        out[i] = xxhash.xxh3_64_intdigest(low[start[i] : end[i]].tobytes())
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and where each text's begin (one more entry at the end)."""
    hashes, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, _, h, d in words(texts):
        hashes.append(h)
        of.append(d)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(of), np.arange(len(texts) + 1))


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]
