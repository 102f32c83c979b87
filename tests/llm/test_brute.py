"""Digests and the classifier's training against plain versions written from their definitions."""

import math
import random

import numpy as np
import pytest

from ruleloom.llm import fingerprints, quality


def plain_digest(raw):
    """A byte of the length's logarithm, then two bits a bucket by the quartiles of the triplets' counts."""
    counts, mask = [0] * 512, (1 << 32) - 1
    for k in range(len(raw) - 2):
        h = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1 & mask
        h ^= h >> 15
        counts[(h * 0x85EBCA6B & mask) >> 23] += 1
    quartiles = [sorted(counts)[at] for at in (127, 255, 383)]
    code = [sum(c > q for q in quartiles) for c in counts]
    packed = bytes(code[k] << 6 | code[k + 1] << 4 | code[k + 2] << 2 | code[k + 3] for k in range(0, 512, 4))
    return bytes([min(255, round(12 * math.log1p(len(raw))))]) + packed


def plain_likeness(a, b):
    apart = abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        for shift in (0, 2, 4, 6):
            d = abs((x >> shift & 3) - (y >> shift & 3))
            apart += 6 if d == 3 else d
    return 1 - apart / (6 * 512 + 255)


def test_digests_and_likeness():
    rng = random.Random(4)
    texts = [b"", b"a", b"ab", b"abc", "é😀".encode() * 30, bytes(5000), *("".join(rng.choices("abcdef  \n", k=rng.randint(3, 3000))).encode() for _ in range(12))]
    got = fingerprints.digests(texts)
    want = [plain_digest(t) for t in texts]
    assert [x.tobytes() for x in got] == want
    likeness = fingerprints.likeness(got[:-1], got[1:])
    assert likeness.tolist() == pytest.approx([plain_likeness(a, b) for a, b in zip(want[:-1], want[1:], strict=True)], abs=1e-12)


def test_one_step_of_training_follows_the_loss(monkeypatch):
    """The step that fit() takes is that of the mean logistic loss's slope, by finite differences of a plain score."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    rows = [{3: 1.0, 7: 0.5}, {7: -0.4, 9: 0.8, 11: 0.3}, {3: 0.2, 11: 1.5}, {9: 0.7}]
    labels = np.array([1, 0, 1, 0])
    assert len(rows) <= quality.BATCH
    of = np.repeat(np.arange(4), [len(r) for r in rows])
    i, x = np.array([k for r in rows for k in r]), np.array([v for r in rows for v in r.values()])
    v0 = np.random.default_rng(0).normal(0, 0.02, (quality.RANK, quality.SIZE))
    used = sorted({k for r in rows for k in r})
    start = {"bias": 0.0, **{("w", k): 0.0 for k in used}, **{("v", f, k): v0[f, k] for f in range(quality.RANK) for k in used}}

    def loss(p, decayed):
        total = 0.0
        for r, y in zip(rows, labels, strict=True):
            raw = p["bias"] + sum(p["w", k] * a for k, a in r.items())
            for k, a in r.items():
                for j, b in r.items():
                    if k < j:
                        raw += a * b * sum(p["v", f, k] * p["v", f, j] for f in range(quality.RANK))
            total += math.log1p(math.exp(-raw if y else raw)) / len(rows)
        return total + (0.5 * quality.DECAY * p[decayed] ** 2 if decayed != "bias" else 0)

    def stepped(key, h=1e-5):
        up, down = (loss(start | {key: start[key] + s * h}, key) for s in (1, -1))
        g = (up - down) / (2 * h)
        return start[key] - quality.RATE * g / math.sqrt(1e-2 + g * g)

    bias, w, v = quality.fit(of, i, x, labels)
    assert bias == pytest.approx(stepped("bias"), abs=1e-6)
    assert [w[k] for k in used] == pytest.approx([stepped(("w", k)) for k in used], abs=1e-6)
    assert [v[f, k] for f in range(quality.RANK) for k in used] == pytest.approx([stepped(("v", f, k)) for f in range(quality.RANK) for k in used], abs=1e-6)
    assert np.count_nonzero(w) == len(used)
