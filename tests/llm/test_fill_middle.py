"""Fill-in-middle on awkward texts, against brute force and its SQL."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import fill_middle as fim
from ruleloom.llm import queries
from tests.llm.cases import empty, odd, table
from tests.util import SF, database, rows

TEXTS = ["a\nb\nc", "\n", "\n\n", "one line", "é\n日本\n😀x\n\nz\n", "tail\r\nmixed\n", "has <M> in\nit", "ends <\n", "<\nP>\n<S\n>", "😀" * 50, "x\n" * 3000, "\x00\n\x00"]


def brute(i, text, unit):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_middle(spark, unit):
    docs = odd(spark).unionByName(table(spark, TEXTS * 4)).unionByName(table(spark, [None, *TEXTS], "t"))
    out = fim.fill_middle(docs, unit=unit, fim_percent=90)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [brute(r["doc_id"], r["text"], unit) for r in docs.collect()]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = collections.Counter(r[0] for r in out.select(fim.restored(F.col("output"), F.col("form"))).collect())
    assert back == collections.Counter(r["text"] or "" for r in docs.collect())


def test_index_converts_every_cut():
    for text in (*TEXTS, "", "aé", "éa", "日é😀a"):
        raw = text.encode()
        index = fim.Exceptions(np.frombuffer(raw, np.uint8))
        at = [len(text[:c].encode()) for c in range(len(text) + 1)]
        assert [index.byte(c) for c in range(len(text) + 1)] == at and [index.char(b) for b in at] == list(range(len(text) + 1))
    assert len(fim.Exceptions(np.frombuffer(b"plain ascii", np.uint8)).at_byte) == 0


def test_empty_table(spark):
    assert fim.fill_middle(empty(spark)).count() == 0


def test_query_matches_its_sql(spark):
    name = "op13_fill_middle"
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(database().sql(queries.ORACLE_SQL[name]).df())
