"""Awkward tables that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, n int, score double, _id string, _text string, keep_id long, key long"
REST = (9, 9, 9, 0.5, "clash", "clash", 9, 9)


def table(spark, texts, source="s"):
    """Rows with ids from 0 and extra columns whose names clash with those used inside."""
    rows = [(i, t, "en", source(i) if callable(source) else source, len(t or ""), *REST) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = [f"w{i}" for i in range(5000)]


def long_text(seed, n):
    return " ".join(WORDS[(i * i * 7 + i * seed + seed) % 5000] for i in range(n))


def odd_texts():
    a, b = long_text(3, 60), long_text(5, 80)
    return [None, "", " \t\n", "one", "One", "two words", "Three plain words", a, a, a + " more", a.upper(), b, b.replace(" ", "  "), b, "é😀 ﬁ \x00 日本語" * 3, long_text(9, 20_000), "x" * 5000, "a b " * 300]


def odd(spark):
    """Nulls in all columns, repeated rows and ties, besides."""
    df = table(spark, odd_texts(), lambda i: None if i % 5 == 4 else f"s{i % 3}")
    extra = df.where("doc_id in (7, 8)").unionByName(df.where("doc_id = 7"))
    nulls = spark.createDataFrame([(None,) * 13, (None, "one", *(None,) * 11)], SCHEMA)
    return df.unionByName(extra).unionByName(nulls)


def empty(spark):
    return table(spark, ["x"]).limit(0)
