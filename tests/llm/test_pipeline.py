import collections
import re

import corpus_pipeline
from ruleloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import empty, odd
from tests.util import SF, database, rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    sizes = [len(ids)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        got = docs.collect()
        assert {r["doc_id"] for r in got} <= ids
        ids = {r["doc_id"] for r in got}
        sizes.append(len(ids))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k in (1, 2):
            assert len(got) == len(ids)
        docs = spark.createDataFrame(got, docs.schema)
    assert sizes == sorted(sizes, reverse=True)
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls, repeated ids, very long texts and clashing names; and no rows at all."""
    docs = odd(spark)
    rows_ = docs.collect()
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        got = docs.collect()
        kept.append((name, got))
        if name != "packing":
            assert docs.columns == columns and {tuple(r) for r in got} <= {tuple(r) for r in rows_}
        docs = spark.createDataFrame(got, docs.schema)
    spaced = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    after = dict(kept)
    assert sorted(spaced(r["text"]) for r in after["exact dedup"]) == sorted({spaced(r["text"]) for r in after["quality"]})
    assert {r["doc_id"] for r in after["packing"]} == {r["doc_id"] for r in after["mixing"]} and all((r["text"] or "").strip() for r in after["mixing"])
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_exact_dedup_against_sql(spark):
    name = "op10_exact_dedup"
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(database().sql(ORACLE_SQL[name]).df())
