"""A corpus pipeline of this repository's operators (kept with the subpackage llm).

Each stage takes what its predecessor kept: documents that the quality classifier rejects go; of equal texts the
first stays; of near-duplicate texts (five-word shingles, similarity 0.8 or more) the first stays; sources are mixed
to their target weights, so documents may go or repeat; the last stage gives all pieces' places in sequences.

A null text counts as empty. Rows with null or repeated ids are rows like others: exact dedup goes by text, and of equal
texts the row of the smallest id stays (null ids last); near-duplicates go by id and text. A null source is a source
of its own. Mixing takes no document without words, so null and empty texts end there. Empty tables pass all stages.
All stages but the last keep the columns as they are, whatever further ones there are and however they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.common import documents, scratch, small_batches
from ruleloom.llm.exact_dedup import drop_exact_duplicates
from ruleloom.llm.mixing import apply_mix
from ruleloom.llm.ngram_join import drop_near_duplicates
from ruleloom.llm.packing import pack, pieces
from ruleloom.llm.quality import keep_good
from ruleloom.llm.queries import byte_tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first."""
    return drop_exact_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, always whole; those without words go."""
    return apply_mix(docs, length_col="n_chars", parts=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    small_batches(spark)
    return pack(pieces(docs, *byte_tokenizer()))


STAGES = [("quality", good), ("exact dedup", distinct), ("n-gram join", dissimilar), ("mixing", mixed), ("packing", packed)]
#: The classifier is fitted and the packing is a search; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
