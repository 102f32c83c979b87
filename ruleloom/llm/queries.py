"""The queries of this subpackage, one for each operator, and DuckDB's SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.centroids import cluster
from ruleloom.llm.common import documents, small_batches
from ruleloom.llm.exact_dedup import exact_groups
from ruleloom.llm.fill_middle import digests, fill_middle
from ruleloom.llm.fingerprints import fingerprints
from ruleloom.llm.lm import score
from ruleloom.llm.mixing import mix
from ruleloom.llm.neighbours import nearest
from ruleloom.llm.ngram_join import ngram_components
from ruleloom.llm.packing import pack, pieces
from ruleloom.llm.quality import classify
from ruleloom.llm.sharding import shard
from ruleloom.llm.substring_dedup import PASSAGE_WORDS, dedup
from ruleloom.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_components(documents(spark, sf_dir), n=3, num=90, den=100).drop("keep")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), shards=8)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprints(documents(spark, sf_dir))


def byte_tokenizer() -> tuple[str, str, str]:
    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(pieces(documents(spark, sf_dir), *byte_tokenizer()))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup(documents(spark, sf_dir), min_words=PASSAGE_WORDS, unit="line", passage_words=PASSAGE_WORDS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return nearest(documents(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return cluster(documents(spark, sf_dir, "embeddings"))


def _op12_sql(k: int, rounds: int) -> str:
    """The rounds, written one after another; distances by components in rows."""
    nearest = "SELECT vec_id, c, dist FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS dist FROM comp JOIN cent{r} USING (d) GROUP BY vec_id, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1"
    mean = """SELECT c, d, coalesce(m, y) AS y FROM cent{r} LEFT JOIN
      (SELECT c, d, ((s - ((s % n) + n) % n) / n)::BIGINT AS m FROM (SELECT c, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{r} JOIN comp USING (vec_id) GROUP BY c, d)) USING (c, d)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(f"cent{r + 1} AS MATERIALIZED ({mean.format(r=r)})")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), comp AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS d, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}
), cent0 AS MATERIALIZED (SELECT c, d, x AS y FROM first JOIN comp USING (vec_id)), {", ".join(steps[:-1])},
shas AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, dist AS distance, sum(dist) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(dist) OVER ()::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN shas USING (c)
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(fill_middle(documents(spark, sf_dir)))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS line,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, len(line)::BIGINT AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(line[1:a], '') AS prefix, array_to_string(line[a + 1:b], '') AS middle, array_to_string(line[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_ngram_join, op3_quality, op4_sharding, op5_fingerprints, op6_packing, op7_mixing, op8_lm_score,
        op9_substring_dedup, op10_exact_dedup, op11_nearest_neighbours, op12_centroid_clustering, op13_fill_middle,
    )
}
ORACLE_SQL: dict[str, str] = {"op10_exact_dedup": OP10_SQL, "op12_centroid_clustering": _op12_sql(40, 5), "op13_fill_middle": OP13_SQL}
