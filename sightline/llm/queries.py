"""The operators' registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm.bpe_automaton import encode_decode
from sightline.llm.common import table
from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.fill_in_middle import fill_in_middle, form_digests
from sightline.llm.fingerprints import fingerprints
from sightline.llm.katz import katz_scores
from sightline.llm.language_id import language_id
from sightline.llm.packing import pack_documents, pack_turns
from sightline.llm.periodic_runs import periodic_runs, run_digests, with_repeats
from sightline.llm.sharding import shard
from sightline.llm.simhash import near_duplicates
from sightline.llm.suffix_dedup import removed_spans
from sightline.llm.token_counts import count_tokens
from sightline.llm.topk_search import top_k_of_every


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of instruction data, where all three limits bind."""
    return pack_turns(table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_of_every(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_suffix_dedup, op3_bpe_automaton, op4_language_id, op5_sharding, op6_packing, packed_turns, op7_katz, op8_exact_dedup, op9_simhash, op10_topk_search,
        op11_periodic_runs, op12_fill_in_middle, op13_fingerprints,
    )
}

ORACLE_SQL = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[64], c.v::DOUBLE[64])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q,
    CASE WHEN n = 0 OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, substring(t, 1, p) AS prefix, substring(t, p + 1, q - p) AS middle, substring(t, q + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, (CASE WHEN form <> 'plain' THEN p END)::BIGINT AS prefix_chars, (CASE WHEN form <> 'plain' THEN q - p END)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM x
""",
}
