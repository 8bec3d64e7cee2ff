"""Registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodgetier.llm import bpe, collocations, cotrain, cutting, mixing, outliers, packing, sharding, simhash, suffix, toxicity, vptree, whitening
from lodgetier.llm.base import table


def op1_multinomial_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_table(table(spark, folder, "documents"))


def op3_simple8b_ids(spark: SparkSession, folder: str) -> DataFrame:
    return packing.ids_table(table(spark, folder, "documents"))


def op4_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_vantage_point_trees(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.neighbour_table(table(spark, folder, "embeddings"))


def op6_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotrain.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(table(spark, folder, "documents"))


def op8_bucket_pointer_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeats_table(table(spark, folder, "documents"), with_text=True)


def op9_pair_index_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_table(table(spark, folder, "documents"))


def op10_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality_table(table(spark, folder, "documents"))


def op11_quotient_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.phrase_table(table(spark, folder, "documents"))


def op12_multiplicity_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_table(table(spark, folder, "embeddings"))


def op13_cutting_stock_packing(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.packed_pieces(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Phrases counted word by word in SQL. A-Z and the characters that end a piece, as the contract names them.
_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) sizes(k) WHERE len(ws) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
halves AS MATERIALIZED (
  SELECT cand.*, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
  FROM cand, (VALUES (1), (2)) cuts(cut) WHERE cut < k
), cuts AS (
  SELECT c.*, l.n AS l, r.n AS r, (1000000 * a * a) // (l.n * r.n) AS score
  FROM halves c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most
  FROM cand, (VALUES (1), (2)) starts(i) WHERE k = 3 GROUP BY ALL
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score
FROM lowest c LEFT JOIN inside USING (lang, phrase) JOIN totals t ON t.lang = c.lang
WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL fixes the result; tests compare the others with brute force."""
    return {"op11_quotient_collocations": _PHRASES}
