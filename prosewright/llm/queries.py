"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.ann import search
from prosewright.llm.bpe import encode_texts
from prosewright.llm.centroids import cluster, cluster_sql
from prosewright.llm.common import table
from prosewright.llm.fingerprint import compare_with_edits
from prosewright.llm.langid import identify
from prosewright.llm.license import scan_licenses, scan_sql
from prosewright.llm.mixing import mix, mix_sql
from prosewright.llm.neardup import near_duplicates
from prosewright.llm.packing import pack
from prosewright.llm.repeats import repeated_bytes
from prosewright.llm.tokens import count_tokens
from prosewright.llm.urlfilter import judge_urls, rules_table
from prosewright.llm.variants import group_variants

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op10_fast_similarity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: action, host, path
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op5_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


def op6_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), TOKENIZER, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_position_index_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def op13_centroid_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


URL_SQL = f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}) AS r(action, rule_host, rule_path)),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS named FROM p),
h AS (
  SELECT page_id, translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(named) + 1), '^[^?#]*') AS path FROM q),
m AS (
  SELECT h.*, r.rule_host || r.rule_path AS rule, r.action
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_improbable_features, op2_sum_of_squares_packing, op3_curriculum_mixing, op4_run_length_index, op5_url_bloom_filter, op6_language_bitmasks,
        op7_license_sentences, op8_additive_quantisation, op9_token_counts, op10_fast_similarity_sketches, op11_speculative_bpe,
        op12_position_index_variants, op13_centroid_expressions,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_curriculum_mixing": mix_sql(), "op5_url_bloom_filter": URL_SQL, "op7_license_sentences": scan_sql(), "op13_centroid_expressions": cluster_sql()}
