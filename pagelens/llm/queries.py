"""The queries of this package: op<N>_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(table(spark, sf_dir, "documents"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_counts

    return secret_counts(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), head=lambda c: F.crc32(c.cast("string")) % 9, family=lambda c: c - c % 5)


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bit_planes import round_trip

    found = round_trip(table(spark, sf_dir, "documents"), byte_vocabulary_path(), unit="byte")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, run_digests, with_tail_repeated

    return run_digests(periodic_runs(with_tail_repeated(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_quality_knn": op2_quality_knn,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_main_text": op6_html_main_text,
    "op7_merkle_fingerprints": op7_merkle_fingerprints,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bit_planes": op12_bit_planes,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    # crc32 byte by byte, bit by bit: a byte and seven zeros are folded in; 3988292384 is the reversed polynomial.
    "op11_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, list({'t': sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'b': strlen(coalesce(text, ''))} ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT c, turns, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384)), 4294967295::BIGINT) % 9 AS h
  FROM own),
built AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON a.base = b.c),
paths AS (
  SELECT c, turns, len(turns) AS n, list_transform(turns, lambda x: x.t) AS p FROM built),
members AS (
  SELECT c, n, d, p[1:d] AS path, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS b FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM paths)),
nodes AS (
  SELECT path, d, min(c) AS c, count(*) AS k, max(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM members GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT a.*, coalesce(b.k, 0) AS children FROM nodes a LEFT JOIN children b ON a.path = b.path),
subtrees AS (
  SELECT path[1:u] AS path, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((k - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_nodes) GROUP BY 1)
SELECT a.c AS conv_id, a.d::BIGINT AS depth, p.c AS parent_conv_id, a.k AS n_convs, a.children AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM full_nodes a JOIN subtrees s ON a.path = s.path LEFT JOIN nodes p ON a.d > 0 AND p.path = a.path[1:a.d - 1]
""",
}
