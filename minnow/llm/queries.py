"""The registered queries of this subpackage, with production parameters, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minnow.llm import bpe, decontaminate, html, langid, neardup, ngram, quality, rules, secrets, sharding
from minnow.llm.cluster import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.interpolated_scores(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    return langid.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) != 1)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1,
    "op2_minhash_near_dedup": op2,
    "op3_lm_scoring": op3,
    "op4_html_extraction": op4,
    "op5_sharding": op5,
    "op6_language_id": op6,
    "op7_quality_rules": op7,
    "op8_byte_bpe": op8,
    "op9_secret_scans": op9,
    "op10_quality_classifier": op10,
}

OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM g),
win AS (
  SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)
), hits AS (SELECT win.r, win.i, win.m, g.item FROM win JOIN g ON win.gram = g.gram AND win.m = g.m),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""

OP5_SQL = """
WITH r AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS UBIGINT)), 64, '0') AS path
  FROM documents
), l AS (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 65)),
t AS (SELECT depth, substr(path, 1, depth) AS shard, sum(n_bytes) AS b FROM r, l GROUP BY 1, 2),
p AS (SELECT path, min(t.depth) AS depth FROM (SELECT DISTINCT path, depth, substr(path, 1, depth) AS shard FROM r, l) q JOIN t USING (depth, shard) WHERE b <= {limit} GROUP BY 1),
c AS (
  SELECT doc_id, path, n_bytes, greatest(1, {limit} // greatest(n_bytes, 1)) AS per, count(*) OVER (PARTITION BY path, doc_id, n_bytes) AS n,
    (row_number() OVER (PARTITION BY path, doc_id, n_bytes) - 1) // greatest(1, {limit} // greatest(n_bytes, 1)) AS page
  FROM r WHERE path NOT IN (SELECT path FROM p)
)
SELECT doc_id, t.shard, CAST(p.depth AS BIGINT) AS depth, n_bytes, CAST(b AS BIGINT) AS shard_bytes FROM r JOIN p USING (path) JOIN t ON t.depth = p.depth AND t.shard = substr(path, 1, p.depth)
UNION ALL
SELECT doc_id, path || '.' || page, 64, n_bytes, CAST(least(per, n - page * per) * n_bytes AS BIGINT) FROM c
"""

ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": OP1_SQL, "op5_sharding": OP5_SQL.format(limit=sharding.LIMIT)}
