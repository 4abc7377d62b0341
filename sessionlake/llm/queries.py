"""The thin queries ``opN_*``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, fingerprint, langid, licenses, minhash, sharding, spelling, suffix_dedup, time_parts, token_counts, token_files, urls

SHARD_BYTES = 16 * 1024 * 1024
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
COUNT_TOKENIZER = "byte_bpe_50k.json"
MOST_TOKENS = 1024
PARTS = 650
FIRST_BEFORE = "2024-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op3_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op5_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


def op6_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_TOKENIZER), MOST_TOKENS)


def op12_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def click_moment() -> Column:
    """A click's moment: some lie years back, others at the start of their week, by a checksum of the id."""
    ts, k = F.col("ts").cast("timestamp_ntz"), F.pmod(F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))), F.lit(128))
    back = F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))
    return F.when(k < 16, ts - back).when(k > 111, F.trunc(ts.cast("date"), "week").cast("timestamp_ntz")).otherwise(ts)


def op13_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // PARTS
    order = time_parts.Order(click_moment(), ("arrived_at", "click_id"), "click_id")
    first = F.col("arrived_at").cast("timestamp_ntz") < F.lit(FIRST_BEFORE).cast("timestamp_ntz")
    files, _ = time_parts.rewrite(clicks, order, limit, first)
    return files.select("leaf", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", F.col("part").cast("long").alias("part"), "n_rows", "n_new", "rewritten")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_extendible_sharding,
            op2_imatch_fingerprints,
            op3_url_words,
            op4_byte_bpe,
            op5_arrow_token_files,
            op6_suffix_columns,
            op7_dart_minhash,
            op8_language_bitmask,
            op9_license_diagonals,
            op10_qgram_decontamination,
            op11_token_counts,
            op12_spelling_halves,
            op13_time_parts,
        )
    }


def op1_sql(limit: int = SHARD_BYTES) -> str:
    """Buckets by the same hash: of the prefixes of each depth, a row's shard is the shortest that fits; copies that no bit parts fill pages."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    coalesce(doc_id::VARCHAR, chr(30)) AS key, coalesce(doc_id::VARCHAR, chr(30)) || chr(31) || coalesce(text, chr(30)) AS row FROM documents),
h AS (SELECT doc_id, n_bytes, ('0x' || md5(key)[1:6] || md5(row)[1:9])::BIGINT AS h, row_number() OVER (PARTITION BY doc_id, n_bytes, md5(row)) - 1 AS copy FROM d),
s AS (SELECT doc_id, n_bytes, copy, depth::INT AS depth, h >> (60 - depth)::INT AS prefix,
    sum(n_bytes) OVER w AS bytes, count(*) OVER w AS n, h FROM h, range(0, 61) t(depth)
    WINDOW w AS (PARTITION BY depth, h >> (60 - depth)::INT)),
f AS (SELECT doc_id, n_bytes, copy, min(depth) AS local_depth, arg_min(prefix, depth) AS prefix, arg_min(bytes > {limit} AND n > 1, depth) AS crowded
  FROM s WHERE bytes <= {limit} OR n = 1 OR depth = 60 GROUP BY doc_id, n_bytes, copy, h)
SELECT doc_id, n_bytes, CASE WHEN local_depth = 0 THEN '' ELSE lpad(bin(prefix), local_depth, '0') END
  || CASE WHEN crowded AND copy // greatest(1, {limit} // greatest(n_bytes, 1)) > 0 THEN '-' || (copy // greatest(1, {limit} // greatest(n_bytes, 1))) ELSE '' END AS shard,
  local_depth, max(local_depth) OVER () AS global_depth, n_bytes > {limit} AS oversized FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_sharding": op1_sql(), "op2_imatch_fingerprints": fingerprint.oracle_sql(), "op9_license_diagonals": licenses.oracle_sql()}
