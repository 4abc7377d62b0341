"""A corpus pipeline: five operators in a row, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir), with the columns of ``documents``, and returns a DataFrame; all but the last return those
columns. ``run`` writes each stage's rows as Parquet into the shared folder and reads them as the next stage's input, so no
stage recomputes another and a lost executor costs its own tasks only.

Cases: null and empty texts have no language and go in the first stage; with no labelled row nothing can be learned, and all texts
with a letter stay; a document emptied by the suffix stage stays, with empty text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.llm import bpe, decontaminate, langid, minhash, suffix_dedup
from sessionlake.llm.common import Scratch

#: A text whose best language holds less than this share of its n-grams is in none of them, unless it has so few of them that the share may be
#: chance: DEVIATIONS of it are allowed for.
LEAST_LANGUAGE = 0.25
DEVIATIONS = 2.0
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones."""
    model = langid.train(docs.filter(~langid.held_out()))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = ("__lang", "__score", "__grams")  # a table's own lang_pred stays as it is
    judged = langid.predict(docs, model, names=names)
    share = F.col("__score")
    most = share + DEVIATIONS * F.sqrt(share * (1 - share) / F.greatest(F.col("__grams"), F.lit(1)))
    return judged.filter((F.col("__lang") != "und") & (most >= LEAST_LANGUAGE)).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.clean(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that long repeated strings cover."""
    return suffix_dedup.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, names=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
