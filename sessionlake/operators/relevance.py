"""Ranking-quality metrics over ranked results and graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import gain


def graded(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, rank, grade): the greatest label among a result's own id, its lineage root and its related sessions."""
    ids = F.array_distinct(F.concat(F.array("id", "lineage_root_id"), "related_session_ids"))
    each = results.select("query_id", "rank", F.explode(ids).alias("session_id"))
    hit = each.join(labels.select("query_id", "session_id", "grade"), ["query_id", "session_id"], "left")
    return hit.groupBy("query_id", "rank").agg(F.coalesce(F.max("grade"), F.lit(0)).alias("grade"))


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """ranked: query_id, rank from 1, grade."""
    first = F.min(F.when(F.col("grade") > 0, F.col("rank")))
    return ranked.groupBy("query_id").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def ndcg(ranked: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    discount = lambda r: F.log2(r.cast("double") + 1)
    dcg = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade")) / discount(F.col("rank"))).alias("dcg"))
    best = F.slice(F.reverse(F.array_sort(F.collect_list("grade"))), 1, k)
    gains = F.transform(best, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i.cast("double") + 2))
    ideal = labels.groupBy("query_id").agg(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def recall(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    wanted = labels.groupBy("query_id").agg(F.greatest(F.count_if(F.col("grade") > 0), F.lit(1)).alias("wanted"))
    got = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("got"))
    return wanted.join(got, "query_id", "left").select("query_id", (F.coalesce("got", F.lit(0)) / F.col("wanted")).alias("recall"))


def by_tag(scores: DataFrame, tags: DataFrame, metrics: list[str]) -> DataFrame:
    each = scores.join(tags, "query_id").select(F.explode("tags").alias("tag"), *metrics)
    return each.groupBy("tag").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("queries"))
