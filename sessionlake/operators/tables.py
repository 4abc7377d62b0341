"""Key-based table operators: null-safe comparison, insert-if-absent, replacement, merge conflicts, references, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import glob


def same(columns: list[str], left: str = "a", right: str = "b") -> Column:
    """Null-safe equality of whole rows of two aliased tables."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def on(keys: list[str], left: str = "a", right: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def conflicts(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that both tables hold with different rows."""
    return left.alias("a").join(right.alias("b"), on(keys)).filter(~same(columns)).select(*[F.col(f"a.{k}") for k in keys])


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that are in one table only; nulls are equal to each other."""
    return left.subtract(right).unionByName(right.subtract(left))


def missing(new: DataFrame, old: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks."""
    return new.join(old, keys, "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows win over ``old`` ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def fill(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every key of either table; ``columns`` keep the old value and take the new one where that is null."""
    both = old.alias("a").join(new.alias("b"), on(keys), "full_outer")
    rest = [c for c in old.columns if c not in keys and c not in columns]
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*keys, *columns, *rest]])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def dangling(refs: DataFrame, objects: DataFrame, ref: str = "object_hash", key: str = "hash") -> DataFrame:
    """References to objects that aren't there."""
    return refs.filter(F.col(ref).isNotNull()).join(objects.select(F.col(key).alias(ref)), ref, "left_anti")


def orphans(objects: DataFrame, refs: DataFrame, ref: str = "object_hash", key: str = "hash") -> DataFrame:
    return objects.join(refs.select(F.col(ref).alias(key)), key, "left_anti")


def sticky(old: DataFrame, new: DataFrame) -> DataFrame:
    """New provenance rows, with the old ones that still have a stored object and aren't in them."""
    kept = old.filter(F.col("object_hash").isNotNull()).join(new.select("session_id").distinct(), "session_id", "left_semi").join(new.select("session_id", "locator"), ["session_id", "locator"], "left_anti")
    known = old.select("session_id", "locator", F.col("object_hash").alias("old_hash"))
    filled = new.join(known, ["session_id", "locator"], "left").withColumn("object_hash", F.coalesce("object_hash", "old_hash")).drop("old_hash")
    return filled.unionByName(kept)


def first_of(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def bounds(rows: DataFrame, group: str, at: str, position: str) -> DataFrame:
    """First and last non-null value of ``at`` in order of ``position``."""
    there = F.when(F.col(at).isNotNull(), F.col(position))
    return rows.groupBy(group).agg(F.min_by(at, there).alias("first"), F.max_by(at, there).alias("last"))


def outcomes(found: DataFrame, states: DataFrame, exclude: tuple[str, ...] = (), since_ms: int | None = None) -> DataFrame:
    """Candidates with their outcome: excluded before since before unchanged before pending."""
    known = states.select("locator", F.col("fingerprint").alias("known"), F.col("mode").alias("known_mode"))
    path = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    names = [path(c) for c in ("locator", "path") if c in found.columns]
    hit = reduce(lambda a, b: a | b, [n.rlike(glob(g)) for g in exclude for n in names], F.lit(False))
    old = F.coalesce(F.col("updated_at_ms") < since_ms, F.lit(False)) if since_ms is not None else F.lit(False)
    same_print = F.coalesce((F.col("fingerprint") == F.col("known")) & (F.col("known_mode") == "full"), F.lit(False))
    outcome = F.when(hit, "excluded").when(old, "skipped_by_since").when(same_print, "unchanged").otherwise("pending")
    return found.join(known, "locator", "left").withColumn("outcome", outcome).drop("known", "known_mode")


def spawn_edges(events: DataFrame) -> DataFrame:
    """(parent, child) sessions from pairs of a spawning call and its later output with the same call id; each output serves one call."""
    calls = events.filter((F.col("kind") == "tool_call") & (F.col("name") == "spawn_agent")).select("session_id", "call_id", F.col("idx").alias("called"))
    outs = events.filter(F.col("kind") == "tool_result").select("session_id", "call_id", F.col("idx").alias("answered"), F.get_json_object("text", "$.agent_id").alias("child"))
    pairs = outs.join(calls, ["session_id", "call_id"]).filter("answered > called and child is not null")
    return first_of(pairs, [F.col("session_id"), F.col("call_id")], [F.col("answered"), F.col("called").desc()]).select(F.col("session_id").alias("parent"), "child")


def p95(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank 95th percentile: the value at rank ceil(0.95 n)."""
    return rows.groupBy(group).agg(F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))
