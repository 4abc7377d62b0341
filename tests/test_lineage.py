"""Paths of sessions by written rounds, and roots that are kept."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import lineage
from sessionlake.scratch import Scratch

SCHEMA = "id string, parent_session_id string, forked_from string"


def brute(rows):
    step = {i: p if p is not None else (f or "").split("#")[0] for i, p, f in rows}
    out = {}
    for i, _, _ in rows:
        path = [i]
        while step[path[-1]] in step:
            path.append(step[path[-1]])
            if path[-1] in path[:-1]:
                break
        out[i] = (path[-1], len(path) - 1, path)
    return out


def test_paths_of_chains_forks_and_cycles_beyond_the_row_limit(spark):
    rows = [("a0", None, None), *[(f"a{i}", f"a{i - 1}", None) for i in range(1, 13)]]
    rows += [("f", None, "a3#7"), ("g", "gone", "a3#7"), ("x", "y", None), ("y", "z", None), ("z", "y", None), ("own", "own", None)]
    sessions = spark.createDataFrame(rows, SCHEMA)
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20")
    try:
        got = {r["id"]: (r["root"], r["depth"], r["path"]) for r in lineage.paths(sessions).collect()}
        some = {r["id"]: r["path"] for r in lineage.paths(sessions, sessions.filter("id in ('a12', 'x')").select("id")).collect()}
    finally:
        spark.conf.set(limit, before)
    assert got == brute(rows)
    assert some == {i: brute(rows)[i][2] for i in ("a12", "x")}
    assert lineage.paths(sessions.limit(0)).count() == 0


def test_a_few_paths_are_looked_up_by_level(spark):
    rows = [("a0", None, None), *[(f"a{i}", f"a{i - 1}", None) for i in range(1, 13)]]
    rows += [("f", None, "a3#7"), ("g", "gone", "a3#7"), ("x", "y", None), ("y", "z", None), ("z", "y", None), ("own", "own", None)]
    sessions = spark.createDataFrame(rows, SCHEMA)
    want, asked = brute(rows), ("a12", "a2", "f", "g", "x", "own")
    got = lineage.paths_of_few(sessions, sessions.filter(sessions["id"].isin(*asked)).collect())
    assert got == {i: (want[i][0], want[i][2]) for i in asked}


def forest(r, n, ids):
    """Random steps: parents that are there or not, forks, cycles."""
    out = {}
    for i in r.sample(ids, n):
        p = r.choice([None, r.choice(ids), r.choice(ids), "gone"])
        out[i] = (p, None) if p is None or r.random() < 0.7 else (None, f"{p}#3")
    return out


def kept(spark, stored, before, new, gone=()):
    """The stored rows after a change."""
    old = spark.createDataFrame([tuple(v) for v in stored.values()], lineage.ROOTS)
    there = spark.createDataFrame([(i,) for i in before], "id string")
    rows = spark.createDataFrame([(i, *v) for i, v in new.items()], SCHEMA).select("id", lineage.wanted().alias("step"))
    got = lineage.updated(old, there, rows, spark.createDataFrame([(i,) for i in gone], "id string"))
    got = {r["id"]: r for r in got.collect()} if got is not None else {}
    assert not [i for i, r in got.items() if i in stored and stored[i] == r]  # only what differs
    return {i: r for i, r in (stored | got).items() if r["step"] is not None}


@pytest.mark.parametrize("seed", range(4))
def test_kept_roots_are_those_of_the_walk_after_random_changes(spark, seed):
    r, ids = random.Random(seed), [f"s{k}" for k in range(14)]
    held, stored = {}, {}
    for _ in range(4):
        new = forest(r, r.randrange(1, 8), ids)
        gone = set(r.sample(sorted(held), min(len(held), 2))) | (new.keys() & held.keys())
        stored = kept(spark, stored, held, new, gone)
        held = {i: v for i, v in held.items() if i not in gone} | new
        want = {i: (root, depth) for i, (root, depth, _) in brute([(i, *v) for i, v in held.items()]).items()}
        assert {i: (stored[i]["root"], stored[i]["depth"]) if i in stored else (i, 0) for i in held} == want
        assert stored.keys() == {i for i, (p, f) in held.items() if p or f}


def test_a_long_chain_takes_rounds_by_the_logarithm_of_its_depth(spark, monkeypatch):
    n, written = 10_000, []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    new = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("step"))
    none = new.select("id").limit(0)
    got = lineage.updated(spark.createDataFrame([], lineage.ROOTS), none, new, none)
    assert got.filter("root = '0' and depth = cast(id as long) and tree = '0' and not cyclic").count() == n - 1
    assert len([w for w in written if w.startswith("round")]) <= 16
    written.clear()
    leaf = spark.createDataFrame([("leaf", "9999")], "id string, step string")
    more = lineage.updated(got, new.select("id"), leaf, none).collect()
    assert [(r["id"], r["root"], r["depth"]) for r in more] == [("leaf", "0", n)] and len([w for w in written if w.startswith("round")]) == 1
