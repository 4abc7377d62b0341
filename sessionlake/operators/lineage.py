"""Session lineage: each session's step to its parent or fork source, the path of steps and its root.

The step is the parent, else the session before ``#`` in ``forked_from``; a parent that is not archived
stops the walk, without falling back to the fork. Paths end at the first repeat, after it is
appended. Steps are followed for the asked sessions only, all together: one join per level of depth, so at
most the longest chain's number of rounds, none of which holds the whole forest. Rounds are written tables: Spark's
recursive statement stops at a million walked rows (``spark.sql.cteRecursionRowLimit``), these at no number.

Roots can be kept instead of walked (``ROOTS``): a row for each session that has a step, with its root, the number of steps to it and its tree (the root, or the least
id of the cycle that it leads into). :func:`updated` says what a change of sessions does to these rows: only trees that the change touches are solved again, by doubling
of pointers, so in rounds by the logarithm of the depth, and only rows that come out differently are given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch

ROOTS = "id string, step string, root string, tree string, depth long, cyclic boolean"


def wanted() -> Column:
    """A session's step, archived or not."""
    return F.coalesce("parent_session_id", F.split_part("forked_from", F.lit("#"), F.lit(1)))


def edges(sessions: DataFrame) -> DataFrame:
    """(id, next): the step of every session that has one within the archive."""
    steps = sessions.select("id", wanted().alias("next")).filter("next is not null")
    return steps.join(sessions.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next")


def paths(sessions: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, root, depth, path) of the asked ids (all sessions by default), however many they are and however deep."""
    spark = sessions.sparkSession
    scratch = Scratch(spark, "lineage")
    steps = scratch.write(edges(sessions).withColumnRenamed("id", "node"), "edges")
    walk = (sessions if asked is None else asked).select("id", F.col("id").alias("node"), F.array("id").alias("path"))
    rounds, schema = [], None
    while True:
        last = F.col("next").isNull()
        walk = walk.join(steps, "node", "left").select(
            "id", F.coalesce("next", "node").alias("node"), F.when(last, F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"),
            (last | F.array_contains("path", F.col("next"))).alias("ended"),
        )
        walk, schema = scratch.write(walk, f"round{len(rounds)}"), schema or walk.schema
        rounds.append(scratch.path(f"round{len(rounds)}"))
        walk = walk.filter(~F.col("ended")).drop("ended")
        if walk.isEmpty():
            break
    walked = spark.read.schema(schema).parquet(*rounds).filter("ended")
    return walked.groupBy("id").agg(F.max_by("node", F.size("path")).alias("root"), (F.max(F.size("path")) - 1).alias("depth"), F.max_by("path", F.size("path")).alias("path"))


def resolved(work: DataFrame, ends: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """ROOTS of ``work`` (id, step, none null); ``ends``: id, root, tree, depth and cyclic of archived sessions outside it that steps lead to.

    Every round doubles the way that a pointer has gone, until it meets a row that is solved. Sessions on cycles never do: once neither the number of open rows nor that of
    the sessions they point to falls, these sessions are the cycles' own. Each is its own root at a cycle's length, and what leads to them is solved against them.
    """
    inside = work.select(F.col("id").alias("step"), F.lit(True).alias("inside"))
    beyond = ends.select(F.col("id").alias("step"), F.struct("root", "tree", F.col("depth").cast("long").alias("depth"), "cyclic").alias("e"))
    within = F.col("inside").isNotNull()
    state = work.join(inside, "step", "left").join(beyond, "step", "left").select(
        "id", "step", F.when(within, F.col("step")).alias("to"), F.when(~within, F.coalesce("e.root", "id")).alias("root"), F.when(~within, F.coalesce("e.tree", "id")).alias("tree"),
        F.when(within, F.lit(1)).otherwise(F.coalesce(F.col("e.depth") + 1, F.lit(0))).cast("long").alias("depth"), F.coalesce("e.cyclic", F.lit(False)).alias("cyclic"), F.col("id").alias("least"),
    )
    k, before = 0, None
    while True:
        state = scratch.write(state, f"{tag}{k}")
        unsolved = state.filter("to is not null")
        now = tuple(unsolved.agg(F.count(F.lit(1)), F.countDistinct("to")).first())
        if not now[0] or (now == before and 2**k >= now[1]):
            break
        there = state.select(F.col("id").alias("to"), F.struct("to", "root", "tree", "depth", "cyclic", "least").alias("t"))
        moves = F.col("to").isNotNull()
        state = state.join(there, "to", "left").select(
            "id", "step", F.col("t.to").alias("to"), F.coalesce("root", "t.root").alias("root"), F.coalesce("tree", "t.tree").alias("tree"),
            F.when(moves, F.col("depth") + F.col("t.depth")).otherwise(F.col("depth")).alias("depth"), F.when(moves, F.col("t.cyclic")).otherwise(F.col("cyclic")).alias("cyclic"),
            F.least("least", "t.least").alias("least"),
        )
        k, before = k + 1, now
    columns = ["id", "step", "root", "tree", "depth", "cyclic"]
    done = state.filter("to is null").select(columns)
    if not now[0]:
        return done
    on = unsolved.select(F.col("to").alias("id")).distinct()
    loops = unsolved.join(on, "id", "left_semi")
    sizes = loops.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    loops = loops.join(sizes, "least").select("id", "step", F.col("id").alias("root"), F.col("least").alias("tree"), F.col("size").alias("depth"), F.lit(True).alias("cyclic"))
    loops = scratch.write(loops, f"{tag}cycles")
    return done.unionByName(loops).unionByName(resolved(unsolved.join(on, "id", "left_anti").select("id", "step"), loops.drop("step"), scratch, f"{tag}to-cycles"))


def updated(stored: DataFrame, before: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame | None:
    """The ROOTS that a change makes differ, or None; of sessions that have no step any more, with a null step.

    ``stored``: ROOTS of the sessions (``before``: id) that have a step; ``new``: id and step of written sessions; ``gone``: ids of replaced ones, which are removed where they are not
    in ``new``. Touched are the trees of sessions that come, go or change their step, of those that name one which comes or goes, and cyclic trees that a changed session leads to.
    """
    scratch = Scratch(stored.sparkSession, "roots")
    alive = new.select("id", "step", F.lit(True).alias("alive"))
    lost = gone.select("id").distinct().join(new, "id", "left_anti").select("id", F.lit(None).cast("string").alias("step"), F.lit(False).alias("alive"))
    old = stored.select("id", F.col("step").alias("old"), F.col("tree").alias("old_tree"))
    changed = alive.unionByName(lost).join(old, "id", "left").join(before.select("id", F.lit(True).alias("there")), "id", "left")
    changed = changed.withColumn("moved", F.col("alive") != F.coalesce("there", F.lit(False))).filter(F.col("moved") | ~F.col("step").eqNullSafe(F.col("old"))).drop("there")
    changed = scratch.write(changed, "changed")
    named = stored.join(changed.filter("moved").select(F.col("id").alias("step")), "step", "left_semi").select("tree")
    loops = stored.filter("cyclic").join(changed.select(F.col("step").alias("id")), "id", "left_semi").select("tree")
    trees = changed.select(F.coalesce("old_tree", "id").alias("tree")).unionByName(named).unionByName(loops).distinct()
    still = stored.join(changed, "id", "left_anti")
    work = still.join(trees, "tree", "left_semi").select("id", "step").unionByName(changed.filter("alive and step is not null").select("id", "step"))
    work = scratch.write(work, "work")
    targets = work.select(F.col("step").alias("id")).distinct().join(work, "id", "left_anti")
    live = before.select("id").join(changed.filter("not alive"), "id", "left_anti").unionByName(new.select("id")).distinct()
    ends = targets.join(live, "id", "left_semi").join(still.drop("step"), "id", "left")
    ends = ends.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("tree", "id").alias("tree"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    known = stored.select("id", F.struct("step", "root", "tree", "depth", "cyclic").alias("known"))
    rows = resolved(work, ends, scratch, "round").join(known, "id", "left")
    rows = rows.filter(~F.struct("step", "root", "tree", "depth", "cyclic").eqNullSafe(F.col("known"))).drop("known")
    bare = changed.filter("old is not null and step is null").select("id", "step", F.col("id").alias("root"), F.col("id").alias("tree"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"))
    out = scratch.write(rows.unionByName(bare), "rows")
    return None if out.isEmpty() else out


def step(row) -> str | None:
    """The same step, of one session's row."""
    if row["parent_session_id"] is not None:
        return row["parent_session_id"]
    return row["forked_from"].split("#")[0] if row["forked_from"] is not None else None


def paths_of_few(sessions: DataFrame, rows: list, of: set[str] | None = None) -> dict[str, tuple[str, list[str]]]:
    """id -> (root, path), as :func:`paths` has them, of a few sessions' rows (id, parent_session_id, forked_from), no more than a search has candidates: one lookup for each level.

    ``of`` asks for some of the rows only."""
    spark = sessions.sparkSession
    known = {r["id"]: step(r) for r in rows}
    rows = [r for r in rows if of is None or r["id"] in of]
    ask = set()
    for r in rows:  # what the rows' own chains lack
        node, seen = r["id"], set()
        while node is not None and node in known and node not in seen:
            seen.add(node)
            node = known[node]
        ask |= {node} - known.keys() - {None}
    while ask:
        few = spark.createDataFrame([(i,) for i in sorted(ask)], "id string")
        got = sessions.select("id", "parent_session_id", "forked_from").join(F.broadcast(few), "id", "left_semi").collect()  # no more rows than were asked
        known |= {r["id"]: step(r) for r in got}
        ask = {step(r) for r in got} - {None} - known.keys()
    out = {}
    for r in rows:
        path, node = [r["id"]], known[r["id"]]
        while node is not None and node in known:
            path.append(node)
            if node in path[:-1]:
                break
            node = known[node]
        out[r["id"]] = (path[-1], path)
    return out
