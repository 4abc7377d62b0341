"""Ranked search over sessions: candidates, session scores, lineage collapse and context.

Candidates are found in the postings by a distributed plan, which ends in the cap of ``MOST_CANDIDATES`` hits. Their snippets, their sessions' rows and
the texts of the results' context are fetched by broadcast of the few ids; what is done with them is :mod:`tail`, on the driver. ``grouped``, ``scored`` and
``collapsed`` are the same steps as DataFrames, for hits of any number.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X, values as V
from ..functions.analysers import PORTABLE, Analyser
from ..functions.snippet import snippet_column
from ..plans.query import Plan, plan as plan_query
from . import fulltext, lineage, tail, topk

PER_SESSION = 50
CANDIDATES_PER_RESULT, LEAST_CANDIDATES, MOST_CANDIDATES = 50, 500, 5000
WEIGHTS = {"best_match": 1.0, "hit_coverage": 0.25, "term_coverage": 0.35, "kind": 0.2, "recency": 0.25, "title": 0.15}
MEMBER_SHARE = 0.1
CONTEXT_ANCESTORS = 2000


def candidate_cap(limit: int) -> int:
    return max(LEAST_CANDIDATES, min(MOST_CANDIDATES, limit * CANDIDATES_PER_RESULT))


def filtered(sessions: DataFrame, agent: str | None = None, cwd: str | None = None, since_ms: int | None = None) -> DataFrame:
    if agent is not None:
        sessions = sessions.filter(F.col("agent") == agent)
    if cwd is not None:
        sessions = sessions.filter(X.contains_ascii(F.col("cwd"), cwd))
    if since_ms is not None:
        sessions = sessions.filter(F.coalesce("ended_at_ms", "started_at_ms") >= since_ms)
    return sessions


def ranked_hits(hits: DataFrame, per_session: int = PER_SESSION) -> DataFrame:
    """The best hits of each session, numbered; equal scores in order of idx."""
    order = Window.partitionBy("session_id").orderBy("bm25", "idx")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_session)


def capped(hits: DataFrame, cap: int) -> DataFrame:
    return hits.orderBy("bm25", "session_id", "idx").limit(cap)


def candidates(events: DataFrame, sessions: DataFrame | None, plan: Plan, cap: int, posts: DataFrame | None = None, totals: tuple[int, float] | None = None) -> DataFrame:
    """session_id, idx, bm25 of the capped hits of the given (already filtered) sessions, or of all; from postings where they are stored."""
    if posts is None:
        scored = fulltext.bm25(fulltext.index(events), plan)
    else:
        found, at = fulltext.candidates_from_postings(posts, plan)
        scored = fulltext.bm25(found, plan, totals=totals, toks=at)
    return best_hits(scored if sessions is None else scored.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi"), cap)


def best_hits(scored: DataFrame, cap: int) -> DataFrame:
    """session_id, idx, bm25 of the best hits: of each session, then of all."""
    return capped(ranked_hits(scored), cap).select("session_id", "idx", "bm25")


def texts(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Capped hits with their kind and text."""
    return events.select("session_id", "idx", "kind", "text").join(F.broadcast(hits), ["session_id", "idx"])  # at most MOST_CANDIDATES rows


def grouped(hits: DataFrame, sessions: DataFrame, terms: list[str]) -> DataFrame:
    """One row per session: hits, covered terms and the best hit; ``shown`` is the text that coverage looks at."""
    hits = hits.join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id")
    seen = F.concat(F.lower(F.coalesce("shown", F.lit(""))), F.lit(" "), F.lower(F.coalesce("title", F.lit(""))))
    hits = hits.withColumn("covered", X.covered(terms, seen))
    best = F.min_by(F.struct("idx", "kind", "bm25", F.col("shown").alias("snippet")), F.struct("bm25", "idx"))
    return hits.groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"), best.alias("best"))


def scored(groups: DataFrame, sessions: DataFrame, terms: list[str], as_of_ms: int) -> DataFrame:
    """Each session's seven parts and their weighted sum."""
    rows = groups.join(sessions.withColumnRenamed("id", "session_id"), "session_id").withColumn("relevance", -F.col("best.bm25"))
    # Normalisers over all sessions of the capped hits, so at most MOST_CANDIDATES rows in the one window.
    every = Window.partitionBy()
    norm = {"low": F.min("relevance"), "high": F.max("relevance"), "most": F.max(F.log1p("hits"))}
    rows = rows.withColumns({f"n_{k}": c.over(every) for k, c in norm.items()})
    of = lambda c: F.col(f"n_{c}")
    spread = of("high") - of("low")
    title = F.lower(F.coalesce("title", F.lit("")))
    all_in_title = F.lit(bool(terms))
    for t in terms:
        all_in_title = all_in_title & title.contains(t)
    parts = {
        "best_match": F.when(spread < 2.220446049250313e-16, F.lit(1.0)).otherwise((F.col("relevance") - of("low")) / spread),
        "hit_coverage": F.log1p("hits") / F.greatest(F.lit(1.0), of("most")),
        "term_coverage": F.col("n_covered") / F.lit(float(len(terms))) if terms else F.lit(1.0),
        "kind": V.kind_weight(F.col("best.kind")),
        "recency": V.recency(F.col("ended_at_ms"), as_of_ms),
        "title": all_in_title.cast("double"),
    }
    rows = rows.withColumns({f"p_{k}": c for k, c in parts.items()})
    return rows.withColumn("score", sum((F.lit(w) * F.col(f"p_{k}") for k, w in WEIGHTS.items()), F.lit(0.0)))


def _order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("ended_at_ms").desc_nulls_last(), F.col("session_id").asc()]


def collapsed(rows: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """One row per lineage root: the best member, with the others' hits, a tenth of their scores and their ids in order."""
    rows = rows.join(paths.select(F.col("id").alias("session_id"), "root", "path"), "session_id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "session_id"))
    by_root = Window.partitionBy("root").orderBy(*_order())
    rows = rows.withColumn("rn", F.row_number().over(by_root))
    own = [c for c in rows.columns if c not in ("rn", "root")]
    others = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "session_id", "path"))))
    out = rows.groupBy("root").agg(
        F.min_by(F.struct(*[F.col(c) for c in own]), "rn").alias("r"),
        F.sum("hits").alias("all_hits"),
        (F.coalesce(F.sum(F.when(F.col("rn") > 1, F.col("score"))), F.lit(0.0)) * MEMBER_SHARE).alias("lineage"),
        others.alias("others"),
    )
    out = out.select("root", *[F.col(f"r.{c}").alias(c) for c in own if c not in ("hits", "score")], F.col("all_hits").alias("hits"), (F.col("r.score") + F.col("lineage")).alias("score"), F.col("lineage").alias("p_lineage"), "others")
    return out.withColumn("related", F.transform("others", lambda x: x["session_id"])).orderBy(*_order()).limit(limit)


def bookends(events: DataFrame) -> DataFrame:
    """session_id, ask (first user text), outcome (last assistant text)."""
    talk = events.filter(F.col("kind").isin("user", "assistant"))
    ask = F.min_by("text", F.when(F.col("kind") == "user", F.col("idx")))
    outcome = F.max_by("text", F.when(F.col("kind") == "assistant", F.col("idx")))
    return talk.groupBy("session_id").agg(ask.alias("ask"), outcome.alias("outcome")).select("session_id", X.preview(F.col("ask")).alias("ask"), X.preview(F.col("outcome")).alias("outcome"))


def few(spark: SparkSession, ids: list[str], name: str) -> DataFrame:
    """At most as many ids as a search has candidates, for a join by broadcast; as an Arrow table they are a local relation, which costs no job."""
    return F.broadcast(spark.createDataFrame(pa.table({name: pa.array(ids, pa.string())})))


def local(spark: SparkSession, top: list) -> DataFrame:
    """Capped hits as a local relation."""
    columns = {"session_id": pa.string(), "idx": pa.int64(), "bm25": pa.float64()}
    return spark.createDataFrame(pa.table({c: pa.array([r[c] for r in top], t) for c, t in columns.items()}))


#: A table, or what makes it.
Later = DataFrame | Callable[[], DataFrame]


def now(table: Later) -> DataFrame:
    return table if isinstance(table, DataFrame) else table()


def search(events: Later, sessions: Later, query: str, as_of_ms: int, limit: int = 20, agent: str | None = None, cwd: str | None = None, since_ms: int | None = None, snippets: bool = True, posts: Later | None = None, totals: tuple[int, float] | None = None, analyser: Analyser = PORTABLE, stored: topk.Lists | None = None, roots: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked sessions for a query, best first. Without ``snippets``, coverage looks at whole texts and all stays in the JVM.

    ``stored`` lists of postings find the candidates without reading all of ``posts``, where the query is one of lists. The hits' texts, the sessions' rows and
    their first and last texts are then fetched side by side. Tables may be given as functions, which are called when they are needed. ``roots`` gives the kept roots of
    a few ids: lineages are then told without a walk, and steps are followed for the results alone, whose context may come from above.
    """
    spark, plan = SparkSession.active(), plan_query(query, analyser)
    if plan.empty or limit <= 0 or plan.expr is None:
        return spark.createDataFrame([], tail.RESULT)
    if posts is None and not analyser.plain:
        idx = fulltext.index(now(events), analyser=analyser)
        n = fulltext.statistics(idx).first()
        posts, totals = fulltext.postings(idx), (n["n_docs"], n["avgdl"])
    own = None if agent is None and cwd is None and since_ms is None else filtered(now(sessions), agent, cwd, since_ms)
    top = topk.top(plan, stored, candidate_cap(limit), best_hits, own) if stored else None
    if top is None:
        top = candidates(now(events), own, plan, candidate_cap(limit), None if posts is None else now(posts), totals).collect()  # at most MOST_CANDIDATES rows
    if not top:
        return spark.createDataFrame([], tail.RESULT)
    events, sessions = now(events), now(sessions)
    ids = sorted({r["session_id"] for r in top})

    def ends(of: list[str]) -> dict:
        """First and last texts of sessions, shortened."""
        return {r["session_id"]: r for r in bookends(events.join(few(spark, of, "session_id"), "session_id", "left_semi")).collect()}

    def cards() -> dict:
        """The sessions' rows."""
        rows = sessions.select("id", "agent", "cwd", "title", "started_at_ms", "ended_at_ms", "parent_session_id", "forked_from")
        return {r["id"]: r for r in rows.join(few(spark, ids, "id"), "id", "left_semi").collect()}

    def kept() -> dict[str, str] | None:
        """The roots of the sessions that have a step."""
        return {r["id"]: r["root"] for r in roots(few(spark, ids, "id")).select("id", "root").collect()} if roots else None

    with ThreadPoolExecutor(3) as at_once:  # jobs side by side
        talk, found, known = at_once.submit(ends, ids), at_once.submit(cards), at_once.submit(kept)
        shown = snippet_column(F.col("text"), [p.places() for p in plan.phrases], analyser) if snippets else F.col("text")
        hits = texts(local(spark, top), events).withColumn("shown", shown)
        snippet = F.col("shown") if snippets else F.lit(None).cast("string")
        rows = hits.select("session_id", "idx", "kind", "bm25", snippet.alias("snippet"), X.covered(plan.terms, F.lower(F.coalesce("shown", F.lit("")))).alias("covered")).collect()
        talk, found, known = talk.result(), found.result(), known.result()
    groups = tail.grouped([r for r in rows if r["session_id"] in found], found, plan.terms)
    tail.scored(groups, plan.terms, as_of_ms, WEIGHTS)
    paths = {} if known is not None else lineage.paths_of_few(sessions, list(found.values()))
    results = tail.collapsed(groups, {i: root for i, (root, _) in paths.items()} if known is None else known, limit, MEMBER_SHARE)
    if known is not None:
        paths = lineage.paths_of_few(sessions, list(found.values()), {i for r in results for i in (r.best.id, *r.related)})
    lines = tail.members(results, paths, CONTEXT_ANCESTORS)
    if further := sorted({i for line in lines for i in line} - set(ids)):  # ancestors without hits
        talk |= ends(further)
    first = lambda line, what: next((talk[i][what] for i in line if i in talk and talk[i][what] is not None), None)
    out = [r.row(first(line, "ask"), first(line, "outcome")) for r, line in zip(results, lines, strict=True)]
    return spark.createDataFrame(pa.Table.from_pylist([tail.named(r) for r in out], to_arrow_schema(tail.RESULT)), tail.RESULT)


def result(rows: DataFrame) -> DataFrame:
    """The public shape of a result."""
    parts = {k: f"p_{k}" for k in (*WEIGHTS, "lineage")}
    return rows.select(
        F.col("session_id").alias("id"), F.col("root").alias("lineage_root_id"), "agent", "cwd", "title", "started_at_ms", "ended_at_ms", "score",
        F.struct(*[F.col(c).alias(k) for k, c in parts.items()]).alias("score_breakdown"), "hits",
        F.struct(F.col("best.idx").alias("event_idx"), F.col("best.kind").alias("kind"), F.col("best.bm25").alias("bm25"), F.col("best.snippet").alias("snippet")).alias("best_match"),
        "ask", "outcome", F.col("related").alias("related_session_ids"),
    )

