"""Registered queries: each operator over the driver's tables, with its DuckDB twin.

``conversations`` stands for events, one session per conversation; the other session columns are derived by the same
expressions in Spark and SQL (``E``, ``S``). Times are fixed; nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X, values as V
from ..operators import fulltext as T, lineage, listing, relevance, search as R, tables as K
from .query import plan

BASE_MS = 1_767_225_600_000
AS_OF_MS = 1_768_000_000_000
QUERY = "ther ing"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sid(c):
    return F.concat(F.lit("c:"), F.lpad(c.cast("string"), 6, "0"))


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") % 5 == 4, F.lit("tool_result")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select(_sid(F.col("conv_id")).alias("session_id"), F.col("turn").alias("idx"), kind.alias("kind"), "role", "text")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("t"))
    c, start = F.col("conv_id"), F.lit(BASE_MS) + F.col("conv_id") * 60_000
    agents = F.array(*[F.lit(a) for a in ("claude", "codex", "gemini", "opencode", "pi")])
    return per.select(
        _sid(c).alias("id"), F.get(agents, c % 5).alias("agent"), F.concat(F.lit("/workspace/Project-"), (c % 7).cast("string")).alias("cwd"),
        start.alias("started_at_ms"), F.when(c % 11 != 0, start + F.col("n") * 1000).alias("ended_at_ms"),
        F.array_join(F.slice(F.split("t", " "), 1, 6), " ").alias("title"),
        F.when(c % 3 != 2, F.concat(F.lit("m-"), (c % 3).cast("string"))).alias("model"), F.when(c % 2 == 0, F.lit("p-even")).otherwise("p-odd").alias("provider"),
        F.when((c % 4).isin(1, 2), _sid(c - 1)).alias("parent_session_id"), F.when(c % 4 == 3, F.concat(_sid(c - 1), F.lit("#m"))).alias("forked_from"),
        F.when(c % 6 == 0, F.lit("partial")).otherwise("full").alias("mode"), (F.lit(BASE_MS) + c).alias("ingested_at_ms"),
    )


E = """e AS (SELECT 'c:' || lpad(conv_id::VARCHAR, 6, '0') AS session_id, turn AS idx, CASE WHEN turn % 5 = 4 THEN 'tool_result' ELSE role END AS kind, role, text FROM conversations)"""
S = f"""s AS (SELECT 'c:' || lpad(conv_id::VARCHAR, 6, '0') AS id, ['claude', 'codex', 'gemini', 'opencode', 'pi'][conv_id % 5 + 1] AS agent, '/workspace/Project-' || (conv_id % 7) AS cwd,
  {BASE_MS} + conv_id * 60000 AS started_at_ms, CASE WHEN conv_id % 11 != 0 THEN {BASE_MS} + conv_id * 60000 + n * 1000 END AS ended_at_ms,
  array_to_string(string_split(t, ' ')[1:6], ' ') AS title, CASE WHEN conv_id % 3 != 2 THEN 'm-' || (conv_id % 3) END AS model, CASE WHEN conv_id % 2 = 0 THEN 'p-even' ELSE 'p-odd' END AS provider,
  CASE WHEN conv_id % 4 IN (1, 2) THEN 'c:' || lpad((conv_id - 1)::VARCHAR, 6, '0') END AS parent_session_id, CASE WHEN conv_id % 4 = 3 THEN 'c:' || lpad((conv_id - 1)::VARCHAR, 6, '0') || '#m' END AS forked_from,
  CASE WHEN conv_id % 6 = 0 THEN 'partial' ELSE 'full' END AS mode, {BASE_MS} + conv_id AS ingested_at_ms
  FROM (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id))"""
TOKS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


def _freq(terms, prefix=False):
    """Occurrences of a phrase in ``toks``, in SQL."""
    last = len(terms) - 1
    test = " AND ".join(f"starts_with(toks[i + {k}], '{t}')" if prefix and k == last else f"toks[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"len([i FOR i IN range(1, len(toks) + 1) IF {test}])"


def _bm25(source: str, keys: str, query_text: str = QUERY) -> str:
    """CTEs i, c, st, hits: BM25 of the plan's phrases over ``source``."""
    phrases = [p.terms for p in plan(query_text).phrases]
    f = ", ".join(f"{_freq(p)} AS f{k}" for k, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(phrases)))
    idf = [f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END" for k in range(len(phrases))]
    score = " + ".join(f"({w}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k, w in enumerate(idf))
    hit = " OR ".join(f"f{k} > 0" for k in range(len(phrases)))
    return f"""i AS (SELECT {keys}, {TOKS} AS toks FROM {source}), c AS (SELECT {keys}, len(toks) AS dl, {f} FROM i),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM c), hits AS (SELECT {keys}, -({score}) AS bm25 FROM c, st WHERE {hit})"""


GATED = "(SELECT * FROM e WHERE kind NOT IN ('tool_result', 'usage'))"


# Filters and projections


@query(f"WITH {S} SELECT id, agent, cwd, started_at_ms FROM s WHERE agent = 'codex'")
def flt01_sessions_by_agent(spark, d):
    return listing.matching(sessions(spark, d), agent="codex").select("id", "agent", "cwd", "started_at_ms")


@query(f"WITH {S} SELECT id, cwd FROM s WHERE cwd ILIKE '%project-_%' AND cwd ILIKE '%PROJECT-3%'")
def flt02_cwd_substring(spark, d):
    return sessions(spark, d).filter(X.contains_ascii(F.col("cwd"), "project-_") & X.contains_ascii(F.col("cwd"), "PROJECT-3")).select("id", "cwd")


@query(f"WITH {S} SELECT id, coalesce(ended_at_ms, started_at_ms) AS effective_ms FROM s WHERE coalesce(ended_at_ms, started_at_ms) >= {BASE_MS + 1_800_000}")
def flt03_since_search(spark, d):
    return R.filtered(sessions(spark, d), since_ms=BASE_MS + 1_800_000).select("id", F.coalesce("ended_at_ms", "started_at_ms").alias("effective_ms"))


@query(f"WITH {S} SELECT id, coalesce(ended_at_ms, started_at_ms, ingested_at_ms) AS effective_ms FROM s WHERE coalesce(ended_at_ms, started_at_ms, ingested_at_ms) >= {BASE_MS + 2_400_000}")
def flt04_since_list(spark, d):
    return listing.matching(sessions(spark, d), since_ms=BASE_MS + 2_400_000).select("id", listing.sort_time().alias("effective_ms"))


@query(f"WITH {S} SELECT id, model, provider FROM s WHERE model = 'm-1' AND provider = 'p-odd'")
def flt05_model_provider(spark, d):
    return listing.matching(sessions(spark, d), model="m-1", provider="p-odd").select("id", "model", "provider")


@query(f"WITH {S} SELECT id, mode, 'partial' AS asked FROM s WHERE mode IN ('partial', 'full') UNION ALL SELECT id, mode, 'full' FROM s WHERE mode = 'full'")
def flt06_mode_filter(spark, d):
    s = sessions(spark, d)
    return listing.matching(s, mode="partial").select("id", "mode", F.lit("partial").alias("asked")).unionByName(listing.matching(s, mode="full").select("id", "mode", F.lit("full").alias("asked")))


@query(f"WITH {E} SELECT kind, count(*) AS n FROM e WHERE kind NOT IN ('tool_result', 'usage') GROUP BY kind")
def flt08_searchable_gate(spark, d):
    return T.searchable(events(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E} SELECT session_id, idx, kind, text FROM e WHERE session_id = 'c:000007' AND idx BETWEEN 1 AND 5 AND kind IN ('user', 'assistant')")
def flt09_show_range(spark, d):
    return listing.event_range(events(spark, d), "c:000007", 1, 5, ("user", "assistant")).select("session_id", "idx", "kind", "text")


@query("SELECT doc_id, 'src/' || source || '/' || doc_id || '.jsonl' AS locator FROM documents WHERE NOT regexp_matches('src/' || source || '/' || doc_id || '.jsonl', '^(src/src1.*|.*/[^/]*7\\.jsonl)$')")
def flt10_exclusion_globs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.format_string("src/%s/%d.jsonl", "source", "doc_id").alias("locator"))
    hit = reduce(lambda a, b: a | b, [F.col("locator").rlike(X.glob(g)) for g in ("src\\src1*", "**/*7.jsonl")])
    return rows.filter(~hit)


_CDC = """c AS (SELECT doc_id, 'doc/' || doc_id AS locator, sha256(coalesce(text, '')) AS fingerprint, CASE WHEN doc_id % 13 != 0 THEN doc_id * 1000 END AS updated_at_ms FROM documents),
k AS (SELECT 'doc/' || doc_id AS locator, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS fingerprint, CASE WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'full' END AS mode FROM documents WHERE doc_id % 5 != 0)"""


def _cdc(spark, d):
    docs = table(spark, d, "documents")
    name, print_ = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), V.object_hash(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", name.alias("locator"), print_.alias("fingerprint"), F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") * 1000).alias("updated_at_ms"), F.octet_length("text").alias("bytes"))
    states = docs.filter("doc_id % 5 != 0").select(name.alias("locator"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(print_).alias("fingerprint"), F.when(F.col("doc_id") % 7 == 0, F.lit("partial")).otherwise("full").alias("mode"))
    return K.outcomes(found, states, exclude=("doc/9*",), since_ms=50_000)


_OUTCOME = "CASE WHEN regexp_matches(c.locator, '^doc/9.*$') THEN 'excluded' WHEN coalesce(updated_at_ms < 50000, false) THEN 'skipped_by_since' WHEN coalesce(c.fingerprint = k.fingerprint AND k.mode = 'full', false) THEN 'unchanged' ELSE 'pending' END"


@query(f"WITH {_CDC} SELECT doc_id, {_OUTCOME} AS outcome FROM c LEFT JOIN k USING (locator)")
def flt12_cdc_outcome(spark, d):
    return _cdc(spark, d).select("doc_id", "outcome")


@query(f"WITH {_CDC} SELECT count(*) FILTER (o != 'excluded') AS discovered, count(*) FILTER (o = 'pending') AS parsed, count(*) FILTER (o = 'unchanged') AS unchanged, count(*) FILTER (o = 'skipped_by_since') AS skipped_by_since FROM (SELECT {_OUTCOME} AS o FROM c LEFT JOIN k USING (locator))")
def agg10_ingest_report(spark, d):
    o = F.col("outcome")
    return _cdc(spark, d).agg(F.count_if(o != "excluded").alias("discovered"), F.count_if(o == "pending").alias("parsed"), F.count_if(o == "unchanged").alias("unchanged"), F.count_if(o == "skipped_by_since").alias("skipped_by_since"))


@query(f"WITH {_CDC} SELECT sum(octet_length(encode(text)))::BIGINT AS estimated_bytes, count(*) AS candidates FROM c JOIN documents USING (doc_id) LEFT JOIN k USING (locator) WHERE {_OUTCOME} = 'pending'")
def agg11_dry_run_bytes(spark, d):
    return _cdc(spark, d).filter("outcome = 'pending'").agg(F.sum("bytes").cast("long").alias("estimated_bytes"), F.count(F.lit(1)).alias("candidates"))


@query(f"WITH {E} SELECT session_id, idx FROM e WHERE kind IN ('user', 'assistant') AND text NOT LIKE '<session_context>%'")
def flt13_content_filters(spark, d):
    return listing.talk(events(spark, d)).filter(~F.col("text").startswith("<session_context>")).select("session_id", "idx")


@query(f"WITH {S} SELECT a.id FROM s a JOIN s b ON a.id = b.id WHERE NOT (a.model IS NOT DISTINCT FROM CASE WHEN b.agent = 'pi' THEN NULL ELSE b.model END AND a.ended_at_ms IS NOT DISTINCT FROM b.ended_at_ms)")
def flt14_null_safe(spark, d):
    s = sessions(spark, d)
    changed = s.withColumn("model", F.when(F.col("agent") != "pi", F.col("model")))
    return K.conflicts(s, changed, ["id"], ["model", "ended_at_ms"])


@query(f"WITH {E}, {S} SELECT id, agent, cwd, started_at_ms, ended_at_ms, title, model, provider, mode, coalesce(n, 0) AS event_count FROM s LEFT JOIN (SELECT session_id AS id, count(*) AS n FROM e GROUP BY 1) USING (id)")
def prj01_session_summary(spark, d):
    counts = listing.event_counts(events(spark, d))
    return sessions(spark, d).select(*listing.SUMMARY).join(counts, "id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


@query(f"WITH {E}, {S} SELECT id, count(session_id) AS n_events, string_agg(idx || ':' || kind, ',' ORDER BY idx) AS kinds FROM s LEFT JOIN e ON id = session_id GROUP BY id")
def prj02_session_detail(spark, d):
    none = events(spark, d).limit(0).select("session_id", F.col("text").alias("locator"))
    rows = listing.nested(sessions(spark, d), events(spark, d), none)
    return rows.select("id", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["kind"])), ",").alias("kinds"))


@query("SELECT event_id, (value > 20) AS is_error, (props->>'k')::BIGINT AS input, (props->>'k')::BIGINT + user_id AS total FROM events")
def prj03_typed_columns(spark, d):
    usage = F.from_json("props", "k bigint")
    rows = table(spark, d, "events").withColumn("usage", F.struct(usage["k"].alias("input"), F.col("user_id").alias("output"), *[F.lit(None).cast("long").alias(x) for x in ("reasoning", "cache_read", "cache_write", "total")]))
    return rows.select("event_id", (F.col("value") > 20).cast("int").cast("boolean").alias("is_error"), F.col("usage.input"), V.usage_total("usage").alias("total"))


# Joins


_SRC = "r AS (SELECT 'c:' || lpad((page_id % 50)::VARCHAR, 6, '0') AS session_id, url AS locator, sha256(coalesce(html, '')) AS object_hash, page_id FROM pages)"


def _sources(spark, d):
    return table(spark, d, "pages").select(_sid(F.col("page_id") % 50).alias("session_id"), F.col("url").alias("locator"), V.object_hash(F.coalesce("html", F.lit(""))).alias("object_hash"), "page_id")


def _objects(spark, d):
    return table(spark, d, "pages").select(F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("orphan-"), F.col("page_id").cast("string"))).otherwise(V.object_hash(F.coalesce("html", F.lit("")))).alias("hash"), F.octet_length("html").cast("long").alias("bytes"), "page_id")


_OBJ = "o AS (SELECT CASE WHEN page_id % 10 = 0 THEN 'orphan-' || page_id ELSE sha256(coalesce(html, '')) END AS hash, octet_length(encode(html))::BIGINT AS bytes, page_id FROM pages)"


@query(f"WITH {E}, {S}, {_bm25(GATED, 'session_id, idx')} SELECT h.session_id, h.idx, e.kind, s.agent, round(bm25, 6) AS bm25 FROM hits h JOIN e ON e.session_id = h.session_id AND e.idx = h.idx JOIN s ON s.id = h.session_id")
def join01_hits_events_sessions(spark, d):
    e = events(spark, d)
    hits = T.bm25(T.index(e), plan(QUERY)).join(e.select("session_id", "idx", "kind"), ["session_id", "idx"])
    return hits.join(sessions(spark, d).select(F.col("id").alias("session_id"), "agent"), "session_id").select("session_id", "idx", "kind", "agent", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {S}, {_SRC} SELECT locator, object_hash AS fingerprint, mode FROM r JOIN s ON id = session_id")
def join02_source_state(spark, d):
    return _sources(spark, d).join(sessions(spark, d).select(F.col("id").alias("session_id"), "mode"), "session_id").select("locator", F.col("object_hash").alias("fingerprint"), "mode")


@query(f"WITH {_SRC}, {_OBJ} SELECT r.page_id, object_hash FROM r LEFT JOIN o ON hash = object_hash WHERE hash IS NULL")
def join03_dangling_refs(spark, d):
    return K.dangling(_sources(spark, d), _objects(spark, d)).select("page_id", "object_hash")


@query(f"WITH {_SRC}, {_OBJ} SELECT count(*) AS orphans, coalesce(sum(bytes), 0)::BIGINT AS orphan_bytes FROM o LEFT JOIN (SELECT DISTINCT object_hash FROM r) x ON hash = object_hash WHERE object_hash IS NULL")
def join04_orphan_objects(spark, d):
    return K.orphans(_objects(spark, d), _sources(spark, d)).agg(F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("orphan_bytes"))


def _customers(spark, d):
    c = table(spark, d, "customer")
    new = c.filter("c_custkey % 3 != 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("double")).when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return c.filter("c_custkey % 4 != 0"), new


_CUST = """old AS (SELECT * FROM customer WHERE c_custkey % 4 != 0),
new AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 != 0)"""


@query(f"WITH {_CUST} SELECT c_custkey FROM old JOIN new USING (c_custkey) WHERE NOT (old.c_name IS NOT DISTINCT FROM new.c_name AND old.c_acctbal IS NOT DISTINCT FROM new.c_acctbal)")
def join05_conflicts_nullsafe(spark, d):
    return K.conflicts(*_customers(spark, d), ["c_custkey"], ["c_name", "c_acctbal"])


@query("""WITH src AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 != 0), dst AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT count(*) FILTER (d.o_orderkey IS NULL) AS imported, count(*) FILTER (d.o_orderkey IS NOT NULL) AS skipped FROM src LEFT JOIN dst d ON d.o_orderkey = src.o_orderkey AND d.o_custkey = src.o_custkey""")
def join06_not_exists_import(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    src, dst = o.filter("o_orderkey % 3 != 0"), o.filter("o_orderkey % 2 = 0").withColumn("there", F.lit(True))
    return src.join(dst, ["o_orderkey", "o_custkey"], "left").agg(F.count_if(F.col("there").isNull()).alias("imported"), F.count_if(F.col("there").isNotNull()).alias("skipped"))


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) l ON l_orderkey = o_orderkey")
def join07_left_outer_parts(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_quantity > 30").select("l_orderkey", "l_linenumber")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").select("o_orderkey", "l_linenumber")


@query("""WITH ev AS (SELECT user_id AS session_id, (event_id % 40)::VARCHAR AS call_id, event_id AS idx, CASE WHEN event_type IN ('click', 'view') THEN 'tool_call' ELSE 'tool_result' END AS kind, 'a' || event_id AS child FROM events),
p AS (SELECT o.session_id, o.call_id, o.child, row_number() OVER (PARTITION BY o.session_id, o.call_id ORDER BY o.idx, c.idx DESC) AS rn FROM ev o JOIN ev c ON c.session_id = o.session_id AND c.call_id = o.call_id AND c.kind = 'tool_call' AND o.idx > c.idx WHERE o.kind = 'tool_result')
SELECT session_id AS parent, child FROM p WHERE rn = 1""")
def join08_spawn_edges(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), F.lit("tool_call")).otherwise("tool_result")
    text = F.to_json(F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("agent_id")))
    ev = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 40).cast("string").alias("call_id"), F.col("event_id").alias("idx"), kind.alias("kind"), F.lit("spawn_agent").alias("name"), text.alias("text"))
    return K.spawn_edges(ev)


@query(f"WITH {_CUST} SELECT o.c_custkey FROM old o JOIN new n USING (c_custkey) WHERE (o.c_nationkey IS NOT NULL AND n.c_nationkey IS NOT NULL AND NOT (o.c_nationkey = n.c_nationkey)) OR (o.c_acctbal IS DISTINCT FROM n.c_acctbal)")
def join09_source_divergence(spark, d):
    old, new = _customers(spark, d)
    a, b = old.alias("a"), new.alias("b")
    differs = (F.col("a.c_nationkey").isNotNull() & F.col("b.c_nationkey").isNotNull() & ~(F.col("a.c_nationkey") == F.col("b.c_nationkey"))) | ~F.col("a.c_acctbal").eqNullSafe(F.col("b.c_acctbal"))
    return a.join(b, K.on(["c_custkey"])).filter(differs).select("a.c_custkey")


@query(f"WITH {E}, x AS (SELECT session_id, idx FROM e WHERE idx % 3 = 1) SELECT e.session_id, e.idx, kind FROM x JOIN e USING (session_id, idx) WHERE kind IN ('tool_result', 'usage')")
def join10_wrongly_indexed(spark, d):
    e = events(spark, d)
    return e.filter(F.col("kind").isin("tool_result", "usage")).join(e.filter("idx % 3 = 1").select("session_id", "idx"), ["session_id", "idx"], "left_semi").select("session_id", "idx", "kind")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join11_semi(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query(f"WITH {_CDC} SELECT c.locator, k.fingerprint AS known, k.mode FROM c LEFT JOIN k USING (locator)")
def join12_candidate_states(spark, d):
    docs = _cdc(spark, d).select("locator", "doc_id")
    name, print_ = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), V.object_hash(F.coalesce("text", F.lit("")))
    states = table(spark, d, "documents").filter("doc_id % 5 != 0").select(name.alias("locator"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(print_).alias("known"), F.when(F.col("doc_id") % 7 == 0, F.lit("partial")).otherwise("full").alias("mode"))
    return docs.join(states, "locator", "left").select("locator", "known", "mode")


# Aggregates


_STATS = f"WITH {E}, {S}, a AS (SELECT agent, count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS events, count(*) FILTER (mode = 'full') AS full_sessions FROM s LEFT JOIN (SELECT session_id AS id, count(*) AS n FROM e GROUP BY 1) USING (id) GROUP BY agent)"


@query(f"{_STATS} SELECT * FROM a")
def agg01_stats_by_agent(spark, d):
    return listing.stats(sessions(spark, d), events(spark, d))


@query(f"{_STATS} SELECT sum(sessions)::BIGINT AS total_sessions, sum(events)::BIGINT AS total_events, sum(full_sessions)::BIGINT AS total_full_sessions FROM a")
def agg02_totals(spark, d):
    return listing.totals(listing.stats(sessions(spark, d), events(spark, d)))


@query(f"WITH {E}, {S} SELECT id, (SELECT count(*) FROM e WHERE session_id = id AND kind = 'tool_result') AS n FROM s")
def agg03_correlated_count(spark, d):
    counts = events(spark, d).filter("kind = 'tool_result'").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return sessions(spark, d).select("id").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"WITH {_SRC} SELECT count(DISTINCT object_hash) AS n FROM r")
def agg04_distinct_hashes(spark, d):
    return _sources(spark, d).agg(F.countDistinct("object_hash").alias("n"))


@query(f"WITH {_OBJ} SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes FROM o")
def agg05_payload_bytes(spark, d):
    return _objects(spark, d).agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


@query(f"WITH {E} SELECT session_id, arg_min(text, idx) FILTER (kind = 'user') AS a, arg_max(text, idx) FILTER (kind = 'assistant') AS o FROM e WHERE kind IN ('user', 'assistant') GROUP BY session_id".replace("AS a,", "AS ask0,").replace("AS o ", "AS outcome0 ").join(["SELECT session_id, CASE WHEN length(ask0) > 500 THEN left(ask0, 500) || '…' ELSE ask0 END AS ask, CASE WHEN length(outcome0) > 500 THEN left(outcome0, 500) || '…' ELSE outcome0 END AS outcome FROM (", ")"]))
def agg09_bookends(spark, d):
    return R.bookends(events(spark, d))


@query("SELECT user_id, max(epoch_us(ts) // 1000) AS latest_ms, greatest(max(epoch_us(ts) // 1000) - 1704067200000, 0) AS lag_ms FROM events GROUP BY user_id")
def agg12_archive_lag(spark, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.max(at).alias("latest_ms")).withColumn("lag_ms", F.greatest(F.col("latest_ms") - 1704067200000, F.lit(0)))


@query(f"SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avgdl FROM (SELECT {TOKS} AS t FROM documents)")
def agg13_corpus_statistics(spark, d):
    return T.statistics(T.index(table(spark, d, "documents"), ("doc_id",))).withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def agg14_p95(spark, d):
    return K.p95(table(spark, d, "events"), "event_type", "value")


@query(f"WITH {E} SELECT session_id, count(*) FILTER (kind IN ('user', 'assistant')) AS turns FROM e GROUP BY session_id")
def agg16_turns(spark, d):
    return listing.turn_counts(events(spark, d))


@query("SELECT user_id, arg_min(v, event_id) AS first, arg_max(v, event_id) AS last FROM (SELECT *, CASE WHEN event_type != 'error' THEN value END AS v FROM events) WHERE v IS NOT NULL GROUP BY user_id UNION ALL SELECT user_id, NULL, NULL FROM events GROUP BY user_id HAVING count(*) FILTER (event_type != 'error') = 0")
def agg17_bounds(spark, d):
    return K.bounds(table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))), "user_id", "v", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (event_type != 'view') AS first_type FROM events GROUP BY user_id")
def agg18_first_non_null(spark, d):
    t = F.when(F.col("event_type") != "view", F.col("event_type"))
    rows = table(spark, d, "events").withColumn("t", t)
    return K.bounds(rows, "user_id", "t", "event_id").select("user_id", F.col("first").alias("first_type"))


@query("SELECT event_id, CASE WHEN t IS NOT NULL THEN t WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS total FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS t, CASE WHEN event_id % 3 = 0 THEN event_id END AS a, CASE WHEN event_id % 5 = 0 THEN user_id END AS b FROM events)")
def agg19_usage_total(spark, d):
    c = F.col
    parts = {"input": F.when(c("event_id") % 3 == 0, c("event_id")), "output": F.when(c("event_id") % 5 == 0, c("user_id")), "total": F.when(c("event_id") % 4 == 0, c("user_id"))}
    usage = F.struct(*[parts.get(k, F.lit(None)).cast("long").alias(k) for k in ("input", "output", "reasoning", "cache_read", "cache_write", "total")])
    return table(spark, d, "events").withColumn("usage", usage).select("event_id", V.usage_total().alias("total"))


# Windows, order, pages


@query(f"WITH {E}, {_bm25(GATED, 'session_id, idx')}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bm25, idx) AS rank FROM hits) SELECT session_id, idx, rank FROM r WHERE rank <= 2")
def win01_top_hits_per_session(spark, d):
    return R.ranked_hits(T.bm25(T.index(events(spark, d)), plan(QUERY)), 2).select("session_id", "idx", "rank")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events")
def win02_ordinals(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"))


@query(f"WITH {S} SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY event_score DESC, ended_at_ms DESC NULLS LAST, id) AS place FROM (SELECT *, (ingested_at_ms % 3)::DOUBLE AS event_score FROM s)")
def win03_representatives(spark, d):
    w = Window.partitionBy("agent").orderBy(F.desc("score"), F.desc_nulls_last("ended_at_ms"), F.asc("id"))
    return sessions(spark, d).withColumn("score", (F.col("ingested_at_ms") % 3).cast("double")).select("agent", "id", F.row_number().over(w).alias("place"))


@query(f"WITH {E}, {_bm25(GATED, 'session_id, idx')} SELECT session_id, idx, round(bm25, 6) AS score FROM hits ORDER BY bm25, session_id, idx LIMIT 500")
def srt01_capped_candidates(spark, d):
    return R.capped(T.bm25(T.index(events(spark, d)), plan(QUERY)), R.candidate_cap(5)).select("session_id", "idx", F.round("bm25", 6).alias("score"))


_PAGE = f"WITH {S}, t AS (SELECT id, coalesce(ended_at_ms, started_at_ms, ingested_at_ms) AS sort_time FROM s)"


@query(f"{_PAGE} SELECT * FROM t ORDER BY sort_time DESC, id LIMIT 11")
def srt04_keyset_page1(spark, d):
    return listing.page(sessions(spark, d), events(spark, d), 10).select("id", "sort_time")


@query(f"{_PAGE} SELECT * FROM t WHERE sort_time < {BASE_MS + 2_000_000} OR (sort_time = {BASE_MS + 2_000_000} AND id > 'c:000030') ORDER BY sort_time DESC, id LIMIT 11")
def srt04_keyset_page2(spark, d):
    return listing.page(sessions(spark, d), events(spark, d), 10, cursor=listing.encode_cursor(BASE_MS + 2_000_000, "c:000030")).select("id", "sort_time")


@query(f"{_PAGE} SELECT sort_time || ':' || lower(hex(encode(id))) AS cursor FROM t")
def srt05_cursors(spark, d):
    s = sessions(spark, d).select(F.concat(listing.sort_time().cast("string"), F.lit(":"), F.lower(F.hex(F.encode("id", "utf-8")))).alias("cursor"))
    return s


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest, arg_min(event_id, (ts, event_id)) AS earliest FROM events GROUP BY user_id")
def srt06_latest_per_group(spark, d):
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("latest"), F.min_by("event_id", at).alias("earliest"))


@query(f"WITH {_CUST} SELECT count(*) > 0 AS conflict FROM old JOIN new USING (c_custkey) WHERE old.c_acctbal IS DISTINCT FROM new.c_acctbal")
def srt08_conflict_probe(spark, d):
    found = K.conflicts(*_customers(spark, d), ["c_custkey"], ["c_acctbal"]).limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("conflict"))


# Sets


@query(f"WITH {_CUST}, o AS (SELECT c_custkey, c_acctbal FROM old), n AS (SELECT c_custkey, c_acctbal FROM new) (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM o)")
def set01_except_symmetric(spark, d):
    return K.difference(*[x.select("c_custkey", "c_acctbal") for x in _customers(spark, d)])


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def set03_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@query(f"WITH {_CUST} SELECT c_custkey, c_acctbal FROM old UNION ALL SELECT c_custkey, c_acctbal FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def set04_insert_or_ignore(spark, d):
    return K.insert_absent(*[x.select("c_custkey", "c_acctbal") for x in _customers(spark, d)], ["c_custkey"])


_REPLACE = f"WITH {_CUST} SELECT c_custkey, c_acctbal FROM new UNION ALL SELECT c_custkey, c_acctbal FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)"


@query(_REPLACE)
def set05_insert_or_replace(spark, d):
    return K.replace(*[x.select("c_custkey", "c_acctbal") for x in _customers(spark, d)], ["c_custkey"])


@query(f"WITH {_CUST} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM old o FULL JOIN new n USING (c_custkey)")
def set06_upsert(spark, d):
    return K.replace(*[x.select("c_custkey", "c_name", "c_acctbal") for x in _customers(spark, d)], ["c_custkey"])


@query(f"WITH {_CUST} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal FROM new o FULL JOIN old n ON n.c_custkey = o.c_custkey")
def set07_coalesce_upsert(spark, d):
    old, new = [x.select("c_custkey", "c_acctbal") for x in _customers(spark, d)]
    return K.fill(new, old, ["c_custkey"], ["c_acctbal"])


@query(f"WITH {_CUST} SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM new WHERE c_acctbal > 5000) THEN 'full' ELSE c_mktsegment END AS mode FROM old")
def set08_promote(spark, d):
    old, new = _customers(spark, d)
    flag = new.filter("c_acctbal > 5000").select("c_custkey").distinct().withColumn("up", F.lit(True))
    return old.join(flag, "c_custkey", "left").select("c_custkey", F.when(F.col("up"), F.lit("full")).otherwise(F.col("c_mktsegment")).alias("mode"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def set09_delete_children(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return K.without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query(f"WITH {_CUST} SELECT count(*) AS source, count(*) FILTER (c_custkey NOT IN (SELECT c_custkey FROM old)) AS imported, greatest(count(*) - count(*) FILTER (c_custkey NOT IN (SELECT c_custkey FROM old)), 0) AS skipped FROM new")
def set10_affected_rows(spark, d):
    old, new = _customers(spark, d)
    there = old.select("c_custkey").withColumn("there", F.lit(True))
    n = new.join(there, "c_custkey", "left").agg(F.count(F.lit(1)).alias("source"), F.count_if(F.col("there").isNull()).alias("imported"))
    return n.withColumn("skipped", F.greatest(F.col("source") - F.col("imported"), F.lit(0)))


@query("""WITH old AS (SELECT page_id % 20 AS session_id, url AS locator, CASE WHEN page_id % 3 != 0 THEN sha256(html) END AS h FROM pages WHERE page_id % 4 != 1), new AS (SELECT page_id % 20 AS session_id, url AS locator FROM pages WHERE page_id % 4 != 2 AND page_id % 20 < 15)
SELECT DISTINCT session_id, locator, h AS object_hash FROM (SELECT n.session_id, n.locator, o.h FROM (SELECT DISTINCT * FROM new) n LEFT JOIN (SELECT session_id, locator, max(h) AS h FROM old GROUP BY ALL) o USING (session_id, locator)
UNION ALL SELECT session_id, locator, max(h) FROM old o WHERE h IS NOT NULL AND session_id IN (SELECT session_id FROM new) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.session_id = o.session_id AND n.locator = o.locator) GROUP BY ALL)""")
def snk02_sticky_sources(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("session_id"), F.col("url").alias("locator"), F.when(F.col("page_id") % 3 != 0, V.object_hash(F.col("html"))).alias("object_hash"), "page_id")
    old = p.filter("page_id % 4 != 1").groupBy("session_id", "locator").agg(F.max("object_hash").alias("object_hash"))
    new = p.filter("page_id % 4 != 2 and page_id % 20 < 15").select("session_id", "locator", F.lit(None).cast("string").alias("object_hash")).distinct()
    return K.sticky(old, new)


@query("SELECT sha256(html) AS hash, octet_length(encode(any_value(html)))::BIGINT AS bytes FROM pages WHERE html IS NOT NULL GROUP BY 1")
def snk03_object_store(spark, d):
    p = table(spark, d, "pages").filter("html is not null").select(V.object_hash(F.col("html")).alias("hash"), F.octet_length("html").cast("long").alias("bytes"))
    return K.insert_absent(p.limit(0), p, ["hash"])


@query(f"WITH {_SRC}, {_OBJ} SELECT (SELECT count(*) FROM o) AS total, (SELECT count(DISTINCT object_hash) FROM r) AS referenced, (SELECT count(*) FROM o WHERE hash NOT IN (SELECT object_hash FROM r)) AS orphan")
def snk07_gc_dry_run(spark, d):
    o, r = _objects(spark, d), _sources(spark, d)
    orphan = K.orphans(o, r).agg(F.count(F.lit(1)).alias("n"))
    referenced = r.agg(F.countDistinct("object_hash").alias("n"))
    return o.agg(F.count(F.lit(1)).alias("total")).select("total", referenced.select("n").scalar().alias("referenced"), orphan.select("n").scalar().alias("orphan"))


# Scalars


@query("SELECT doc_id, lower(text) = text AS lower_same, md5(lower(text)) AS lower_md5, contains(lower(text), 'tion') AS has, starts_with(text, 'A') AS starts, length(text) AS n, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS preview, split_part(text, '#', 1) = text AS no_hash FROM documents")
def str01_text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", (F.lower(t) == t).alias("lower_same"), F.md5(F.lower(t)).alias("lower_md5"), F.lower(t).contains("tion").alias("has"), t.startswith("A").alias("starts"),
        F.length(t).cast("long").alias("n"), X.preview(t).alias("preview"), (F.split_part(t, F.lit("#"), F.lit(1)) == t).alias("no_hash"),
    )


@query("SELECT doc_id, (contains(lower(text), 'ther'))::INT + (contains(lower(text), 'ing'))::INT AS hits, contains(lower(text), 'ther') AND contains(lower(text), 'ing') AS every FROM documents")
def str02_term_containment(spark, d):
    t = F.lower("text")
    terms = ["ther", "ing"]
    return table(spark, d, "documents").select("doc_id", X.term_hits(terms, t).alias("hits"), (F.size(X.covered(terms, t)) == len(terms)).alias("every"))


@query("SELECT DISTINCT source || ':' || lang AS native, source || ':' || lang || '/' || (doc_id % 3) AS child, lower(hex(encode(source))) AS h FROM documents")
def str11_identifiers(spark, d):
    c = F.col
    native = F.concat(c("source"), F.lit(":"), c("lang"))
    return table(spark, d, "documents").select(native.alias("native"), F.concat(native, F.lit("/"), (c("doc_id") % 3).cast("string")).alias("child"), F.lower(F.hex(F.encode("source", "utf-8"))).alias("h")).distinct()


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def hsh01_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", V.object_hash(F.col("text")).alias("hash"))


@query("SELECT event_id, round(ln(1 + value), 9) AS ln1p, round(exp(-value / 100), 9) AS e, round(log2(1 + value), 9) AS l2, pow(2, user_id % 4) - 1 AS gain, greatest(value, 10.0) AS top FROM events")
def mth01_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.log1p(v), 9).alias("ln1p"), F.round(F.exp(-v / 100), 9).alias("e"), F.round(F.log2(1 + v), 9).alias("l2"), V.gain(F.col("user_id") % 4).alias("gain"), F.greatest(v, F.lit(10.0)).alias("top"))


@query(f"WITH {E} SELECT session_id, idx, CASE kind WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.8 WHEN 'system' THEN 0.5 WHEN 'thinking' THEN 0.4 WHEN 'tool_call' THEN 0.3 ELSE 0.2 END::DOUBLE AS bonus FROM e")
def cnd01_kind_bonus(spark, d):
    return events(spark, d).select("session_id", "idx", V.kind_weight(F.col("kind")).alias("bonus"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def dat01_rfc3339(spark, d):
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", V.rfc3339_ms(text).alias("ms"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 WHEN event_id % 3 = 1 THEN (event_id * 12345) // 1000 END AS ms FROM events")
def dat02_rfc3339_or_integer(spark, d):
    c = F.col("event_id")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    text = F.when(c % 3 == 0, iso).when(c % 3 == 1, (c * 12345).cast("string")).otherwise("never")
    return table(spark, d, "events").withColumn("t", text).select("event_id", V.rfc3339_or_number_ms(F.col("t")).alias("ms"))


@query(f"WITH {S} SELECT id, round(CASE WHEN ended_at_ms IS NULL THEN 3650.0 ELSE greatest(0.0, ({AS_OF_MS} - ended_at_ms) / 86400000.0) END, 6)::DOUBLE AS age, round(exp(-ln(2) * CASE WHEN ended_at_ms IS NULL THEN 3650.0 ELSE greatest(0.0, ({AS_OF_MS} - ended_at_ms) / 86400000.0) END / 30), 9)::DOUBLE AS recency FROM s")
def dat03_age_recency(spark, d):
    e = F.col("ended_at_ms")
    return sessions(spark, d).select("id", F.round(V.age_days(e, AS_OF_MS), 6).alias("age"), F.round(V.recency(e, AS_OF_MS), 9).alias("recency"))


@query("SELECT event_id, (n - ((n % 1000000000) + 1000000000) % 1000000000) // 1000000000 AS s, ((n % 1000000000) + 1000000000) % 1000000000 AS ns FROM (SELECT event_id, (event_id - 5000) * 123456789 AS n FROM events)")
def dat04_split_ns(spark, d):
    s, ns = V.split_ns((F.col("event_id") - 5000) * 123456789)
    return table(spark, d, "events").select("event_id", s.alias("s"), ns.alias("ns"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, json_valid(props) AS ok, json_valid('x' || props) AS broken FROM events")
def jsn01_props(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").try_cast("bigint").alias("k"), F.try_parse_json(p).isNotNull().alias("ok"), F.try_parse_json(F.concat(F.lit("x"), p)).isNotNull().alias("broken"))


@query("SELECT event_id, (json_extract_string(json_extract_string(outer_json, '$.args'), '$.k'))::BIGINT AS k FROM (SELECT event_id, json_object('args', props) AS outer_json FROM (SELECT event_id, props::VARCHAR AS props FROM events))")
def jsn04_nested_json(spark, d):
    outer = F.to_json(F.struct(F.col("props").alias("args")))
    return table(spark, d, "events").select("event_id", F.get_json_object(F.get_json_object(outer, "$.args"), "$.k").try_cast("bigint").alias("k"))


@query("SELECT conv_id, array_to_string(list_distinct_order, ',') AS roles FROM (SELECT conv_id, [r FOR r, i IN l IF list_position(l, r) = i] AS list_distinct_order FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id))")
def arr01_ordered_distinct(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["role"])), ",").alias("roles"))


@query("SELECT doc_id, i - 1 AS pos, w AS word FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def arr02_fan_out(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "word"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text), lang")
def ded01_dedup_messages(spark, d):
    return K.first_of(table(spark, d, "documents"), [V.object_hash(F.col("text")), F.col("lang")], [F.col("doc_id")]).select("doc_id")


@query("SELECT min(event_id) AS event_id FROM events GROUP BY CASE WHEN event_type = 'view' THEN '' ELSE user_id::VARCHAR END")
def ded02_dedup_by_id(spark, d):
    key = F.coalesce(F.when(F.col("event_type") != "view", F.col("user_id").cast("string")), F.lit(""))
    return K.first_of(table(spark, d, "events"), [key], [F.col("event_id")]).select("event_id")


# Full text


@query(f"SELECT doc_id, len({TOKS}) AS n_tokens FROM documents")
def fts04_token_counts(spark, d):
    return T.index(table(spark, d, "documents"), ("doc_id",)).select("doc_id", F.col("dl").alias("n_tokens"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKS}) AS term FROM documents) GROUP BY term")
def fts06_postings_df(spark, d):
    return T.document_frequency(T.index(table(spark, d, "documents"), ("doc_id",)))


@query(f"SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {TOKS} AS l FROM documents)) GROUP BY ALL")
def fts07_reindex(spark, d):
    """Every posting, dealt as a stored index has them."""
    idx = T.index(table(spark, d, "documents"), ("doc_id",))
    held = T.folded(T.shares(idx, T.MOST_BUCKETS))
    each = T.postings(idx, ("doc_id",)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("positions")[0].alias("first"))
    dealt = T.shared_out(each, held, ("doc_id",)).groupBy("bucket", "file", "doc_id", "term")  # rows of one id are one posting
    return dealt.agg(F.sum("tf").alias("tf"), F.min("first").alias("first")).sortWithinPartitions("bucket", "term").select("doc_id", "term", "tf", "first")


def _docs(spark, d):
    return T.index(table(spark, d, "documents"), ("doc_id",))


_I = f"WITH i AS (SELECT doc_id, {TOKS} AS toks FROM documents)"


@query(f"{_I} SELECT doc_id FROM i WHERE {_freq(['of', 'the'])} > 0")
def fts09_phrase(spark, d):
    return _docs(spark, d).filter(T.matches(plan('"of the"').expr)).select("doc_id")


@query(f"{_I} SELECT doc_id FROM i WHERE (({_freq(['ther'])} > 0 AND {_freq(['ing'])} > 0) OR {_freq(['ble'])} > 0) AND NOT ({_freq(['der'])} > 0)")
def fts10_boolean(spark, d):
    return _docs(spark, d).filter(T.matches(plan("((ther AND ing) OR ble) NOT der").expr)).select("doc_id")


@query(f"{_I} SELECT doc_id FROM i WHERE {_freq(['thre'], True)} > 0 AND len([1 FOR x IN toks IF starts_with(x, 'tion')]) > 0")
def fts11_prefix(spark, d):
    return _docs(spark, d).filter(T.matches(plan("text:thre* tion*").expr)).select("doc_id")


@query(f"{_I} SELECT doc_id FROM i WHERE len([a FOR a IN range(1, len(toks) + 1) IF toks[a] = 'ther' AND (list_contains(toks[a + 1:a + 4], 'ing') OR list_contains(toks[greatest(a - 4, 1):a - 1], 'ing'))]) > 0")
def fts11_near(spark, d):
    return _docs(spark, d).filter(T.matches(plan("NEAR(ther ing, 3)").expr)).select("doc_id")


@query(f"WITH {_bm25('documents', 'doc_id')} SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")
def fts12_bm25_documents(spark, d):
    return T.bm25(_docs(spark, d), plan(QUERY), ("doc_id",)).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_bm25('documents', 'doc_id', 'the of the')} SELECT doc_id, round(bm25, 9) AS bm25 FROM hits")
def fts12_bm25_common_terms(spark, d):
    return T.bm25(_docs(spark, d), plan("the of the"), ("doc_id",)).select("doc_id", F.round("bm25", 9).alias("bm25"))


@query(f"WITH {E}, {_bm25(GATED, 'session_id, idx')} SELECT session_id, idx, round(bm25, 6) AS bm25 FROM hits")
def fts12_bm25_conversations(spark, d):
    return T.bm25(T.index(events(spark, d)), plan(QUERY)).select("session_id", "idx", F.round("bm25", 6).alias("bm25"))


@query(f"{_I}, c AS (SELECT doc_id, {_freq(['ther'])} AS f0, {_freq(['ther', 'ing'])} AS f1, len(toks) AS dl FROM i) SELECT doc_id, f0, f1, dl FROM c WHERE f0 > 0")
def fts14_sparse_candidates(spark, d):
    posts = T.postings(_docs(spark, d), ("doc_id",))
    rows, at = T.candidates_from_postings(posts, plan('ther OR "ther ing"'), ("doc_id",))
    places = [F.size(T.phrase_places(p, at)).cast("long") for p in plan('ther OR "ther ing"').phrases]
    return rows.select("doc_id", places[0].alias("f0"), places[1].alias("f1"), "dl").filter("f0 > 0")


def _search_sql(limit: int) -> str:
    terms = QUERY.split()
    covered = " + ".join(f"max(contains(seen, '{t}')::INT)" for t in terms)
    titled = " AND ".join(f"contains(lower(coalesce(title, '')), '{t}')" for t in terms)
    return f"""WITH RECURSIVE {E}, {S}, {_bm25(GATED, 'session_id, idx')},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bm25, idx) AS rk FROM hits WHERE session_id IN (SELECT id FROM s)),
cap AS (SELECT * FROM r WHERE rk <= 50 ORDER BY bm25, session_id, idx LIMIT {R.candidate_cap(limit)}),
h AS (SELECT cap.*, e.kind, lower(e.text) || ' ' || lower(coalesce(s.title, '')) AS seen FROM cap JOIN e USING (session_id, idx) JOIN s ON s.id = cap.session_id),
g AS (SELECT session_id, count(*) AS hits, {covered} AS n_covered, arg_min(kind, (bm25, idx)) AS kind, min(bm25) AS bm25, arg_min(idx, (bm25, idx)) AS idx FROM h GROUP BY session_id),
norm AS (SELECT min(-bm25) AS low, max(-bm25) AS high, max(ln(1 + hits)) AS most FROM g),
sc AS (SELECT g.session_id, hits, idx, ended_at_ms, agent, CASE WHEN high - low < 2.220446049250313e-16 THEN 1.0 ELSE (-bm25 - low) / (high - low) END AS best_match, ln(1 + hits) / greatest(1.0, most) AS hit_coverage, n_covered / {float(len(terms))} AS term_coverage,
  CASE kind WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.8 WHEN 'system' THEN 0.5 WHEN 'thinking' THEN 0.4 WHEN 'tool_call' THEN 0.3 ELSE 0.2 END AS kind_score,
  exp(-ln(2) * CASE WHEN ended_at_ms IS NULL THEN 3650.0 ELSE greatest(0.0, ({AS_OF_MS} - ended_at_ms) / 86400000.0) END / 30) AS recency, ({titled})::INT::DOUBLE AS title_score FROM g JOIN s ON s.id = g.session_id, norm),
scored AS (SELECT *, best_match + 0.25 * hit_coverage + 0.35 * term_coverage + 0.2 * kind_score + 0.25 * recency + 0.15 * title_score AS score FROM sc),
edge AS (SELECT id, next FROM (SELECT id, coalesce(parent_session_id, split_part(forked_from, '#', 1)) AS next FROM s) WHERE next IN (SELECT id FROM s)),
walk AS (SELECT id, id AS node, [id] AS path, false AS again FROM s UNION ALL SELECT w.id, edge.next, list_append(w.path, edge.next), list_contains(w.path, edge.next) FROM walk w JOIN edge ON edge.id = w.node WHERE NOT w.again),
p AS (SELECT id, arg_max(node, len(path)) AS root, max(len(path)) - 1 AS depth, arg_max(path, len(path)) AS path FROM walk GROUP BY id),
m AS (SELECT scored.*, root, path, row_number() OVER (PARTITION BY root ORDER BY score DESC, ended_at_ms DESC NULLS LAST, session_id) AS rn FROM scored JOIN p ON p.id = session_id),
col AS (SELECT root, arg_min(session_id, rn) AS session_id, sum(hits)::BIGINT AS hits, arg_min(score, rn) + 0.1 * coalesce(sum(score) FILTER (rn > 1), 0) AS score, arg_min(ended_at_ms, rn) AS ended_at_ms, arg_min(agent, rn) AS agent,
  coalesce(list(session_id ORDER BY rn) FILTER (rn > 1), []) AS related, flatten(list(path ORDER BY rn)) AS line FROM m GROUP BY root),
top AS (SELECT * FROM col ORDER BY score DESC, ended_at_ms DESC NULLS LAST, session_id LIMIT {limit}),
members AS (SELECT root, session_id AS member, min(seat) AS seat FROM (SELECT root, unnest(list_concat([session_id], related, line)) AS session_id, generate_subscripts(list_concat([session_id], related, line), 1) AS seat FROM top) GROUP BY ALL),
ends AS (SELECT session_id AS member, arg_min(text, idx) FILTER (kind = 'user') AS ask, arg_max(text, idx) FILTER (kind = 'assistant') AS outcome FROM e GROUP BY 1),
ctx AS (SELECT root, arg_min(ask, seat) FILTER (ask IS NOT NULL) AS ask, arg_min(outcome, seat) FILTER (outcome IS NOT NULL) AS outcome FROM members JOIN ends USING (member) GROUP BY root)"""


def _search(spark, d, limit=20):
    return R.search(events(spark, d), sessions(spark, d), QUERY, AS_OF_MS, limit, snippets=False)


@query(f"{_search_sql(20)} SELECT session_id, hits, n_covered::INT AS n_covered, kind, idx, round(bm25, 6) AS bm25 FROM g")
def fts15_group(spark, d):
    e, s = events(spark, d), sessions(spark, d)
    hits = R.texts(R.candidates(e, s, plan(QUERY), R.candidate_cap(20)), e).withColumn("shown", F.col("text"))
    return R.grouped(hits, s, plan(QUERY).terms).select("session_id", "hits", "n_covered", "best.kind", "best.idx", F.round("best.bm25", 6).alias("bm25"))


_PARTS = ("best_match", "hit_coverage", "term_coverage", "recency")


@query(f"{_search_sql(20)} SELECT session_id, hits, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _PARTS)}, kind_score::DOUBLE AS kind_score, title_score::DOUBLE AS title_score, round(score, 6)::DOUBLE AS score FROM scored")
def fts16_score(spark, d):
    e, s = events(spark, d), sessions(spark, d)
    hits = R.texts(R.candidates(e, s, plan(QUERY), R.candidate_cap(20)), e).withColumn("shown", F.col("text"))
    rows = R.scored(R.grouped(hits, s, plan(QUERY).terms), s, plan(QUERY).terms, AS_OF_MS)
    return rows.select("session_id", "hits", *[F.round(f"p_{c}", 6).alias(c) for c in _PARTS], F.col("p_kind").alias("kind_score"), F.col("p_title").alias("title_score"), F.round("score", 6).alias("score"))


@query(f"{_search_sql(20)} SELECT id, root, depth, array_to_string(path, '>') AS path FROM p")
def gra01_lineage_root(spark, d):
    return lineage.paths(sessions(spark, d)).select("id", "root", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query(f"{_search_sql(20)} SELECT root, session_id, hits, round(score, 6)::DOUBLE AS score, array_to_string(related, ',') AS related FROM top")
def fts18_collapse(spark, d):
    return _search(spark, d).select("root", "session_id", "hits", F.round("score", 6).alias("score"), F.array_join("related", ",").alias("related"))


@query(f"""{_search_sql(20)} SELECT session_id AS id, top.root, agent, hits, round(score, 6)::DOUBLE AS score, array_to_string(related, ',') AS related, CASE WHEN length(ask) > 500 THEN left(ask, 500) || '…' ELSE ask END AS ask, CASE WHEN length(outcome) > 500 THEN left(outcome, 500) || '…' ELSE outcome END AS outcome
FROM top LEFT JOIN ctx ON ctx.root = top.root""")
def fts20_search(spark, d):
    return _search(spark, d).select(F.col("session_id").alias("id"), "root", "agent", "hits", F.round("score", 6).alias("score"), F.array_join("related", ",").alias("related"), "ask", "outcome")


@query("SELECT doc_id, regexp_extract('logs/p' || (doc_id % 9) || '/subagents/s' || doc_id || '.jsonl', '([^/]+)/subagents/([^/]+)\\.jsonl$', 1) AS parent, regexp_extract('logs/p' || (doc_id % 9) || '/subagents/s' || doc_id || '.jsonl', '([^/]+)/subagents/([^/]+)\\.jsonl$', 2) AS child FROM documents")
def gra02_directory_edges(spark, d):
    path = F.format_string("logs/p%d/subagents/s%d.jsonl", F.col("doc_id") % 9, "doc_id")
    pattern = r"([^/]+)/subagents/([^/]+)\.jsonl$"
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(path, pattern, 1).alias("parent"), F.regexp_extract(path, pattern, 2).alias("child"))


# Verification


@query(f"WITH {E}, {S} SELECT session_id, idx FROM e WHERE session_id NOT IN (SELECT id FROM s WHERE mode = 'full')")
def vfy02_foreign_keys(spark, d):
    full = sessions(spark, d).filter("mode = 'full'").select(F.col("id").alias("session_id"))
    return events(spark, d).join(full, "session_id", "left_anti").select("session_id", "idx")


@query(f"WITH {E} SELECT (SELECT count(*) FROM e WHERE kind NOT IN ('tool_result', 'usage')) AS searchable, (SELECT count(*) FROM (SELECT DISTINCT session_id, idx FROM (SELECT session_id, idx, unnest({TOKS}) FROM {GATED}))) AS with_terms")
def vfy04_index_consistency(spark, d):
    idx = T.index(events(spark, d))
    return idx.agg(F.count(F.lit(1)).alias("searchable"), F.count_if(F.col("dl") > 0).alias("with_terms"))


@query(f"WITH {_SRC}, {_OBJ} SELECT count(*) AS failures FROM r LEFT JOIN (SELECT DISTINCT hash FROM o) x ON hash = object_hash WHERE hash IS NULL")
def vfy05_object_refs(spark, d):
    return K.dangling(_sources(spark, d), _objects(spark, d)).agg(F.count(F.lit(1)).alias("failures"))


@query("SELECT count(*) AS checked, count(*) FILTER (sha256(html) = h AND octet_length(encode(html)) = n) AS passed FROM (SELECT html, CASE WHEN page_id % 17 = 0 THEN 'x' ELSE sha256(html) END AS h, octet_length(encode(html)) AS n FROM pages)")
def vfy06_object_decode(spark, d):
    p = table(spark, d, "pages").select("html", F.when(F.col("page_id") % 17 == 0, F.lit("x")).otherwise(V.object_hash(F.col("html"))).alias("h"), F.octet_length("html").alias("n"))
    return p.agg(F.count(F.lit(1)).alias("checked"), F.count_if((V.object_hash(F.col("html")) == F.col("h")) & (F.octet_length("html") == F.col("n"))).alias("passed"))


# Ranking quality


_REL = f"""WITH {_bm25('documents', 'doc_id')}, d AS (SELECT doc_id, lang, bm25 FROM hits JOIN documents USING (doc_id)),
rk AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY bm25, doc_id) AS rank FROM d),
l AS (SELECT lang AS query_id, doc_id, quality + 2 * toxic AS grade FROM labels JOIN documents USING (doc_id)),
g AS (SELECT query_id, rank, coalesce(grade, 0) AS grade FROM rk LEFT JOIN l USING (query_id, doc_id))"""


def _ranked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    hits = T.bm25(_docs(spark, d), plan(QUERY), ("doc_id",)).join(docs, "doc_id")
    ranks = hits.select(F.col("lang").alias("query_id"), "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("bm25", "doc_id")).alias("rank"))
    labels = table(spark, d, "labels").join(docs, "doc_id").select(F.col("lang").alias("query_id"), "doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("grade"))
    return ranks.join(labels, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade")), labels


@query(f"{_REL} SELECT query_id, coalesce(1.0 / min(rank) FILTER (grade > 0), 0.0)::DOUBLE AS rr FROM g GROUP BY query_id")
def rel02_mrr(spark, d):
    return relevance.reciprocal_rank(_ranked(spark, d)[0])


@query(f"""{_REL}, dcg AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY query_id),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM l) WHERE r <= 10 GROUP BY query_id)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 9)::DOUBLE AS ndcg FROM ideal LEFT JOIN dcg USING (query_id)""")
def rel03_ndcg(spark, d):
    return relevance.ndcg(*_ranked(spark, d)).select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query(f"{_REL}, w AS (SELECT query_id, greatest(count(*) FILTER (grade > 0), 1) AS wanted FROM l GROUP BY query_id) SELECT query_id, round((SELECT count(*) FROM g WHERE g.query_id = w.query_id AND rank <= 10 AND grade > 0) / wanted, 9)::DOUBLE AS recall FROM w")
def rel04_recall(spark, d):
    return relevance.recall(*_ranked(spark, d), 10).select("query_id", F.round("recall", 9).alias("recall"))


@query("SELECT 'bench-' || lpad(i::VARCHAR, 6, '0') AS id, '/workspace/project-' || lpad((i % 100)::VARCHAR, 3, '0') AS cwd, ['deployment', 'sqlite', 'parser', 'reconstruction'][i % 4 + 1] AS topic, (1767225600 + 60 * i) * 1000 AS started_at_ms, i < 10 AS changed FROM range(1000) t(i)")
def ben01_generator(spark, d):
    from ..bench_data import generated_sessions

    return generated_sessions(spark, 1000).select("id", "cwd", "topic", "started_at_ms", "changed")


# Bounds, order and tags


@query(f"{_search_sql(3)} SELECT root, session_id, hits FROM top")
def srt03_search_limit(spark, d):
    """Three results; a blank query and a limit of none add nothing."""
    rows = [_search(spark, d, 3), *[R.search(events(spark, d), sessions(spark, d), q, AS_OF_MS, n, snippets=False) for q, n in (("  ", 20), (QUERY, 0))]]
    return reduce(DataFrame.unionByName, [r.select("root", "session_id", "hits") for r in rows])


@query(f"WITH {E} SELECT session_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS places, string_agg(kind, ',' ORDER BY idx) AS kinds FROM e GROUP BY session_id")
def srt07_child_order(spark, d):
    """Each session's events in order of idx, as a detail shows them."""
    each = events(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "kind"))).alias("x"))
    return each.select("session_id", F.array_join(F.transform("x", lambda r: r["idx"].cast("string")), ",").alias("places"), F.array_join(F.transform("x", lambda r: r["kind"]), ",").alias("kinds"))


@query(f"""{_REL}, rr AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (grade > 0), 0.0)::DOUBLE AS rr FROM g GROUP BY query_id),
tags AS (SELECT query_id, unnest(['all', 'starts-' || query_id[1:1]]) AS tag FROM rr) SELECT tag, round(avg(rr), 9)::DOUBLE AS rr, count(*) AS queries FROM rr JOIN tags USING (query_id) GROUP BY tag""")
def agg15_metrics_by_tag(spark, d):
    scores = relevance.reciprocal_rank(_ranked(spark, d)[0])
    tags = scores.select("query_id", F.array(F.lit("all"), F.concat(F.lit("starts-"), F.substring("query_id", 1, 1))).alias("tags"))
    return relevance.by_tag(scores, tags, ["rr"]).select("tag", F.round("rr", 9).alias("rr"), "queries")


_GRADED = "r AS (SELECT conv_id % 3 AS q, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id) AS rank, conv_id AS id, conv_id // 4 * 4 AS root, [conv_id + 1, conv_id + 2] AS related FROM (SELECT DISTINCT conv_id FROM conversations)), l AS (SELECT doc_id % 3 AS q, doc_id AS id, quality + 2 * toxic AS grade FROM labels)"


@query(f"WITH {_GRADED}, m AS (SELECT q, rank, unnest(list_distinct([id, root, related[1], related[2]])) AS id FROM r) SELECT q::VARCHAR AS query_id, rank, coalesce(max(grade), 0)::INT AS grade FROM m LEFT JOIN l USING (q, id) GROUP BY q, rank")
def rel01_graded_results(spark, d):
    """The greatest label among a result's id, its root and its related sessions."""
    c, name = F.col("conv_id"), lambda x: x.cast("string")
    ranks = table(spark, d, "conversations").select("conv_id").distinct().withColumn("query_id", name(c % 3)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("conv_id")))
    results = ranks.select("query_id", "rank", name(c).alias("id"), name(F.floor(c / 4) * 4).alias("lineage_root_id"), F.array(name(c + 1), name(c + 2)).alias("related_session_ids"))
    labels = table(spark, d, "labels").select(name(F.col("doc_id") % 3).alias("query_id"), name(F.col("doc_id")).alias("session_id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("grade"))
    return relevance.graded(results, labels).select("query_id", "rank", F.col("grade").cast("int").alias("grade"))


@query("SELECT DISTINCT sha256(html) AS hash, octet_length(encode(html))::BIGINT AS bytes, true AS whole FROM pages WHERE html IS NOT NULL")
def cmp01_zstd_round_trip(spark, d):
    """Pages compressed as objects are, and whether they decode to what their hash names."""
    import zstandard

    from ..sources.distributed import ZSTD_LEVEL
    from ..verify import _sound

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(t.encode()))

    p = table(spark, d, "pages").filter("html is not null").select(V.object_hash(F.col("html")).alias("hash"), F.octet_length("html").cast("long").alias("bytes"), packed("html").alias("payload"))
    return p.dropDuplicates(["hash"]).select("hash", "bytes", _sound(F.lit("zstd"), "bytes", "payload", "hash").alias("whole"))


@query("SELECT 'claude' AS agent, page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages WHERE url LIKE '%://%'")
def str10_relative_paths(spark, d):
    """Paths below their root, with forward slashes."""
    path = F.regexp_replace(F.replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.lit("\\"), F.lit("/")), r"^[^/]*/?", "")
    return table(spark, d, "pages").filter("url like '%://%'").select(F.lit("claude").alias("agent"), "page_id", path.alias("path"))


@query(f"WITH {E} SELECT session_id, idx, array_to_string(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x != ''), '|') AS words FROM e WHERE text IS NOT NULL")
def str04_whitespace_words(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return events(spark, d).filter("text is not null").select("session_id", "idx", F.array_join(words, "|").alias("words"))


@query()
def fts13_snippets(spark, d):
    """Every matching document's snippet; no SQL expresses its window, so tests hold it against SQLite's own."""
    from ..functions.snippet import snippet_column

    p = plan(QUERY)
    hits = T.bm25(_docs(spark, d), p, ("doc_id",)).select("doc_id")
    return table(spark, d, "documents").join(hits, "doc_id", "left_semi").select("doc_id", snippet_column(F.col("text"), [x.places() for x in p.phrases]).alias("snippet"))


@query()
def fts20_search_snippets(spark, d):
    """The ranked search as users get it: coverage looks at the snippet that is shown."""
    rows = R.search(events(spark, d), sessions(spark, d), QUERY, AS_OF_MS)
    return R.result(rows).select("id", "lineage_root_id", "hits", F.round("score", 6).alias("score"), "best_match.snippet", "ask", "outcome")


@query()
def rel06_suite(spark, d):
    """The ranking suite's metrics by tag, over its own sessions."""
    from ..evaluate import evaluate

    return evaluate(spark)[1]
