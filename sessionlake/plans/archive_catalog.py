"""Registered queries that run a real archive: native files are written from ``conversations``, ingested, changed and ingested again.

Files lie below the shared folder, which must be a file system that tasks can open, as for any native source.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..archive import Archive
from ..scratch import shared_dir
from ..workers import ship
from .catalog import AS_OF_MS, BASE_MS, QUERY, TOKS, _bm25, _freq, query, sessions, table  # noqa: F401  TOKS is part of the statements below

_MADE: dict[tuple, str] = {}


def _record(agent: str, conv: str, turn: int, role: str, text: str) -> dict:
    at = f"2026-01-01T00:{turn // 60:02d}:{turn % 60:02d}Z"
    if agent == "claude":
        content = text if role != "assistant" else [{"type": "text", "text": text}]
        return {"type": role, "sessionId": conv, "timestamp": at, **({"content": text} if role == "system" else {"message": {"role": role, "content": content}})}
    if agent == "codex":
        return {"type": "response_item", "timestamp": at, "payload": {"type": "message", "role": role, "content": [{"type": "text", "text": text}]}}
    if agent == "gemini":
        return {"id": f"{conv}-{turn}", "type": {"assistant": "gemini", "system": "info"}.get(role, role), "timestamp": at, "content": text}
    return {"type": "message", "id": f"{conv}-{turn}", "timestamp": at, "message": {"role": role, "content": [{"type": "text", "text": text}]}}


def _head(agent: str, conv: str) -> list[dict]:
    if agent == "codex":
        return [{"type": "session_meta", "payload": {"id": conv, "cwd": "/w"}}]
    if agent == "gemini":
        return [{"sessionId": conv, "messages": []}]
    return [{"type": "session", "id": conv, "cwd": "/w"}] if agent == "pi" else []


NAMES = {"claude": "{}.jsonl", "codex": "rollout-{}.jsonl", "gemini": "session-{}.jsonl", "pi": "{}.jsonl"}


def write_native(spark: SparkSession, d: str, agent: str, folder: str, changed: bool = False) -> None:
    """A file for each conversation; ``changed`` writes those of every fifth again with one more answer."""
    os.makedirs(folder, exist_ok=True)
    ship(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            for conv, turns in zip(b["conv"], b["turns"], strict=True):
                rows = sorted((t["turn"], t["role"], t["text"]) for t in turns)
                rows += [(rows[-1][0] + 1, "assistant", "a late answer")] if changed else []
                records = [*_head(agent, conv), *[_record(agent, conv, *r) for r in rows]]
                with open(f"{folder}/{NAMES[agent].format(conv)}", "w", encoding="utf-8") as f:
                    f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records))
            yield pd.DataFrame({"n": [len(b)]})

    c = table(spark, d, "conversations")
    c = c.filter("conv_id % 5 = 0") if changed else c
    per = c.groupBy(F.format_string("c%06d", "conv_id").alias("conv")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    per.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/native-{uuid.uuid4().hex}"


def made(spark: SparkSession, d: str, agent: str = "claude", twice: bool = False) -> tuple[Archive, str, list]:
    """An archive of the conversations, the folder of its files, and the reports of its ingests; made once for each session."""
    key = (spark.sparkContext.applicationId, d, agent, twice)
    if key not in _MADE:
        root = _folder(spark)
        write_native(spark, d, agent, f"{root}/src")
        a = Archive(spark, f"{root}/archive")
        reports = [a.ingest((agent,), f"{root}/src")]
        if twice:
            reports.append(a.ingest((agent,), f"{root}/src"))
            write_native(spark, d, agent, f"{root}/src", changed=True)
            with open(f"{root}/src/broken.jsonl", "w") as f:
                f.write("{\n")
            reports.append(a.ingest((agent,), f"{root}/src", exclude=("*c00000[1-3]*",)))
        _MADE[key] = (root, reports)
    root, reports = _MADE[key]
    return Archive(spark, f"{root}/archive"), root, reports


def _events_sql(agent: str, roles: str) -> str:
    return f"SELECT '{agent}:c' || lpad(conv_id::VARCHAR, 6, '0') AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS idx, role AS kind, text FROM conversations WHERE role IN ({roles})"


def _native(agent: str, spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, agent)[0].events.select("session_id", "idx", "kind", "text")


@query(_events_sql("claude", "'user', 'assistant', 'system'"))
def src08_claude_ingest(spark, d):
    return _native("claude", spark, d)


@query(_events_sql("codex", "'user', 'assistant'"))
def src09_codex_ingest(spark, d):
    return _native("codex", spark, d)


@query(_events_sql("gemini", "'user', 'assistant', 'system'"))
def src10_gemini_ingest(spark, d):
    return _native("gemini", spark, d)


@query(_events_sql("pi", "'user', 'assistant', 'system'").replace("role AS kind", "CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS kind"))
def src11_pi_ingest(spark, d):
    """Messages of this format are a user's or else an assistant's."""
    return _native("pi", spark, d)


def _format(spark: SparkSession, agent: str, root: str) -> DataFrame:
    from ..sources import connectors, datasource

    datasource.register(spark, connectors.REGISTRY[agent])
    return spark.read.format(agent).load(root).filter("category is null").select("session_id", "idx", "kind", "text")


@query(_events_sql("codex", "'user', 'assistant'"))
def src01_codex_format(spark, d):
    """The native files through ``spark.read.format``."""
    return _format(spark, "codex", f"{made(spark, d, 'codex')[1]}/src")


@query(_events_sql("gemini", "'user', 'assistant', 'system'"))
def src04_whole_documents(spark, d):
    """Sessions as one indented JSON document each."""
    root = _folder(spark)

    def run(batches):
        import pandas as pd

        os.makedirs(root, exist_ok=True)
        for b in batches:
            for conv, turns in zip(b["conv"], b["turns"], strict=True):
                messages = [_record("gemini", conv, *r) for r in sorted((t["turn"], t["role"], t["text"]) for t in turns)]
                with open(f"{root}/session-{conv}.json", "w", encoding="utf-8") as f:
                    json.dump({"sessionId": conv, "messages": messages}, f, indent=2, ensure_ascii=False)
            yield pd.DataFrame({"n": [len(b)]})

    per = table(spark, d, "conversations").groupBy(F.format_string("c%06d", "conv_id").alias("conv")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    per.mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return _format(spark, "gemini", root)


@query("SELECT unnest([1, 2, 3]) AS run, unnest([count(DISTINCT conv_id), 0, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0)])::BIGINT AS ingested, unnest([count(DISTINCT conv_id), count(DISTINCT conv_id), count(DISTINCT conv_id)])::BIGINT AS sessions, unnest([count(*), count(*), count(*) + count(DISTINCT conv_id) FILTER (conv_id % 5 = 0)])::BIGINT AS events FROM conversations")
def stm01_changes_as_a_stream(spark, d):
    """Three starts of one streaming query over the native files: all, none, and every fifth that has changed."""
    from ..streaming.changes import ingest

    root = _folder(spark)
    write_native(spark, d, "pi", f"{root}/src")
    a, rows = Archive(spark, f"{root}/archive"), []
    for run in (1, 2, 3):
        if run == 3:
            write_native(spark, d, "pi", f"{root}/src", changed=True)
        reports = []
        query = ingest(a, "pi", f"{root}/src", f"{root}/check", reports.append, once=True)
        query.awaitTermination()
        rows.append((run, sum(r.ingested for r in reports), a.sessions.count(), a.events.count()))
    return spark.createDataFrame(rows, "run int, ingested long, sessions long, events long")


_LATE = "late AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'a late answer' FROM conversations WHERE conv_id % 5 = 0 AND conv_id NOT IN (1, 2, 3) GROUP BY conv_id)"


@query(f"WITH {_LATE} SELECT 'claude:c' || lpad(conv_id::VARCHAR, 6, '0') AS id, 'claude' AS agent, 'full' AS mode, epoch_ms(TIMESTAMP '2026-01-01' + INTERVAL 1 SECOND * min(turn)) AS started_at_ms, epoch_ms(TIMESTAMP '2026-01-01' + INTERVAL 1 SECOND * max(turn)) AS ended_at_ms, count(*) AS events FROM late GROUP BY conv_id")
def snk01_replaced_sessions(spark, d):
    a, _, _ = made(spark, d, twice=True)
    n = a.events.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    return a.sessions.select("id", "agent", "mode", "started_at_ms", "ended_at_ms").join(n, "id")


_RUN = "c AS (SELECT count(DISTINCT conv_id) AS n, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS late, count(DISTINCT conv_id) FILTER (conv_id IN (1, 2, 3)) AS gone FROM conversations)"


@query(f"WITH {_RUN} SELECT unnest([1, 2, 3]) AS run, unnest([n, n, n - gone + 1])::BIGINT AS discovered, unnest([n, 0, late])::BIGINT AS parsed, unnest([n, 0, late])::BIGINT AS ingested, unnest([0, n, n - gone - late])::BIGINT AS unchanged, unnest([0, 0, 1])::BIGINT AS failed FROM c")
def cdc01_incremental_ingest(spark, d):
    reports = made(spark, d, twice=True)[2]
    rows = [(i + 1, r.discovered, r.parsed, r.ingested, r.unchanged, r.failed) for i, r in enumerate(reports)]
    return spark.createDataFrame(rows, "run int, discovered long, parsed long, ingested long, unchanged long, failed long")


@query(f"WITH {_RUN} SELECT n - gone AS discovered, n - gone AS parsed, 0::BIGINT AS ingested, 0::BIGINT AS stored FROM c")
def cdc02_dry_run(spark, d):
    _, root, _ = made(spark, d)
    empty = Archive(spark, f"{root}/dry-{uuid.uuid4().hex}")
    r = empty.ingest(("claude",), f"{root}/src", exclude=("*c00000[1-3]*",), dry_run=True)
    return spark.createDataFrame([(r.discovered, r.parsed, r.ingested, empty.sessions.count())], "discovered long, parsed long, ingested long, stored long")


@query("SELECT count(DISTINCT conv_id) AS skipped, 0::BIGINT AS parsed FROM conversations")
def flt11_since_skips_older_files(spark, d):
    a, root, _ = made(spark, d)
    r = a.ingest(("claude",), f"{root}/src", since_ms=int(time.time() * 1000) + 86_400_000)
    return spark.createDataFrame([(r.skipped_by_since, r.parsed)], "skipped long, parsed long")


@query(f"WITH {_LATE}, t AS (SELECT conv_id, turn, unnest(list_distinct({TOKS})) AS term FROM late) SELECT term, count(*) AS df FROM t GROUP BY term")
def fts06_incremental_index(spark, d):
    """Document frequencies in the stored postings after sessions were replaced."""
    return made(spark, d, twice=True)[0].postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {_LATE}, {_bm25('late', 'conv_id, turn')} SELECT 'claude:c' || lpad(conv_id::VARCHAR, 6, '0') AS id, count(*) AS hits FROM hits GROUP BY conv_id QUALIFY row_number() OVER (ORDER BY min(bm25)) <= 1000000")
def fts14_stored_index_hits(spark, d):
    """Hits by session, from the stored postings of several commits."""
    from ..operators import fulltext
    from .query import plan

    a, _, _ = made(spark, d, twice=True)
    p, size = plan(QUERY), a.manifest()["index"]
    found, at = fulltext.candidates_from_postings(a.postings(p), p)
    hits = fulltext.bm25(found, p, totals=(size["n_docs"], size["n_tokens"] / size["n_docs"]), toks=at)
    return hits.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH {_LATE}, {_bm25('late', 'conv_id, turn')}, own AS (SELECT conv_id, bm25, row_number() OVER (PARTITION BY conv_id ORDER BY bm25, turn) AS k FROM hits), best AS (SELECT bm25, row_number() OVER (ORDER BY bm25) AS rank FROM own WHERE k <= 50) SELECT rank, round(bm25, 6) AS bm25 FROM best WHERE rank <= 500")
def fts14_best_by_blocks(spark, d):
    """The scores of the 500 best hits, 50 to a session, from the blocks of postings that may hold them."""
    from ..operators import search, topk
    from .query import plan

    a, _, _ = made(spark, d, twice=True)
    top = topk.top(plan(QUERY), a.lists(), 500, search.best_hits)
    return spark.createDataFrame([(i + 1, round(r["bm25"], 6)) for i, r in enumerate(top)], "rank long, bm25 double")


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS events, count(*) FILTER (role IN ('user', 'assistant', 'system')) AS indexed, count(*) FILTER (role IN ('user', 'assistant', 'system')) AS documents, count(DISTINCT conv_id) AS objects, true AS sound FROM conversations WHERE role IN ('user', 'assistant', 'system')")
def snk01_two_writers(spark, d):
    """Two writers ingest the same files, one between the other's writing and publishing: totals are those of one ingest, and every check passes."""
    _, root, _ = made(spark, d)
    path, written, raced = f"{root}/raced-{uuid.uuid4().hex}", [], []
    a = Archive(spark, path)
    inner = a.log._written

    def slow(*args):
        entry = inner(*args)
        written.append(entry["name"])
        if len(written) == 1:
            raced.append(Archive(spark, path).ingest(("claude",), f"{root}/src"))
        return entry

    a.log._written = slow
    a.ingest(("claude",), f"{root}/src")
    assert len(written) == 2  # the first was given up for what the other had published
    n = a.manifest()["index"]["n_docs"]
    row = (a.sessions.count(), a.events.count(), n, a.table("docs").count(), a.table("objects").count(), all(r["passed"] for r in a.verify().collect()))
    return spark.createDataFrame([row], "sessions long, events long, indexed long, documents long, objects long, sound boolean")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT conv_id AS c FROM conversations), w AS (SELECT c, c AS node, 0::BIGINT AS depth FROM n UNION ALL SELECT w.c, n.c, depth + 1 FROM w JOIN n ON n.c = node - 1 WHERE node % 4 IN (1, 3))
SELECT 'c:' || lpad(c::VARCHAR, 6, '0') AS id, 'c:' || lpad(arg_max(node, depth)::VARCHAR, 6, '0') AS root, max(depth) AS depth FROM w GROUP BY c""")
def gra01_kept_roots(spark, d):
    """Roots that commits keep: children come first, then what they descend from, then every fourth session is written again without its parent."""
    a, rows = Archive(spark, _folder(spark)), sessions(spark, d)
    number = F.substring("id", 3, 20).cast("long")
    a.commit({"sessions": rows.filter(number % 2 == 1)})
    a.commit({"sessions": rows.filter(number % 2 == 0)})
    alone = rows.filter(number % 4 == 2).withColumn("parent_session_id", F.lit(None).cast("string"))
    a.commit({"sessions": alone}, alone.select("id"))
    return a.roots()


@query("SELECT unnest(['storage']) AS name, false AS passed, 1::BIGINT AS n_failures FROM (SELECT count(*) FROM conversations)")
def vfy01_flipped_byte(spark, d):
    """A copy of the archive in which one byte of one file of events has changed."""
    a, root, _ = made(spark, d)
    target = f"{root}/damaged-{uuid.uuid4().hex}"
    a.backup(target)
    copy = Archive(spark, target)
    name = copy.store.files("data/events")[0]
    with open(f"{target}/{name}", "r+b") as f:
        f.seek(os.path.getsize(f.name) // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))
    return copy.verify().select("name", "passed", "n_failures")


@query("SELECT unnest(['storage', 'foreign_keys', 'contract', 'index', 'object_references', 'objects']) AS name, true AS passed")
def vfy07_report(spark, d):
    return made(spark, d, twice=True)[0].verify().select("name", "passed")


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS events, count(DISTINCT conv_id) AS objects FROM conversations")
def snk05_backup(spark, d):
    a, root, _ = made(spark, d)
    return spark.createDataFrame([tuple(a.backup(f"{root}/copy-{uuid.uuid4().hex}").values())], "sessions long, events long, objects long")


@query("SELECT unnest([1, 2]) AS run, unnest([count(DISTINCT conv_id), 0])::BIGINT AS sessions_imported, unnest([count(*), 0])::BIGINT AS events_imported, unnest([0, count(DISTINCT conv_id)])::BIGINT AS sessions_skipped FROM conversations")
def snk06_import(spark, d):
    a, root, _ = made(spark, d)
    fresh = Archive(spark, f"{root}/import-{uuid.uuid4().hex}")
    runs = [fresh.import_archive(a.path) for _ in range(2)]
    return spark.createDataFrame([(i + 1, r["sessions_imported"], r["events_imported"], r["sessions_skipped"]) for i, r in enumerate(runs)], "run int, sessions_imported long, events_imported long, sessions_skipped long")


@query("SELECT 'claude:c' || lpad(min(conv_id)::VARCHAR, 6, '0') AS id, true AS same FROM conversations")
def snk08_restore(spark, d):
    a, root, _ = made(spark, d)
    first = a.sessions.agg(F.min("id").alias("id")).first()["id"]
    target = f"{root}/restored-{uuid.uuid4().hex}"
    a.restore(first, target)
    name = f"{first.split(':')[1]}.jsonl"
    digests = [hashlib.sha256(open(f"{x}/{name}", "rb").read()).hexdigest() for x in (target, f"{root}/src")]
    return spark.createDataFrame([(first, digests[0] == digests[1])], "id string, same boolean")


@query("SELECT 'claude:c' || lpad(conv_id::VARCHAR, 6, '0') AS session_id, 'file' AS kind, 'c' || lpad(conv_id::VARCHAR, 6, '0') || '.jsonl' AS restore_path, true AS stored FROM conversations GROUP BY conv_id")
def snk03_stored_originals(spark, d):
    """Each session's source with whether its stored object decodes to the bytes that its hash names."""
    from ..verify import _sound

    a, _, _ = made(spark, d)
    sound = a.table("objects").select(F.col("hash").alias("object_hash"), _sound("compression", "bytes", "payload", "hash").alias("stored"))
    return a.table("raw_sources").join(sound, "object_hash", "left").select("session_id", "kind", "restore_path", "stored")
