import json
import os
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from sessionlake.archive import Archive, ArchiveError
from sessionlake.sources.connectors import REGISTRY, bundle


def lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    return path


def codex(root, native="a1", text="deploy the site", extra=()):
    return lines(
        root / f"rollout-{native}.jsonl",
        {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": native, "cwd": "/w", "model_provider": "p", "git": {"branch": "main"}}},
        {"type": "turn_context", "payload": {"model": "m1"}},
        {"type": "event_msg", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "user_message", "message": text}},
        {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}},
        {"type": "response_item", "timestamp": "2026-01-01T00:00:02Z", "payload": {"type": "function_call", "name": "run", "call_id": "c1", "arguments": "{}"}},
        {"type": "response_item", "timestamp": "2026-01-01T00:00:03Z", "payload": {"type": "function_call_output", "call_id": "c1", "output": "fine"}},
        {"type": "event_msg", "timestamp": "2026-01-01T00:00:04Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"total_tokens": 7}}}},
        {"type": "response_item", "timestamp": "2026-01-01T00:00:05Z", "payload": {"type": "message", "role": "assistant", "content": [{"text": "site deployed"}]}},
        *extra,
    )


def test_codex_records_and_lineage(tmp_path):
    spawn = {"type": "response_item", "payload": {"type": "function_call", "name": "spawn_agent", "call_id": "s", "arguments": '{"agent_type":"helper"}'}}
    answer = {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "s", "output": '{"agent_id":"b2"}'}}
    codex(tmp_path, "a1", extra=(spawn, answer))
    codex(tmp_path, "b2", "sub task")
    source = REGISTRY["codex"]
    found = {c.native_id: c for c in source.discover(str(tmp_path)).candidates}
    assert (found["b2"].parent_session_id, found["b2"].agent_type) == ("codex:a1", "helper") and ":lineage:" in found["b2"].fingerprint
    p = source.parse(found["a1"], str(tmp_path))
    assert [e["kind"] for e in p.events[:5]] == ["user", "tool_call", "tool_result", "usage", "assistant"]
    assert p.session["id"] == "codex:a1" and p.session["model"] == "m1" and p.session["git_branch"] == "main"
    assert p.session["ended_at_ms"] - p.session["started_at_ms"] == 5000 and p.events[3]["usage"] == {"total": 7}


def test_claude_gemini_pi_records(tmp_path):
    lines(
        tmp_path / "claude/proj/s1.jsonl",
        {"type": "user", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "uuid": "u1", "message": {"role": "user", "content": "hello"}, "forkedFrom": {"sessionId": "s0", "messageUuid": "m9"}},
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "message": {"model": "x", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "ls", "input": {"b": 1, "a": 2}}]}},
        {"type": "user", "toolUseResult": {"ok": True}},
        {"type": "unknown"},
    )
    lines(tmp_path / "claude/proj/s1/subagents/k.jsonl", {"type": "user", "sessionId": "s1", "message": {"content": "sub"}})
    (tmp_path / "claude/proj/s1/subagents/k.meta.json").write_text('{"agentType": "scout"}')
    lines(tmp_path / "claude/proj/workflows/x/journal.jsonl", {"type": "user"})
    c = REGISTRY["claude"]
    got = {p.session["id"]: p for _, p, e in c.parse_many(c.discover(str(tmp_path / "claude")).candidates, str(tmp_path)) if e is None}
    assert set(got) == {"claude:s1", "claude:s1/k"}
    main = got["claude:s1"]
    assert [(e["kind"], e["text"]) for e in main.events] == [("user", "hello"), ("thinking", "hm"), ("assistant", "hi"), ("tool_call", '{"a":2,"b":1}'), ("tool_result", '{"ok":true}')]
    assert main.session["forked_from"] == "claude:s0#m9" and main.events[4]["created_at_ms"] == 0
    assert json.loads(got["claude:s1/k"].session["meta_json"]) == {"isSubagent": True, "agentType": "scout"} and got["claude:s1/k"].session["parent_session_id"] == "claude:s1"

    (tmp_path / "g").mkdir()
    (tmp_path / "g/session-1.json").write_text(json.dumps({"sessionId": "g1", "startTime": "2026-01-01T00:00:00Z", "lastUpdated": "2026-01-01T00:01:00Z", "messages": [{"id": "1", "type": "user", "content": "q"}, {"id": "1", "type": "user", "content": "again"}, {"id": "2", "type": "gemini", "content": "a", "thoughts": [{"s": 1}], "toolCalls": [{"name": "t", "args": {"x": 1}, "result": [1]}]}, {"type": "user", "content": "<session_context> x"}]}))
    g = REGISTRY["gemini"]
    p = g.parse(g.discover(str(tmp_path / "g")).candidates[0], str(tmp_path))
    assert [e["kind"] for e in p.events] == ["user", "assistant", "thinking", "tool_call", "tool_result"] and p.session["provider"] == "google"

    lines(tmp_path / "p/x.jsonl", {"type": "session", "id": "p1", "cwd": "/w", "timestamp": 5000}, {"type": "message", "id": "m", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "toolCall", "name": "n", "arguments": {"a": 1}}, {"type": "image"}]}})
    lines(tmp_path / "p/y.jsonl", {"type": "session", "id": "p2", "cwd": "/tmp"})
    lines(tmp_path / "p/None.jsonl", {"type": "session", "id": "no"})
    s = REGISTRY["pi"]
    got = [p for _, p, e in s.parse_many(s.discover(str(tmp_path / "p")).candidates, str(tmp_path))]
    assert got[1] is None and [e["kind"] for e in got[0].events] == ["assistant", "tool_call", "system"] and got[0].session["started_at_ms"] == 5


def open_code(path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session(id TEXT, parent_id TEXT, directory TEXT, title TEXT, agent TEXT, model TEXT, time_created INT, time_updated INT)")
        db.execute("CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
        db.execute("CREATE TABLE part(id TEXT, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
        db.execute("INSERT INTO session VALUES ('o1', NULL, '/d', 'T', 'build', 'm', 10, 20), ('o2', 'o1', '/d', 'U', NULL, 'm', 11, NULL)")
        db.execute("""INSERT INTO message VALUES ('m1', 'o1', 1, 1, '{"role":"user"}'), ('m2', 'o1', 2, 2, '{}')""")
        db.execute("""INSERT INTO part VALUES ('p1', 'm1', 'o1', 1, 1, '{"type":"text","text":"ask"}'), ('p2', 'm1', 'o1', 2, 2, '{"type":"tool","tool":"ls","callID":"c","state":{"a":1}}')""")


def test_open_code_database(tmp_path):
    (tmp_path / "o").mkdir()
    open_code(tmp_path / "o/opencode.db")
    (tmp_path / "o/bad.db").write_bytes(b"not a database, but long enough to look at")
    s = REGISTRY["opencode"]
    found = s.discover(str(tmp_path / "o"))
    assert len(found.candidates) == 2 and len(found.failures) == 1
    p = s.parse(found.candidates[0], str(tmp_path))
    assert [(e["kind"], e["text"]) for e in p.events] == [("user", "ask"), ("tool_call", '{"a":1}')] and p.session["ended_at_ms"] == 20
    assert s.parse(found.candidates[1], str(tmp_path)).session["parent_session_id"] == "opencode:o1"
    assert bundle(str(tmp_path / "o/opencode.db"), "o1", str(tmp_path / "one.db")) == 5


@pytest.fixture
def archive(spark, tmp_path):
    codex(tmp_path / "src", "a1")
    codex(tmp_path / "src", "b2", "write some docs")
    a = Archive(spark, str(tmp_path / "arch"))
    a.ingest(("codex",), str(tmp_path / "src"))
    return a


def test_incremental_ingest_counts(spark, tmp_path):
    src = tmp_path / "src"
    codex(src, "a1")
    (src / "rollout-bad.jsonl").write_text('{"type":"session_meta"}\n{broken\n')
    a = Archive(spark, str(tmp_path / "arch"))
    dry = a.ingest(("codex",), str(src), dry_run=True)
    assert (dry.discovered, dry.parsed, dry.ingested, dry.failed) == (2, 1, 0, 1) and dry.estimated_bytes > 0 and a.sessions.count() == 0
    first = a.ingest(("codex",), str(src))
    assert (first.discovered, first.parsed, first.ingested, first.failed) == (2, 1, 1, 1)
    assert first.failures[0]["category"] == "corrupt_data" and ":2:" in first.failures[0]["message"]
    assert a.ingest(("codex",), str(src)).unchanged == 1
    codex(src, "a1", "another request")
    again = a.ingest(("codex",), str(src))
    assert (again.parsed, again.unchanged) == (1, 0)
    assert a.events.filter("kind = 'user'").select("text").collect()[0][0] == "another request" and a.sessions.count() == 1
    assert a.ingest(("codex",), str(src), since_ms=10**15).skipped_by_since == 2
    assert a.ingest(("codex",), str(src), exclude=("*rollout-bad*",)).failed == 0
    with pytest.raises(ArchiveError):
        a.ingest(("codex",), str(src), strict=True)
    with pytest.raises(ValueError):
        a.ingest(("codex",), str(src), exclude=("[",))


def test_search_list_show_stats(archive):
    top = archive.search("deploy", as_of_ms=1_800_000_000_000).collect()
    assert [r["id"] for r in top] == ["codex:a1"] and top[0]["ask"] == "deploy the site" and "«deploy»" in top[0]["best_match"]["snippet"]
    assert archive.search("  ").count() == 0 and archive.search("deploy", limit=0).count() == 0
    rows, cursor = archive.list(limit=1)
    more, end = archive.list(limit=1, cursor=cursor)
    assert {rows[0]["id"], more[0]["id"]} == {"codex:a1", "codex:b2"} and end is None and rows[0]["event_count"] == 5
    with pytest.raises(ValueError):
        archive.list(cursor="not-a-cursor")
    session, sources, events = archive.show("codex:a1", 1, 3)
    assert session["id"] == "codex:a1" and len(sources) == 1 and [e["idx"] for e in events] == [1, 2, 3] and archive.show("none") is None
    with pytest.raises(ValueError):
        archive.show("codex:a1", 3, 1)
    assert archive.stats().collect()[0].asDict() == {"agent": "codex", "sessions": 2, "events": 10, "full_sessions": 2}


def test_verify_backup_import_gc_restore(spark, archive, tmp_path):
    assert [(r["name"], r["passed"]) for r in archive.verify().collect()] == [(n, True) for n in ("storage", "foreign_keys", "contract", "index", "object_references", "objects")]
    archive.reindex()
    assert archive.backup(str(tmp_path / "copy")) == {"sessions": 2, "events": 10, "objects": 2}
    with pytest.raises(ArchiveError):
        archive.backup(str(tmp_path / "copy"))
    fresh = Archive(spark, str(tmp_path / "fresh"))
    assert fresh.import_archive(str(tmp_path / "copy"))["sessions_imported"] == 2
    again = fresh.import_archive(str(tmp_path / "copy"))
    assert (again["sessions_imported"], again["sessions_skipped"], again["events_skipped"]) == (0, 2, 10)
    with pytest.raises(ArchiveError):
        fresh.import_archive(str(tmp_path / "fresh"))
    assert archive.gc() == {"total": 2, "referenced": 2, "orphans": 0, "orphan_bytes": 0}
    with pytest.raises(ArchiveError):
        archive.gc(dry_run=False)
    out = archive.restore("codex:a1", str(tmp_path / "out"))
    original = tmp_path / "src/rollout-a1.jsonl"
    restored = tmp_path / "out/rollout-a1.jsonl"
    assert restored.read_bytes() == original.read_bytes() and os.stat(restored).st_mtime_ns == os.stat(original).st_mtime_ns and out["schema_version"] == "restore-manifest-v1" and len(out["files"]) == 1
    with pytest.raises(ValueError):
        archive.restore("codex:a1", str(tmp_path / "out"))
    assert archive.restore("codex:a1", str(tmp_path / "out"), overwrite=True)


def test_corrupt_objects_fail_the_check_and_the_restore(spark, archive, tmp_path):
    archive.commit({"objects": archive.table("objects").withColumn("payload", F.unhex(F.lit("00"))).withColumn("hash", F.concat(F.lit("x"), "hash"))})
    bad = {r["name"]: r["passed"] for r in archive.verify().collect()}
    assert not bad["objects"] and bad["object_references"]
    refs = archive.table("raw_sources").withColumn("object_hash", F.lit("gone"))
    archive.commit({"raw_sources": refs.withColumn("locator", F.lit("other"))})
    assert not {r["name"]: r["passed"] for r in archive.verify().collect()}["object_references"]
    with pytest.raises(ValueError):
        archive.restore("codex:a1", str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_sticky_sources_and_compaction(spark, archive):
    sources = archive.table("raw_sources").filter("session_id = 'codex:a1'")
    archive.write(archive.sessions.filter("id = 'codex:a1'"), archive.events.filter("session_id = 'codex:a1'"), sources.withColumn("locator", F.lit("second")).withColumn("restore_path", F.lit("second")))
    assert sorted(r["locator"].rsplit("/", 1)[-1] for r in archive.table("raw_sources").filter("session_id = 'codex:a1'").collect()) == ["rollout-a1.jsonl", "second"]
    before = sorted(map(tuple, archive.events.select("session_id", "idx", "text").collect()))
    archive.compact()
    assert len(archive.manifest()["commits"]) == 1 and sorted(map(tuple, archive.events.select("session_id", "idx", "text").collect())) == before


def test_commits_extend_the_index_and_replacements_shrink_it(spark, archive):
    assert archive.manifest()["index"]["n_docs"] == archive.table("docs").count() == 6
    ids = lambda q: [r["id"] for r in archive.search(q, as_of_ms=1_800_000_000_000).collect()]
    assert ids("docs") == ["codex:b2"]
    events = archive.events.filter("session_id = 'codex:b2'").withColumn("text", F.lit("entirely new words"))
    archive.write(archive.sessions.filter("id = 'codex:b2'"), events)
    assert ids("docs") == [] and ids("entirely new") == ["codex:b2"] and ids("deplo*") == ["codex:a1"]
    size = archive.manifest()["index"]
    archive.reindex()
    assert archive.manifest()["index"] == size and ids("entirely new") == ["codex:b2"]
    assert all(r["passed"] for r in archive.verify().collect())
    archive.reindex("segmenting")
    assert ids("deploying") == ["codex:a1"] and all(r["passed"] for r in archive.verify().collect())
    again = Archive(spark, archive.path)
    assert again.manifest()["tokenizer"] == "segmenting" and again.search("deploying").count() == 1
    with pytest.raises(ValueError):
        Archive(spark, archive.path, tokenizer="no such analyser")


def test_import_promotes_sessions_and_fills_objects(spark, archive, tmp_path):
    bare = Archive(spark, str(tmp_path / "bare"))
    bare.write(archive.sessions, archive.events, archive.table("raw_sources").withColumn("object_hash", F.lit(None).cast("string")))
    part = bare.sessions.withColumn("mode", F.lit("partial"))
    bare.commit({"sessions": part, "events": bare.events, "raw_sources": bare.table("raw_sources")}, part.select("id"))
    out = bare.import_archive(archive.path)
    assert out["sessions_promoted"] == 2 and out["objects_imported"] == 2 and out["events_imported"] == 0
    assert {r["mode"] for r in bare.sessions.collect()} == {"full"} and bare.events.count() == 10
    assert bare.table("raw_sources").filter("object_hash is null").count() == 0 and all(r["passed"] for r in bare.verify().collect())


def test_two_writers_do_not_both_win(archive):
    m = archive.manifest()
    archive.log.publish(m, m["version"] + 1)
    with pytest.raises(ArchiveError):
        archive.log.publish(m, m["version"] + 1)


def test_stream_once_runs_the_ingest(spark, archive, tmp_path):
    from sessionlake.streaming.watch import quiet_periods, stream

    codex(tmp_path / "src", "c3", "new one")
    seen = []
    query = stream(archive, seen.append, once=True, agents=("codex",), root=str(tmp_path / "src"))
    query.awaitTermination(120)
    assert seen and seen[0]["event"] == "run" and seen[0]["trigger"] == "startup" and seen[0]["report"].ingested == 1
    rows = spark.sql("SELECT timestamp_millis(x) AS at FROM VALUES (0), (400), (900), (5000) t(x)")
    assert sorted(r["changes"] for r in quiet_periods(rows, "at").collect()) == [1, 3]


class Counted:
    """Stands for an archive whose ingests only count."""

    def __init__(self, fail=False):
        self.n, self.fail = 0, fail

    def ingest(self, **how):
        self.n += 1
        if self.fail:
            raise OSError("no room")
        return self.n


def test_watch_triggers_debounce_and_failures(tmp_path):
    from sessionlake.streaming.watch import Burst, watch

    root, seen, stop = tmp_path / "src", [], threading.Event()
    root.mkdir()
    t = threading.Thread(target=lambda: seen.append(watch(Counted(), seen.append, 60, 300, stop=stop, root=str(root))))
    t.start()
    time.sleep(0.8)
    for k in range(4):  # one burst, one run
        (root / f"f{k}").write_text("x")
        time.sleep(0.1)
    time.sleep(1.8)
    stop.set()
    t.join(5)
    assert [e.get("trigger") for e in seen[:2]] == ["startup", "filesystem"] and seen[2]["event"] == "summary"
    assert seen[3].runs == 2 and seen[3].stopped and seen[3].watcher_available and not seen[3].issues

    events, stop = [], threading.Event()

    def broken(roots):
        raise OSError("cannot watch")

    t = threading.Thread(target=lambda: watch(Counted(), events.append, 0.4, 100, stop=stop, look=broken, root=str(root)))
    t.start()
    time.sleep(1.5)
    stop.set()
    t.join(5)
    assert [e["event"] for e in events[:2]] == ["issue", "run"] and sum(e["event"] == "issue" for e in events) == 1 and "periodic" in [e.get("trigger") for e in events]
    done = watch(Counted(), once=True, root=str(root))
    assert done.runs == 1 and not done.stopped
    with pytest.raises(OSError):
        watch(Counted(fail=True), once=True, root=str(root))
    with pytest.raises(ValueError):
        watch(Counted(), debounce_ms=0)

    burst = Burst(1.0)
    burst.look({}, {"a": (1, 1)}, 0.0)
    burst.look({"a": (1, 1)}, {"a": (2, 2)}, 0.9)  # the wait starts again
    burst.look({"a": (2, 2)}, {"a": (2, 2)}, 1.5)
    assert not burst.over(1.5) and burst.quiet_since is None
    burst.look({"a": (2, 2)}, {"a": (2, 2)}, 1.9)
    assert burst.quiet_since == 1.9 and not burst.over(2.0) and burst.over(2.15) and not burst.restless
    burst.look({"a": (2, 2)}, {"a": (3, 3), "b": (1, 1)}, 2.1)
    assert burst.over(2.15) and burst.restless == {"a", "b"}
    assert not Burst(1.0).over(99.0)
