"""Walks in rounds, formats of native files, and streams of changes."""

import json
import os
import time

import pytest

from sessionlake.archive import Archive
from sessionlake.scratch import Scratch
from sessionlake.sources import connectors, datasource, distributed
from sessionlake.sources.base import Candidate, Discovery, Parsed, Source, event, json_lines, read

from .test_archive import codex, lines


def test_walk_in_rounds_equals_one_process(spark, tmp_path):
    for k in range(40):
        lines(tmp_path / "root" / "/".join("abc"[: k % 4]) / f"d{k % 5}" / f"s{k}.jsonl", {"type": "user"})
        (tmp_path / "root" / f"other{k}.txt").write_text("x")
    lines(tmp_path / "outside/x.jsonl", {})
    os.symlink(tmp_path / "outside", tmp_path / "root/link")
    os.symlink(tmp_path / "outside/x.jsonl", tmp_path / "root/one.jsonl")
    lines(tmp_path / "root/p/subagents/k.jsonl", {})
    for root in (str(tmp_path / "root"), str(tmp_path / "none")):
        found = Discovery()
        want = sorted((c.path, c.native_id, c.parent_session_id, tuple(c.extra)) for c in connectors.REGISTRY["claude"].listing(root, found))
        got = distributed.walked(spark, "claude", root, Scratch(spark, "t"), "w").collect()
        assert sorted((r["path"], r["native_id"], r["parent_session_id"], tuple(r["extra"])) for r in got if r["category"] is None) == want
        assert len(want) == (41 if root.endswith("root") else 0)


def test_a_folder_that_cannot_be_listed_is_one_failure(spark, tmp_path, monkeypatch):
    codex(tmp_path / "src", "a1")
    root = tmp_path / "src"
    gone = root / "gone"
    gone.mkdir()
    gone.chmod(0)
    unreadable = not os.access(gone, os.R_OK)
    try:
        report = Archive(spark, str(tmp_path / "a")).ingest(("codex",), str(root))
    finally:
        gone.chmod(0o700)
    assert (report.ingested, report.failed) == (1, int(unreadable)) and (not unreadable or report.failures[0]["category"] == "permission")


def test_sessions_as_a_format(spark, tmp_path):
    for k in range(7):
        codex(tmp_path / "src" / f"d{k % 2}", f"a{k}", f"text {k}")
    (tmp_path / "src/rollout-bad.jsonl").write_text("{broken\n")
    datasource.register(spark)
    df = spark.read.format("codex").option("partitionBytes", 3_000_000).load(str(tmp_path / "src"))
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 4 and {r["session_id"] for r in rows if r["category"] is None} == {f"codex:a{k}" for k in range(7)}
    assert [(r["category"], r["path"].rsplit("/", 1)[-1]) for r in rows if r["category"]] == [("corrupt_data", "rollout-bad.jsonl")]
    a = Archive(spark, str(tmp_path / "a"))
    a.ingest(("codex",), str(tmp_path / "src"))
    columns = ["session_id", "idx", "kind", "text"]
    assert sorted(df.filter("category is null").select(columns).collect()) == sorted(a.events.select(columns).collect())
    (tmp_path / "empty").mkdir()
    assert spark.read.format("codex").load(str(tmp_path / "empty")).count() == 0


class Notes(Source):
    """A user's own format: a JSON line is a note."""

    agent = "notes"

    def keeps(self, p):
        return p.suffix == ".note"

    def parse(self, c: Candidate, root: str) -> Parsed:
        rows = json_lines(read(c.path), c.path)
        session = connectors._session("notes", c.native_id, connectors.Times(), {})
        return Parsed(session, [event("user", r["note"], r) for r in rows], [connectors.source(c, root)])


def test_a_users_parser_is_a_format_and_an_agent(spark, tmp_path):
    if "notes" not in connectors.REGISTRY:
        connectors.register(Notes())
    with pytest.raises(ValueError):
        connectors.register(Notes())
    (tmp_path / "n").mkdir()
    (tmp_path / "n/one.note").write_text(json.dumps({"note": "buy bulbs"}) + "\n")
    datasource.register(spark, connectors.REGISTRY["notes"])
    assert [(r["session_id"], r["text"]) for r in spark.read.format("notes").load(str(tmp_path / "n")).collect()] == [("notes:one", "buy bulbs")]
    a = Archive(spark, str(tmp_path / "a"))
    assert a.ingest(("notes",), str(tmp_path / "n")).ingested == 1
    assert [r["id"] for r in a.search("bulbs", as_of_ms=1).collect()] == ["notes:one"]


def test_changes_stream_once_each_and_survive_a_crash_before_the_checkpoint(spark, tmp_path):
    from sessionlake.streaming.changes import ingest

    codex(tmp_path / "src", "a1")
    codex(tmp_path / "src", "b2", "other")
    a, reports = Archive(spark, str(tmp_path / "a")), []

    def run(then=None):
        def told(report):
            reports.append(report)
            if then:
                raise RuntimeError(then)  # after the archive's commit, before Spark's

        query = ingest(a, "codex", str(tmp_path / "src"), str(tmp_path / "check"), told, once=True)
        query.awaitTermination(120)
        return query.exception()

    with pytest.raises(Exception, match="power cut"):
        run("power cut")
    commits = len(a.manifest()["commits"])
    assert reports[-1].ingested == 2 and a.sessions.count() == 2
    run()  # the same batch again
    assert (reports[-1].ingested, reports[-1].unchanged) == (0, 2) and len(a.manifest()["commits"]) == commits
    time.sleep(0.02)
    codex(tmp_path / "src", "a1", "a new text")
    codex(tmp_path / "src", "c3", "third")
    run()
    assert (reports[-1].discovered, reports[-1].ingested) == (2, 2) and a.sessions.count() == 3
    n = len(reports)
    run()
    assert sum(r.ingested for r in reports[n:]) == 0 and sorted(r["text"] for r in a.events.filter("kind = 'user'").collect()) == ["a new text", "other", "third"]


def test_bursts_are_one_row_and_what_keeps_changing_waits(spark, tmp_path):
    """Files of changes, as a stream: the changes of one path in a row come out once."""
    from sessionlake.streaming.changes import settled

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        changes = spark.readStream.schema("path string, mark string").json(str(tmp_path / "in"))
        query = settled(changes, 3000).writeStream.format("memory").queryName("settled").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()

        def change(n, *rows):
            staged = tmp_path / f"{n}.json"
            staged.write_text("".join(json.dumps({"path": p, "mark": m}) + "\n" for p, m in rows))
            staged.rename(tmp_path / "in" / staged.name)

        change(0, ("a", "1"), ("b", "1"))
        change(1, ("a", "2"))
        until = time.time() + 60
        while time.time() < until and spark.table("settled").count() < 2:
            time.sleep(0.5)
        got = {r["path"]: (r["mark"], r["changes"]) for r in spark.table("settled").collect()}
        query.stop()
        assert {p: n for p, (_, n) in got.items()} == {"a": 2, "b": 1} and got["b"][0] == "1" and got["a"][0] in ("1", "2")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
