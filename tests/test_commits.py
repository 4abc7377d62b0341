"""Commits beside other writers, merging, pruning by surveys, damage, and top-k search by blocks."""

import json
import random
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionlake import commits, schema as M
from sessionlake.archive import Archive, ArchiveError
from sessionlake.operators import fulltext, lineage, search, topk
from sessionlake.plans.query import plan as plan_query

from .test_archive import codex


def rows_of(spark, ids, text, mode="full"):
    """Frames of sessions with three events each."""
    s = spark.createDataFrame([(i, "codex", k * 1000) for k, i in enumerate(ids)], "id string, agent string, ended_at_ms long")
    s = s.withColumns({"mode": F.lit(mode), "fingerprint": F.lit("f"), "meta_json": F.lit("{}"), "ingested_at_ms": F.lit(1).cast("long"), "cwd": F.lit("/w"), "title": F.lit("t")})
    e = spark.createDataFrame([(i, k, kind, f"{text} {kind} {i}") for i in ids for k, kind in enumerate(("user", "assistant", "user"))], "session_id string, idx long, kind string, text string")
    return s, e


def passes(a):
    return {r["name"]: r["passed"] for r in a.verify().collect()}


def between(a, monkeypatch, other):
    """Lets ``other`` run once after a commit's files are written and before it is published."""
    written, done = a.log._written, []

    def slow(*args):
        entry = written(*args)
        if not done:
            done.append(1)
            other()
        return entry

    monkeypatch.setattr(a.log, "_written", slow)


def test_two_writers_of_one_session_leave_a_sound_archive(spark, tmp_path, monkeypatch):
    """Both ingest the same file, the second between the first's writing and publishing."""
    codex(tmp_path / "src", "a1")
    codex(tmp_path / "src", "b2", "write some docs")
    a = Archive(spark, str(tmp_path / "arch"))
    between(a, monkeypatch, lambda: Archive(spark, a.path).ingest(("codex",), str(tmp_path / "src")))
    a.ingest(("codex",), str(tmp_path / "src"))
    assert all(passes(a).values()) and a.sessions.count() == 2 and a.events.count() == 10
    assert a.manifest()["index"]["n_docs"] == a.table("docs").count() == 6
    assert a.table("objects").groupBy("hash").count().filter("count > 1").isEmpty()
    a.restore("codex:a1", str(tmp_path / "out"))
    assert (tmp_path / "out/rollout-a1.jsonl").read_bytes() == (tmp_path / "src/rollout-a1.jsonl").read_bytes()


def test_a_commit_that_is_built_again_keeps_the_lists_of_its_events(spark, tmp_path, monkeypatch):
    """The other writer has the same sessions with other texts: what counts is this one's, whose texts are cut and listed once."""
    a, lists, cut = Archive(spark, str(tmp_path / "arch")), [], fulltext.blocks
    a.write(*rows_of(spark, ["codex:a", "codex:b"], "old"))
    other = lambda: Archive(spark, a.path).write(*rows_of(spark, ["codex:b", "codex:c"], "other"))
    between(a, monkeypatch, lambda: (other(), lists.clear()))
    monkeypatch.setattr(fulltext, "blocks", lambda *args, **k: lists.append(1) or cut(*args, **k))
    a.write(*rows_of(spark, ["codex:a", "codex:b"], "new"))
    assert not lists and all(passes(a).values()) and a.table("docs").count() == 9
    df = {r["term"]: r["df"] for r in a.table("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0").collect()}
    assert (df["new"], df["other"], df.get("old"), df["new user"], df.get("old user")) == (6, 3, None, 4, None)
    assert len(list((tmp_path / "arch/data/events").iterdir())) == 3


def test_a_commit_of_other_sessions_goes_behind(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "arch"))
    builds = []
    between(a, monkeypatch, lambda: Archive(spark, a.path).write(*rows_of(spark, ["codex:b"], "beta")))
    a.log.commit(lambda m: builds.append(m["version"]) or (dict(zip(("sessions", "events"), rows_of(spark, ["codex:a"], "alpha"), strict=True)), None))
    assert builds == [0] and [c["seq"] for c in a.manifest()["commits"]] == [1, 2]
    assert a.sessions.count() == 2 and all(passes(a).values())


def test_another_analyser_in_between_indexes_again(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*rows_of(spark, ["codex:a"], "walking"))
    between(a, monkeypatch, lambda: Archive(spark, a.path).reindex("segmenting"))
    a.write(*rows_of(spark, ["codex:b"], "running"))
    assert a.manifest()["tokenizer"] == "segmenting" and {c["tokenizer"] for c in a.manifest()["commits"] if "docs" in c["tables"]} == {"segmenting"}
    assert [r["id"] for r in a.search("run", as_of_ms=1).collect()] == ["codex:b"] and all(passes(a).values())


def test_a_writer_that_always_loses_gives_up(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "arch"))
    monkeypatch.setattr(a.log, "_shared", lambda entry, later: "session x")
    monkeypatch.setattr(commits, "ATTEMPTS", 2)
    written = a.log._written

    def slow(*args):
        entry = written(*args)
        m = a.manifest()
        a.log.publish(m | {"commits": [*m["commits"], commits.Log._entry(a.log, m["tokenizer"]) | {"seq": m["version"] + 1, "files": {}, "roots": {}}]}, m["version"] + 1)
        return entry

    monkeypatch.setattr(a.log, "_written", slow)
    with pytest.raises(ArchiveError):
        a.log.commit(lambda m: ({"sessions": rows_of(spark, ["codex:a"], "x")[0]}, None))
    assert not (tmp_path / "arch/data/sessions").exists() or not list((tmp_path / "arch/data/sessions").iterdir())


def test_merging_keeps_rows_totals_and_a_bounded_number_of_commits(spark, tmp_path, monkeypatch):
    """Random replacements: after each commit the archive is what a dictionary says, and commits stay few."""
    monkeypatch.setattr(commits, "FANOUT", 2)
    a, r, held = Archive(spark, str(tmp_path / "arch")), random.Random(3), {}
    for step in range(4):
        ids = [f"codex:{k}" for k in r.sample(range(6), r.randrange(1, 4))]
        a.write(*rows_of(spark, ids, f"step{step}"))
        held |= {i: step for i in ids}
    m = a.manifest()
    assert len(m["commits"]) <= 4 and [c["seq"] for c in m["commits"]] == sorted(c["seq"] for c in m["commits"])
    got = {(x["session_id"], x["text"].split(" ")[0]) for x in a.events.select("session_id", "text").collect()}
    assert got == {(i, f"step{s}") for i, s in held.items()} and all(passes(a).values())
    before = {(x["term"], x["session_id"], x["idx"], tuple(x["positions"])) for x in a.postings().collect()}
    a.compact()
    assert {(x["term"], x["session_id"], x["idx"], tuple(x["positions"])) for x in a.postings().collect()} == before
    assert len(a.manifest()["commits"]) == 1 and all(passes(a).values())


def test_an_index_of_older_commits_is_not_merged_away(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FANOUT", 2)
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*rows_of(spark, [f"codex:{k}" for k in range(8)], "old"))
    a.reindex()
    for k in range(3):
        a.write(*rows_of(spark, [f"codex:{k}", f"codex:new{k}"], "new"))
    assert len([r for r in a.search("old", as_of_ms=1).collect()]) == 5 and len(a.search("new", as_of_ms=1).collect()) == 6
    assert all(passes(a).values())
    a.reindex()
    a.compact()
    assert len(a.manifest()["commits"]) == 1 and len(a.search("old", as_of_ms=1).collect()) == 5 and all(passes(a).values())


def test_classes_of_commits_fall_from_old_to_new():
    def run(sizes):
        log = []
        for n in sizes:
            log.append({"rows": {"events": n}})
            while t := commits.tail(log):
                log[len(log) - len(t) :] = [{"rows": {"events": sum(c["rows"]["events"] for c in t)}}]
        return log

    r = random.Random(1)
    for sizes in ([1] * 5000, [r.choice([1, 3, 70, 5000]) for _ in range(3000)], [8**k for k in range(8)] * 20):
        log = run(sizes)
        classes = [commits.size_class(c) for c in log]
        assert sum(c["rows"]["events"] for c in log) == sum(sizes)
        assert classes == sorted(classes, reverse=True) and max(map(classes.count, classes)) < commits.FANOUT


def test_a_thousand_commits_are_two_scans(spark, tmp_path):
    """Files of a thousand commits that nothing has merged yet, written by hand; the newest row of each session counts."""
    a = Archive(spark, str(tmp_path / "arch"))
    entries, newest, r = [], {}, random.Random(2)
    for k in range(1000):
        entry = a.log._entry("unicode61 remove_diacritics 2") | {"seq": k + 1, "tables": ["replaced", "sessions"], "files": {}, "roots": {}}
        ids = [f"s{r.randrange(300)}"]
        newest |= dict.fromkeys(ids, k)
        for t, table in (("sessions", pa.table({"id": ids, "title": [str(k)] * len(ids)})), ("replaced", pa.table({"id": ids}))):
            folder = Path(a.path, "data", t, f"commit={entry['name']}")
            folder.mkdir(parents=True)
            pq.write_table(table, folder / "part.parquet")
        entries.append(entry)
    m = a.manifest()
    a.log.publish(m | {"commits": entries}, m["version"] + 1)
    rows = a.sessions.select("id", "title")
    assert {x["id"]: int(x["title"]) for x in rows.collect()} == newest
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 2


def test_list_and_show_open_few_files(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "arch"))
    s, e = rows_of(spark, [f"codex:{k:03d}" for k in range(400)], "many")
    a.log.commit(lambda m: ({"sessions": s.repartitionByRange(20, "ended_at_ms"), "events": e.repartitionByRange(20, "session_id")}, None))
    m = a.manifest()
    opened = lambda df: len(df.inputFiles())
    assert m["commits"][0]["files"]["sessions"] == 20
    newest = a._newest(10, None, {}, m)
    assert opened(newest) <= 4 and [r["id"] for r in a.list(10)[0]] == [f"codex:{k:03d}" for k in range(399, 389, -1)]
    rows, cursor = [], None
    for _ in range(5):
        page, cursor = a.list(90, cursor)
        rows += [r["id"] for r in page]
    assert rows == [f"codex:{k:03d}" for k in range(399, -1, -1)] and cursor is None
    assert [r["id"] for r in a.list(10, agent="none")[0]] == []
    held = a.log.files_with(("sessions", "events"), ["codex:123"], m)
    assert sum(len(f) for f in held["events"].values()) == 1 and sum(len(f) for f in held["sessions"].values()) <= 3
    session, _, events = a.show("codex:123")
    assert session["id"] == "codex:123" and len(events) == 3 and a.show("codex:none") is None


@pytest.mark.parametrize("table", ["events", "postings"])
def test_one_flipped_byte_in_a_data_page_is_found(spark, tmp_path, table):
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*rows_of(spark, [f"codex:{k}" for k in range(50)], "steady"))
    assert all(passes(a).values())
    path = next(Path(a.path, "data", table).rglob("*.parquet"))
    column = pq.ParquetFile(path).metadata.row_group(0).column(0)
    raw = bytearray(path.read_bytes())
    raw[column.data_page_offset + column.total_compressed_size // 2] ^= 0x10
    path.write_bytes(raw)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    report = {r["name"]: r for r in Archive(spark, a.path).verify().collect()}
    assert not report["storage"]["passed"] and report["storage"]["n_failures"] == 1 and path.name in report["storage"]["failures"][0]
    assert spark.read.parquet(report["storage"]["failed"]).count() == 1


def test_a_changed_survey_is_found(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*rows_of(spark, ["codex:a"], "x"))
    path = next(Path(a.path, "data/survey").rglob("*.parquet"))
    t = pq.read_table(path)
    pq.write_table(t.set_column(t.column_names.index("rows"), "rows", pa.array([n + 1 for n in t["rows"].to_pylist()], pa.int64())), path)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert not passes(a)["storage"]


def ranked(rows):
    return [(r["session_id"], r["idx"], r["bm25"]) for r in rows]


def test_top_hits_by_blocks_equal_all_postings(spark, tmp_path, monkeypatch):
    from sessionlake.operators import fulltext

    monkeypatch.setattr(fulltext, "BLOCK_BITS", 3)
    a, r = Archive(spark, str(tmp_path / "arch")), random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rare"]

    def made(ids, n):
        s = rows_of(spark, ids, "x")[0]
        e = [(i, k, "user", " ".join(r.choices(words, [8, 5, 3, 2, 0.1], k=r.randrange(1, 12)))) for i in ids for k in range(n)]
        return s, spark.createDataFrame(e, "session_id string, idx long, kind string, text string")

    a.write(*made([f"codex:{k:03d}" for k in range(150)], 4))
    a.write(*made([f"codex:{k:03d}" for k in range(20)] + ["codex:long"], 70))
    m = a.manifest()
    totals = (m["index"]["n_docs"], m["index"]["n_tokens"] / m["index"]["n_docs"])
    skipped = 0
    for query, cap in [("alpha", 5), ("rare", 30), ("rare beta", 7), ("alpha beta", 20), ("gamma gamma", 10), ('"delta alpha" OR rare OR rare', 15), ("nowhere", 5), ("alpha", 5000), ("delta gamma", 100)]:
        plan, seen = plan_query(query), {}
        for sessions in (None, a.sessions.filter("id > 'codex:05'")):
            got = topk.top(plan, a.lists(m), cap, search.best_hits, sessions, seen)
            want = search.candidates(a.events, sessions, plan, cap, a.postings(plan, m), totals).collect()
            assert ranked(got) == ranked(want), (query, cap)
            skipped += seen.get("read") is not None and seen["read"] < seen["of"]
    assert skipped > 3
    assert topk.lists(plan_query("one two three")) is None and topk.lists(plan_query("alph*")) is None
    assert a.search("alpha beta", as_of_ms=1).collect() == a.search("alpha beta", as_of_ms=1, skipping=False).collect()


def test_manifest_holds_no_totals_of_its_own(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*rows_of(spark, ["codex:a", "codex:b"], "x"))
    a.write(*rows_of(spark, ["codex:b"], "y z"))
    stored = json.loads(sorted(Path(a.path, "manifest").glob("0*.json"))[-1].read_text())
    assert "index" not in stored and a.manifest()["index"]["n_docs"] == 6
    assert sum(c["dead"]["n_docs"] for c in stored["commits"]) in (0, 3)
    assert a.table("terms").filter("NOT pair AND term = 'x'").agg(F.sum("df")).first()[0] == 3
    assert M.TABLES.keys() <= commits.STORED.keys() and uuid.UUID(stored["commits"][0]["name"])


def descended(spark, steps, text):
    """Frames of sessions with parents."""
    s, e = rows_of(spark, sorted(steps), text)
    parents = spark.createDataFrame([(i, p) for i, p in steps.items()], "id string, parent_session_id string")
    return s.join(parents, "id"), e


def roots(a):
    return {r["id"]: (r["root"], r["depth"]) for r in a.roots().collect()}


def walked(a):
    return {r["id"]: (r["root"], r["depth"]) for r in lineage.paths(a.sessions).collect()}


def test_roots_are_kept_over_commits_merges_and_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FANOUT", 2)
    a, r, ids = Archive(spark, str(tmp_path / "arch")), random.Random(5), [f"codex:{k}" for k in range(8)]
    for step in range(3):
        a.write(*descended(spark, {i: r.choice([None, *ids]) for i in r.sample(ids, r.randrange(2, 6))}, f"deploy step{step}"))
        assert roots(a) == walked(a)
    assert any("roots" in c["tables"] for c in a.manifest()["commits"])
    got = a.search("deploy", as_of_ms=1).collect()
    monkeypatch.setattr(a, "_roots", lambda m: None)
    assert got == a.search("deploy", as_of_ms=1).collect() and got
    a.reindex()
    assert roots(a) == walked(a)
    a.compact()
    assert roots(a) == walked(a) and all(passes(a).values())


def test_a_parent_that_comes_in_between_is_seen(spark, tmp_path, monkeypatch):
    a = Archive(spark, str(tmp_path / "arch"))
    between(a, monkeypatch, lambda: Archive(spark, a.path).write(*rows_of(spark, ["codex:top"], "first")))
    a.write(*descended(spark, {"codex:low": "codex:top"}, "second"))
    assert roots(a) == {"codex:low": ("codex:top", 1), "codex:top": ("codex:top", 0)}


def test_an_archive_without_kept_roots_walks_until_it_is_compacted(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "arch"))
    a.write(*descended(spark, {"codex:a": None, "codex:b": "codex:a", "codex:c": "codex:b"}, "old"))
    m = a.manifest()
    a.log.publish(m | {"commits": [{k: v for k, v in c.items() if k != "lineage"} | {"tables": [t for t in c["tables"] if t != "roots"]} for c in m["commits"]]}, m["version"] + 1)
    want = {"codex:a": ("codex:a", 0), "codex:b": ("codex:a", 1), "codex:c": ("codex:a", 2)}
    assert roots(a) == want and a._roots(a.manifest()) is None
    a.write(*descended(spark, {"codex:d": "codex:c"}, "new"))
    want["codex:d"] = ("codex:a", 3)
    assert roots(a) == want and a._roots(a.manifest()) is None
    a.compact()
    assert roots(a) == want and a._roots(a.manifest()) is not None
    assert [r["lineage_root_id"] for r in a.search("old OR new", as_of_ms=1).collect()] == ["codex:a"]
