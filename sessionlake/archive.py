"""An archive of sessions: ingest, search, list, show, maintenance.

Its tables are immutable Parquet files under the versioned log of :mod:`commits`: readers see whole commits, writers replace whole sessions and are safe beside each
other. Each commit indexes its own events, so the full-text index grows with the commits and loses rows as any table does; ``reindex`` writes it anew.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema as M
from .commits import ArchiveError, Commit, Log, Manifest, below, keeps_roots
from .functions.analysers import PORTABLE, analyser
from .functions.text import glob
from .functions.values import since_ms as parse_since  # noqa: F401  part of this module's surface
from .operators import fulltext, lineage, listing, search as ranking, tables as K, topk
from .plans.query import Plan, plan as plan_query
from .scratch import Scratch
from .sources import distributed as D
from .sources.base import Candidate, Parsed, categorise
from .sources.connectors import native_root
from .storage import Store
from .workers import ship


LEAST_FILES = 4
FAILURES_TOLD = 1000


@dataclass
class IngestReport:
    discovered: int = 0
    parsed: int = 0
    ingested: int = 0
    unchanged: int = 0
    skipped: int = 0
    skipped_by_since: int = 0
    failed: int = 0
    events: int = 0
    estimated_bytes: int = 0
    failures: list[dict[str, str]] = field(default_factory=list)

    def add(self, stage: str, path: str, error: BaseException | str, category: str | None = None) -> None:
        self.failed += 1
        self.failures.append({"stage": stage, "category": category or categorise(error), "path": path, "message": str(error)})


class Archive:
    """Reads and writes one archive folder; every read method returns DataFrames over the manifest's files."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True, tokenizer: str | None = None):
        self.spark, self.path = spark, str(path).rstrip("/")
        self.log = Log(spark, self.path)
        self.store = self.log.store
        ship(spark)
        if not self.log.versions():
            if not create:
                raise ArchiveError(f"no archive at {path}")
            analyser(tokenizer or PORTABLE.name)
            self.log.publish({"schema_version": M.SCHEMA_VERSION, "contract": M.CONTRACT, "tokenizer": tokenizer or PORTABLE.name, "commits": [], "telemetry": {}}, 0)
        m = self.manifest()
        if m["schema_version"] > M.SCHEMA_VERSION:
            raise ArchiveError(f"this archive's schema {m['schema_version']} is beyond {M.SCHEMA_VERSION}, the newest known here")
        if tokenizer is not None and m["tokenizer"] != tokenizer:
            self.reindex(tokenizer)

    # Tables

    def manifest(self) -> Manifest:
        return self.log.manifest()

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        return self.log.table(name)

    @property
    def sessions(self) -> DataFrame:
        return self.table("sessions")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    def postings(self, plan: Plan | None = None, m: Manifest | None = None) -> DataFrame:
        """Live postings, a row for each term and event; of the plan's tokens only the folders that hold them."""
        m = m or self.manifest()
        pick = lambda c: fulltext.folders(plan, c["buckets"], c["held"]["postings"]) if plan else [f"bucket={b}" for b in c["held"]["postings"]]
        holding = [c for c in m["commits"] if "postings" in c["tables"]]
        return self._live(fulltext.posts_of(self.log.scan("postings", holding, pick)), holding, m).drop("commit")

    def _live(self, rows: DataFrame, holding: list[Commit], m: Manifest) -> DataFrame:
        return self.log.live(rows, "session_id", holding, m["commits"]) if holding else rows

    def lists(self, m: Manifest | None = None) -> topk.Lists | None:
        """The stored lists of postings, where the index holds pairs and frequencies."""
        m = m or self.manifest()
        size, holding = m["index"], [c for c in m["commits"] if "postings" in c["tables"]]
        if not analyser(m["tokenizer"]).plain or not holding:
            return None

        def blocks(pair: bool, terms: list[str]) -> DataFrame:
            name = "pairs" if pair else "postings"
            return self.log.scan(name, [c for c in holding if name in c["tables"]], lambda c: fulltext.of_terms(terms, c["buckets"], c["held"][name]))

        return topk.Lists(blocks, lambda rows: self._live(rows, holding, m), self.log.table("terms", m), size["n_docs"], size["n_tokens"] / max(1, size["n_docs"]))

    def commit(self, frames: dict[str, DataFrame], replaced: DataFrame | None = None, telemetry: dict[str, Any] | None = None) -> None:
        """Adds the frames' rows; rows of ``replaced`` session ids in earlier commits die."""
        self.log.commit(lambda m: (frames, replaced), telemetry)
        self.log.tidy()

    def compact(self) -> None:
        """One commit in place of all."""
        if commits := self.manifest()["commits"]:
            self.log.merge(commits)

    def reindex(self, tokenizer: str | None = None) -> None:
        """The index anew, by the given analyser or the manifest's."""
        if tokenizer is not None:
            analyser(tokenizer)
        self.log.reindex(tokenizer or self.manifest()["tokenizer"])

    # Writing

    def write(self, sessions: DataFrame, events: DataFrame, sources: DataFrame | None = None, objects: DataFrame | None = None) -> None:
        """Replaces whole sessions; provenance of stored objects that vanished from the new sources is kept."""
        ids, whole = sessions.select("id"), sessions.withColumn("mode", F.lit("full"))

        def build(m: Manifest) -> tuple[dict[str, DataFrame], DataFrame]:
            """What is written, given what the version holds."""
            frames = {"sessions": whole, "events": events}
            if sources is not None:
                old = self.log.table("raw_sources", m).join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
                frames["raw_sources"] = K.sticky(old, sources.select([f.name for f in M.RAW_SOURCES.fields]))
            if objects is not None:
                frames["objects"] = objects.dropDuplicates(["hash"]).join(self.log.table("objects", m).select("hash"), "hash", "left_anti")
            return frames, ids

        self.log.commit(build)
        self.log.tidy()

    def ingest_session(self, parsed: Parsed, fingerprint: str = "") -> None:
        """One session that the caller has parsed."""
        c = Candidate("", "", "", fingerprint, None, 0, 0, 0)
        row = D.rows_of(parsed, c, int(time.time() * 1000)) | {"i": 0, "path": ""}
        self._store(self.spark.createDataFrame(D.pa.Table.from_pylist([row], D.to_arrow_schema(D.nullable(D.PARSED)))))

    def _store(self, parsed: DataFrame) -> None:
        """Replaces the sessions of parsed rows; of several sources of one session the last listed counts."""
        last = parsed.groupBy(F.col("session.id").alias("sid")).agg(F.max("i").alias("li"))
        rows = parsed.join(last, (F.col("session.id") == F.col("sid")) & (F.col("i") == F.col("li")), "left_semi")
        each = lambda name: rows.select(F.explode(name).alias("x")).select("x.*")
        self.write(rows.select("session.*"), each("events"), each("sources"), each("objects"))

    def ingest(self, agents: tuple[str, ...] = M.AGENTS, root: str | None = None, since_ms: int | None = None, exclude: tuple[str, ...] = (), dry_run: bool = False, strict: bool = False) -> IngestReport:
        """Discover, exclude, skip by time, skip unchanged, parse the rest and replace their sessions; bad sources are counted, others go on.

        The driver reads counts and the first FAILURES_TOLD failures; all else is done by tasks, a commit for each agent.
        """
        report, now = IngestReport(), int(time.time() * 1000)
        for g in exclude:
            glob(g)  # a bad pattern fails before anything is read
        scratch = Scratch(self.spark, "ingest")
        for agent in map(M.parse_agent, agents):
            base = root or native_root(agent)
            listed = D.walked(self.spark, agent, base, scratch, f"{agent}-walk")
            lost = listed.filter("category is not null")
            n = lost.count()
            report.discovered += n
            self._failures(lost.select(F.lit(0).alias("i"), F.lit("discovery").alias("stage"), "path", "message", "category"), report, n)
            # Numbered in order of path: of several sources of one session the last one counts.
            names = scratch.write(listed.filter("category is null").select(*D.NAMED).orderBy("path").withColumn("i", F.monotonically_increasing_id()), f"{agent}-names")
            n = names.count()
            if not n:
                continue
            self._take(agent, base, names, n, report, now, scratch, exclude, since_ms, dry_run)
        self._finish(report, dry_run, strict)
        return report

    def ingest_files(self, agent: str, root: str, paths: DataFrame) -> IngestReport:
        """The same for named files alone (``path``), as a stream of changes has them; files that are gone count as failures."""
        report, scratch = IngestReport(), Scratch(self.spark, "ingest")
        names = scratch.write(D.named(paths, agent).orderBy("path").withColumn("i", F.monotonically_increasing_id()), "names")
        if n := names.count():
            self._take(agent, root, names, n, report, int(time.time() * 1000), scratch, (), None, False)
        self._finish(report, False, False)
        return report

    def _take(self, agent: str, base: str, names: DataFrame, n: int, report: IngestReport, now: int, scratch: Scratch, exclude: tuple[str, ...], since_ms: int | None, dry_run: bool) -> None:
        """Examines listed files, parses what is new or has changed, and replaces its sessions."""
        seen = scratch.write(D.examined(self.spark, agent, names, n), f"{agent}-seen")
        judged = K.outcomes(D.linked(seen, agent), self.states(), exclude, since_ms)
        judged = scratch.write(judged.withColumn("outcome", F.when((F.col("outcome") != "excluded") & F.col("category").isNotNull(), "failed").otherwise(F.col("outcome"))), f"{agent}-judged")
        counts = {r["outcome"]: r["n"] for r in judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        report.discovered += sum(n for o, n in counts.items() if o != "excluded")
        report.skipped += counts.get("skipped_by_since", 0)
        report.skipped_by_since += counts.get("skipped_by_since", 0)
        report.unchanged += counts.get("unchanged", 0)
        self._failures(judged.filter("outcome = 'failed'"), report, counts.get("failed", 0))
        if not counts.get("pending"):
            return
        ask = judged.filter("outcome = 'pending'").repartition(max(1, -(-counts["pending"] // D.FILES_TO_A_TASK)))
        parsed = scratch.write(D.parsed(ask, agent, base, now, store=not dry_run), f"{agent}-parsed")
        good = parsed.filter("category is null and session is not null")
        size = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("events"), F.coalesce(F.sum("estimated"), F.lit(0)).alias("bytes")).first()
        empty = parsed.filter("category is null and session is null").count()
        report.parsed += size["n"] + (0 if dry_run else empty)
        report.skipped += empty
        report.estimated_bytes += size["bytes"]
        self._failures(parsed.filter("category is not null"), report, counts["pending"] - size["n"] - empty)
        if not dry_run and size["n"]:
            self._store(good)
            report.ingested += size["n"]
            report.events += size["events"]
        scratch.drop(f"{agent}-seen", f"{agent}-judged", f"{agent}-parsed")

    def _finish(self, report: IngestReport, dry_run: bool, strict: bool) -> None:
        if not dry_run:
            last = {k: getattr(report, k) for k in ("discovered", "parsed", "ingested", "unchanged", "skipped", "failed")}
            self.log.change(lambda m: m | {"telemetry": m["telemetry"] | {"last_ingest": last, "completed_at_ms": int(time.time() * 1000), "total_failures": m["telemetry"].get("total_failures", 0) + report.failed}})
        if strict and report.failed:
            raise ArchiveError(f"{report.failed} sources failed: {report.failures}")

    @staticmethod
    def _failures(rows: DataFrame, report: IngestReport, n: int) -> None:
        """Counts ``n`` failures and tells of the first."""
        known = report.failed
        for r in rows.select("i", "stage", "path", "message", "category").orderBy("i", "path").limit(max(0, FAILURES_TOLD - known)).collect() if n else ():
            report.add(r["stage"], r["path"], r["message"], r["category"])
        report.failed = known + n

    def states(self) -> DataFrame:
        """locator, fingerprint, mode of every archived source."""
        s = self.sessions.select(F.col("id").alias("session_id"), "fingerprint", "mode")
        return self.table("raw_sources").select("session_id", "locator").join(s, "session_id").select("locator", "fingerprint", "mode").dropDuplicates(["locator"])

    # Reading

    def search(self, query: str, limit: int = 20, agent: str | None = None, cwd: str | None = None, since_ms: int | None = None, as_of_ms: int | None = None, snippets: bool = True, skipping: bool = True) -> DataFrame:
        """Ranked sessions; ``skipping`` reads only the blocks of postings that may hold a candidate, else all of them are read, with the same result."""
        at = as_of_ms if as_of_ms is not None else int(time.time() * 1000)
        m = self.manifest()
        cut, size = analyser(m["tokenizer"]), m["index"]
        totals = (size["n_docs"], size["n_tokens"] / max(1, size["n_docs"]))
        posts = lambda: self.postings(plan_query(query, cut), m)
        with ThreadPoolExecutor(2) as beside:  # the tables are made while the candidates are found
            events, sessions = (beside.submit(self.log.table, t, m).result for t in ("events", "sessions"))
            return ranking.result(ranking.search(events, sessions, query, at, limit, agent, cwd, since_ms, snippets, posts, totals, cut, self.lists(m) if skipping else None, self._roots(m)))

    def _roots(self, m: Manifest) -> Callable[[DataFrame], DataFrame] | None:
        return (lambda ids: self.log.roots(m, ids=ids)) if keeps_roots(m["commits"]) and any("roots" in c["tables"] for c in m["commits"]) else None

    def roots(self) -> DataFrame:
        """id, root and depth of every session's lineage, as the commits keep them; walked where an archive from before doesn't (``compact`` makes it keep them)."""
        m = self.manifest()
        sessions = self.log.table("sessions", m)
        if not keeps_roots(m["commits"]):
            return lineage.paths(sessions).select("id", "root", "depth")
        return sessions.select("id").join(self.log.roots(m), "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))

    def list(self, limit: int = 50, cursor: str | None = None, **filters) -> tuple[list, str | None]:
        """A page of summaries, from the newest files that can hold it, and the cursor of the next."""
        n, m = max(1, min(limit, listing.MOST)), self.manifest()
        rows = listing.page(self._newest(n, cursor, filters, m), self.log.table("events", m), n, cursor, **filters).collect()  # at most 501 rows
        more = len(rows) > n
        return rows[:n], listing.encode_cursor(rows[n - 1]["sort_time"], rows[n - 1]["id"]) if more else None

    def _newest(self, n: int, cursor: str | None, filters: dict[str, Any], m: Manifest) -> DataFrame:
        """Sessions of as few files as hold a page: those of latest times, as many again and again until nothing in the others can come before the page's end."""
        known = listing.decode_cursor(cursor)[0] if cursor is not None else None
        files = self.log.surveys(m["commits"]).filter("table = 'sessions' AND rows > 0")
        files = files.filter(F.col("low_time") <= known) if known is not None else files
        k = LEAST_FILES
        while True:
            some = files.select("commit", "file", "high_time").orderBy(F.desc("high_time"), "commit", "file").limit(k + 1).collect()
            if len(some) <= k:
                return self._of_files("sessions", some, m)
            sessions = self._of_files("sessions", some[:k], m)
            page = listing.keys(sessions, n, cursor, **filters).collect()  # at most 501 rows
            if len(page) > n and page[-1]["sort_time"] > some[k]["high_time"]:
                return sessions
            k *= 4

    def _of_files(self, name: str, files: list, m: Manifest) -> DataFrame:
        held: dict[str, list[str]] = {}
        for r in files:
            held.setdefault(r["commit"], []).append(below(r["file"]))
        return self.log.table(name, m, pick=lambda c: held.get(c["name"], []))

    def show(self, session_id: str, from_idx: int | None = None, to_idx: int | None = None, kinds: tuple[str, ...] = ()):
        """(session row, sources, events) or None; only the files that may hold the session are opened."""
        m = self.manifest()
        held = self.log.files_with(("sessions", "events", "raw_sources"), [session_id], m)
        of = lambda t: self.log.table(t, m, pick=lambda c: held.get(t, {}).get(c["name"], []))
        events = listing.event_range(of("events"), session_id, from_idx, to_idx, kinds)
        session = of("sessions").filter(F.col("id") == session_id).first()
        if session is None:
            return None
        return session, of("raw_sources").filter(F.col("session_id") == session_id).orderBy("locator").collect(), events.collect()

    def stats(self) -> DataFrame:
        return listing.stats(self.sessions, self.events).orderBy("agent")

    # Maintenance

    def gc(self, dry_run: bool = True) -> dict[str, int]:
        if not dry_run:
            raise ArchiveError("only a dry run is supported: objects are kept")
        objects, refs = self.table("objects"), self.table("raw_sources").filter("object_hash is not null")
        lost = K.orphans(objects, refs).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("b")).first()
        return {"total": objects.count(), "referenced": refs.select("object_hash").distinct().count(), "orphans": lost["n"], "orphan_bytes": lost["b"]}

    def backup(self, target: str) -> dict[str, int]:
        """A verified copy of the current snapshot at a place that doesn't exist yet."""
        if Store(self.spark, target).exists():
            raise ArchiveError(f"{target} exists")
        copy = Archive.__new__(Archive)
        copy.spark, copy.path = self.spark, f"{target}.staged-{uuid.uuid4().hex}"
        copy.log = Log(self.spark, copy.path)
        copy.store = copy.log.store
        self.log.copy(copy.log)
        if bad := [r for r in copy.verify().collect() if not r["passed"]]:
            copy.store.delete()
            raise ArchiveError(f"backup failed its check: {bad}")
        copy.store.rename(target)
        copy.log.path = copy.path = target
        return {t: copy.log.table(t).count() for t in ("sessions", "events", "objects")}

    def import_archive(self, path: str) -> dict[str, int]:
        """Merges another archive: its new sessions, sources and objects come in; rows that differ under one key are an error."""
        if os.path.realpath(path) == os.path.realpath(self.path):
            raise ArchiveError("an archive can't be imported into itself")
        other = Archive(self.spark, path, create=False)
        if bad := [r for r in other.verify().collect() if not r["passed"]]:
            raise ArchiveError(f"source archive fails its check: {bad}")
        out: dict[str, int] = {}
        self.log.commit(lambda m: self._imported(other, m, out))
        self.log.tidy()
        return out

    def _imported(self, other: Archive, m: Manifest, out: dict[str, int]) -> tuple[dict[str, DataFrame], DataFrame | None]:
        """What an import adds to a version, with its counts in ``out``; rows that differ under one key are an error."""
        mine, frames = {t: self.log.table(t, m) for t in M.TABLES}, {}
        loose = {"sessions": ["ingested_at_ms", "mode"], "events": [], "raw_sources": ["object_hash"], "objects": ["created_at_ms", "payload"]}
        for t, keys in M.KEYS.items():
            theirs = other.table(t)
            compared = [c for c in mine[t].columns if c not in keys and c not in loose[t] and c != "usage"]
            if not K.conflicts(theirs, mine[t], list(keys), compared).isEmpty():
                raise ArchiveError(f"{t} of the two archives differ")
            frames[t] = K.missing(theirs, mine[t].select(*keys), list(keys))
            total, n = theirs.count(), frames[t].count()
            out |= {f"{t}_imported": n, f"{t}_skipped": max(0, total - n)}
        # A session that is whole there becomes whole here, and a source without its object takes theirs.
        theirs = other.sessions.filter("mode = 'full'").select("id")
        partial = mine["sessions"].filter("mode = 'partial'").join(theirs, "id", "left_semi")
        stored = other.table("raw_sources").filter("object_hash is not null").select("session_id", "locator", F.col("object_hash").alias("theirs"))
        bare = mine["raw_sources"].filter("object_hash is null").join(stored, ["session_id", "locator"], "left_semi")
        touched = partial.select("id").unionByName(bare.select(F.col("session_id").alias("id"))).distinct()
        out["sessions_promoted"] = partial.count()
        if not out["sessions_promoted"] and bare.isEmpty():
            return {t: f for t, f in frames.items() if out[f"{t}_imported"]}, None
        ids = touched.withColumnRenamed("id", "session_id")
        full = partial.select("id", F.lit(True).alias("whole"))
        sessions = mine["sessions"].join(touched, "id", "left_semi").join(full, "id", "left").withColumn("mode", F.when(F.col("whole"), F.lit("full")).otherwise(F.col("mode"))).drop("whole")
        sources = mine["raw_sources"].join(ids, "session_id", "left_semi").join(stored, ["session_id", "locator"], "left")
        sources = sources.withColumn("object_hash", F.coalesce("object_hash", "theirs")).drop("theirs")
        both = lambda a, b: a.unionByName(b.select(a.columns))
        events = both(mine["events"].join(ids, "session_id", "left_semi"), frames["events"])
        return {"sessions": both(sessions, frames["sessions"]), "raw_sources": both(sources, frames["raw_sources"]), "events": events, "objects": frames["objects"]}, touched

    def verify(self) -> DataFrame:
        from .verify import checks

        return checks(self)

    def restore(self, session_id: str, target: str, overwrite: bool = False, manifest: str | None = None) -> dict[str, Any]:
        from .restore import restore

        return restore(self, session_id, target, overwrite, manifest)

