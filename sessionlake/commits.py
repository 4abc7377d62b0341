"""The log of an archive: commits of immutable files under a versioned manifest, safe beside other writers.

* A commit's files lie in ``data/<table>/commit=<name>``, so any number of commits is one scan with the commit as a partition column. The manifest gives each commit a sequence
  number, the version it was published as. A commit that replaces sessions lists their ids; a row is dead if a later commit lists its session: one anti-join against one scan of
  the lists, whatever the number of commits.
* A commit is built on the version it read. Publishing looks at the commits that came in between: if one of them touches a session or an object of this one, or the analyser has changed, the
  commit is built again on what is there now (tables and lists that do not depend on the version stay), else it goes behind them. Totals are sums over commits (texts added less texts replaced), so no total is carried from an old version.
* ``tidy`` merges the newest commits once ``FANOUT`` of them are of one size class, so that their number grows with the logarithm of the archive, and each row is rewritten as often. A
  merge keeps the commits' place in the sequence and can be published beside newer commits.
* Every commit surveys its files (:mod:`surveys`): rows, a digest of all bytes, the least and greatest key and sort time, and Bloom filters of session ids, in a table of their own.
  Listing and showing open the files that the survey leaves; the storage check computes it again. A root over the survey is in the manifest.
* Every commit keeps the roots of lineage that it changes (:func:`lineage.updated`); of a session's rows the newest commit's counts. A commit conflicts with one
  that writes a session which its roots name.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import schema as M, surveys
from .functions.analysers import Analyser, analyser
from .operators import fulltext, lineage
from .operators.listing import sort_time
from .storage import Exists, Store

ATTEMPTS = 5
FANOUT = 8
PUBLISH_SECONDS = 5.0
FEW_SESSIONS = 1000

Manifest = dict[str, Any]
Commit = dict[str, Any]


class ArchiveError(ValueError):
    pass


class Conflict(Exception):
    """Another writer's commit touches what this one was built on."""


POST = M._struct(("session_id", M._S, False), ("idx", M._L, False), ("dl", M._L, False), ("tf", M._I, False))
DOCS = M._struct(("session_id", M._S, False), ("idx", M._L, False), ("dl", M._L, False))
BLOCKS = M._struct(
    ("term", M._S, False), ("block", M._L, False), ("n", M._L, False), ("max_tf", M._I, False), ("min_dl", M._L, False), ("low", M._struct(("session_id", M._S, False), ("idx", M._L, False)), False),
    ("posts", T.ArrayType(POST), False), ("positions", T.ArrayType(T.ArrayType(M._I)), True), ("bucket", M._I, False),
)
TERMS = M._struct(("term", M._S, False), ("pair", M._B, False), ("df", M._L, False))
REPLACED = M._struct(("id", M._S, False))
ROOTS = M._struct(("id", M._S, False), ("step", M._S, True), ("root", M._S, False), ("tree", M._S, False), ("depth", M._L, False), ("cyclic", M._B, False))  # lineage.ROOTS
STORED = M.TABLES | {"docs": DOCS, "postings": BLOCKS, "pairs": BLOCKS, "terms": TERMS, "replaced": REPLACED, "roots": ROOTS}
INDEX = ("docs", "postings", "pairs", "terms")
#: Which column names the session of a table's rows; the others' rows never die.
SURVEYED = {"sessions": "id", "events": "session_id", "raw_sources": "session_id"}
SESSION = {"sessions": "id", "events": "session_id", "raw_sources": "session_id", "docs": "session_id"}


def nullable(s: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in s.fields])


class Log:
    """Commits of one archive folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)

    # Manifest

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names("manifest") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        m = json.loads(self.store.read(f"manifest/{version:012d}.json"))
        sums = {k: sum(c["totals"][k] - c["dead"][k] for c in m["commits"]) for k in ("n_docs", "n_tokens")}
        return m | {"version": version, "index": sums}

    def publish(self, m: Manifest, version: int) -> None:
        """Creates manifest ``version``; fails if another writer did."""
        try:
            self.store.create(f"manifest/{version:012d}.json", json.dumps({k: v for k, v in m.items() if k not in ("version", "index")}, sort_keys=True))
        except Exists:
            raise ArchiveError(f"version {version} is taken: another writer came first") from None

    def change(self, step: Callable[[Manifest], Manifest]) -> None:
        """Publishes ``step`` of the newest manifest; again, on what is there then, while other writers come first. ``step`` may raise Conflict."""
        until = time.monotonic() + PUBLISH_SECONDS
        while True:
            m = self.manifest()
            try:
                return self.publish(step(m), m["version"] + 1)
            except ArchiveError:
                if time.monotonic() > until:
                    raise

    # Reading

    def scan(self, name: str, commits: list[Commit], pick: Callable[[Commit], list[str]] | None = None) -> DataFrame:
        """The rows of a table in the given commits, dead ones too, with ``commit``; ``pick`` names the folders or files below a commit's own."""
        base, schema = f"{self.path}/data/{name}", nullable(STORED[name])
        paths = [f"{base}/commit={c['name']}{p and '/'}{p}" for c in commits for p in (pick(c) if pick else [""])]
        schema = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def live(self, rows: DataFrame, key: str, commits: list[Commit], every: list[Commit] | None = None) -> DataFrame:
        """Rows with ``commit`` that no later commit replaces; ``every``: the commits whose lists count."""
        every = commits if every is None else every
        first = min((c["seq"] for c in commits), default=0)
        lists = [c for c in every if "replaced" in c["tables"] and c["seq"] > first]
        if not lists:
            return rows
        ids = self.scan("replaced", lists)
        dead = ids.groupBy(F.col("id").alias("__dead")).agg(F.max(_seq(lists)).alias("__until"))
        return rows.join(dead, (rows[key] == dead["__dead"]) & (_seq(commits) < dead["__until"]), "left_anti")

    def table(self, name: str, m: Manifest | None = None, commits: list[Commit] | None = None, pick: Callable[[Commit], list[str]] | None = None) -> DataFrame:
        """The live rows of a table: one scan of its files and one of the lists of replaced sessions."""
        every = (m or self.manifest())["commits"] if commits is None else commits
        holding = [c for c in every if name in c["tables"]]
        rows = self.scan(name, holding, pick)
        if name in SESSION and holding:
            rows = self.live(rows, SESSION[name], holding, every)
        return rows.drop("commit")

    def roots(self, m: Manifest, commits: list[Commit] | None = None, ids: DataFrame | None = None, bare: bool = False) -> DataFrame:
        """The kept roots, a row for each session with a step (``bare``: also for those that have lost theirs): the newest commit's. ``ids`` are few."""
        holding = [c for c in (m["commits"] if commits is None else commits) if "roots" in c["tables"]]
        rows = self.scan("roots", holding)
        if holding:
            rows = rows if ids is None else rows.join(ids, "id", "left_semi")
            rows = rows.groupBy("id").agg(F.max_by(F.struct(*[f.name for f in ROOTS.fields[1:]]), _seq(holding)).alias("r")).select("id", "r.*")
        return (rows if bare else rows.filter("step is not null")).select(*ROOTS.names)

    # Writing

    def commit(self, build: Callable[[Manifest], tuple[dict[str, DataFrame], DataFrame | None]], telemetry: dict[str, Any] | None = None) -> None:
        """Adds the frames that ``build`` makes of a version; rows of the replaced ids in earlier commits die. Built again where another writer's commit is in the way."""
        why = last = None
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                frames, replaced = build(base)
                entry = self._written(frames, replaced, base, last)
            except BaseException:
                if last:
                    self._discard(last[0])
                raise
            try:
                self.change(lambda m, base=base, entry=entry: self._behind(m, base, entry, telemetry))
                return
            except Conflict as e:
                why, last = e, (entry, frames | {"replaced": replaced})
        self._discard(last[0])
        raise ArchiveError(f"no commit in {ATTEMPTS} attempts: {why}")

    def _behind(self, m: Manifest, base: Manifest, entry: Commit, telemetry: dict[str, Any] | None) -> Manifest:
        later = [c for c in m["commits"] if c["seq"] > base["version"]]
        if m["tokenizer"] != entry["tokenizer"]:
            raise Conflict(f"the analyser is {m['tokenizer']} now")
        if later and (found := self._shared(entry, later)):
            raise Conflict(found)
        return m | {"commits": [*m["commits"], entry | {"seq": m["version"] + 1}], "telemetry": m["telemetry"] | (telemetry or {})}

    def _keys(self, commits: list[Commit]) -> DataFrame:
        """kind, key: the sessions and objects that commits touch."""
        out = self.spark.createDataFrame([], "kind string, key string")
        for name, key in [*SESSION.items(), ("replaced", "id"), ("objects", "hash")]:
            if holding := [c for c in commits if name in c["tables"] and name != "docs"]:
                out = out.unionByName(self.scan(name, holding).select(F.lit("object" if name == "objects" else "session").alias("kind"), F.col(key).alias("key")))
        for key in ("id", "step"):
            if holding := [c for c in commits if "roots" in c["tables"]]:
                out = out.unionByName(self.scan("roots", holding).filter(F.col(key).isNotNull()).select(F.lit("session").alias("kind"), F.col(key).alias("key")))
        return out

    def _shared(self, entry: Commit, later: list[Commit]) -> str | None:
        both = self._keys([entry]).distinct().join(self._keys(later).distinct(), ["kind", "key"], "left_semi").first()
        return f"{both['kind']} {both['key']} was written by another commit" if both else None

    def _discard(self, entry: Commit) -> None:
        for name in (*entry["tables"], "survey"):
            self.store.delete(f"data/{name}/commit={entry['name']}")

    def _again(self, entry: Commit, last: tuple[Commit, dict[str, DataFrame | None]], frames: dict[str, DataFrame | None]) -> None:
        """Takes over from an attempt that was not published what does not depend on the version it was built on: the tables that are the same frames, and the lists of the same events by the same analyser."""
        old, before = last
        same = {t for t, df in frames.items() if df is not None and before.get(t) is df and t in old["tables"]}
        if "events" in same and old["tokenizer"] == entry["tokenizer"]:
            same |= {t for t in INDEX if t != "terms" and t in old["tables"]}
            entry |= {k: old[k] for k in ("totals", "buckets", "held")}
        self._discard(old | {"tables": [t for t in old["tables"] if t not in same]})
        entry |= {"name": old["name"], "tables": sorted(same)}

    def _written(self, frames: dict[str, DataFrame], replaced: DataFrame | None, base: Manifest, last: tuple[Commit, dict[str, DataFrame | None]] | None = None) -> Commit:
        """Writes a commit's files: tables side by side, then the index of its events, then the survey; ``last``: the attempt before, with its frames."""
        entry = self._entry(base["tokenizer"])
        if last:
            self._again(entry, last, frames | {"replaced": replaced})
        rows = {}
        for t, df in frames.items():
            if t in entry["tables"]:
                continue
            columns = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in M.TABLES[t].fields]
            rows[t] = df.select(columns)
            if t == "events":
                rows[t] = rows[t].sortWithinPartitions("session_id", "idx")  # footers then bound each file's sessions
        if replaced is not None and "replaced" not in entry["tables"]:
            rows["replaced"] = replaced.select("id").distinct()
        with ThreadPoolExecutor(len(rows) or 1) as side_by_side:
            list(side_by_side.map(lambda item: self._put(entry, *item), rows.items()))
        entry["lineage"] = self._keep(entry, base)
        gone = None
        if replaced is not None and base["commits"]:
            ids = self.scan("replaced", [entry]).select(F.col("id").alias("session_id"))
            gone = self.events_of(ids, base)
            old = self.table("docs", base).join(ids, "session_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
            entry["dead"] = {"n_docs": old["n"], "n_tokens": old["t"]}
            gone = gone if old["n"] else None
        if "events" in frames:
            self.index(self.scan("events", [entry]).drop("commit"), entry, gone)
        elif gone is not None:
            self.index(self.spark.createDataFrame([], nullable(M.EVENTS)), entry, gone)
        self.survey(entry)
        return entry

    def _keep(self, entry: Commit, base: Manifest) -> bool:
        """Writes the roots that a commit changes; False where those of the version it is built on are not kept."""
        if not keeps_roots(base["commits"]):
            return False
        new = self.scan("sessions", [entry] if "sessions" in entry["tables"] else []).select("id", lineage.wanted().alias("step"))
        if not any("roots" in c["tables"] for c in base["commits"]) and new.filter("step is not null").isEmpty():
            return True
        gone = self.scan("replaced", [entry] if "replaced" in entry["tables"] else []).select("id")
        rows = lineage.updated(self.roots(base), self.table("sessions", base).select("id"), new, gone)
        if rows is not None:
            self._put(entry, "roots", rows.select(*ROOTS.names))
        return True

    def events_of(self, ids: DataFrame, m: Manifest) -> DataFrame:
        """Live events of the given sessions; of few sessions, from the files that the survey leaves."""
        few = [r["session_id"] for r in ids.limit(FEW_SESSIONS + 1).collect()]
        pick = None
        if len(few) <= FEW_SESSIONS:
            found = self.files_with(("events",), few, m).get("events", {})
            pick = lambda c: found.get(c["name"], [])
        return self.table("events", m, pick=pick).join(ids, "session_id", "left_semi")

    def _entry(self, tokenizer: str) -> Commit:
        none = {"n_docs": 0, "n_tokens": 0}
        return {"name": uuid.uuid4().hex, "seq": 0, "at_ms": int(time.time() * 1000), "tables": [], "tokenizer": tokenizer, "totals": none, "dead": none, "rows": {}, "buckets": 0, "held": {}, "lineage": False}

    def _put(self, entry: Commit, name: str, df: DataFrame) -> None:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy("bucket") if name in ("postings", "pairs") else writer).parquet(f"{self.path}/data/{name}/commit={entry['name']}")
        entry["tables"].append(name)

    def index(self, events: DataFrame, entry: Commit, gone: DataFrame | None = None) -> None:
        """Writes the events' lengths, postings, pairs and frequencies as files of ``entry``; ``gone``: live events that it replaces, whose frequencies it takes off."""
        cut = analyser(entry["tokenizer"])
        if "docs" not in entry["tables"]:
            self._lists(events, entry, cut)
        if cut.plain:
            lists = [(t, pair) for t, pair in (("postings", False), ("pairs", True)) if t in entry["tables"]]
            each = [self.scan(t, [entry]).select("term", F.lit(pair).alias("pair"), F.col("n").alias("df")) for t, pair in lists]
            if gone is not None:
                each.append(fulltext.occurrences(fulltext.index(gone, analyser=cut), -1))
            self._put(entry, "terms", fulltext.frequencies(reduce(DataFrame.unionByName, each, self.spark.createDataFrame([], nullable(TERMS)))))

    def _lists(self, events: DataFrame, entry: Commit, cut: Analyser) -> None:
        """Writes the events' lengths, postings and pairs."""
        folder = f"{self.path}/data/tokens/commit={entry['name']}"
        tokens = fulltext.numbered(events, cut)
        tokens.write.option("compression", "zstd").parquet(folder)
        tokens = self.spark.read.schema(tokens.schema).parquet(folder)
        size = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        entry["totals"] = {"n_docs": size["n"], "n_tokens": size["t"]}
        entry["buckets"] = n = fulltext.layout(size["t"])[0]
        parts = {"docs": tokens.select("session_id", "idx", "dl")}
        if size["t"]:
            parts["postings"] = fulltext.blocks(tokens, fulltext.shares(tokens, n))
            if cut.plain:
                two = fulltext.pairs(tokens)
                parts["pairs"] = fulltext.blocks(two, fulltext.shares(two, n), places=False)
        with ThreadPoolExecutor(len(parts)) as side_by_side:
            list(side_by_side.map(lambda item: self._put(entry, *item), parts.items()))
        for t in ("postings", "pairs"):
            if t in parts:
                entry["held"][t] = sorted(int(n.split("=")[1]) for n in self.store.names(f"data/{t}/commit={entry['name']}") if n.startswith("bucket="))
        self.store.delete(f"data/tokens/commit={entry['name']}")

    # Surveys

    def surveyed(self, entry: Commit) -> DataFrame:
        """What the survey of a commit's files is: a row for each file."""
        files = [(t, f) for t in sorted(entry["tables"]) for f in self.store.files(f"data/{t}/commit={entry['name']}")]
        return surveys.survey(self.spark, self.uri, [(t, f.removeprefix("data/")) for t, f in files], SURVEYED, ("sessions",))

    def survey(self, entry: Commit) -> None:
        folder = f"{self.path}/data/survey/commit={entry['name']}"
        self.surveyed(entry).coalesce(1).write.parquet(folder)  # a row for each file
        rows = self.spark.read.schema(surveys.SURVEY).parquet(folder)
        sums = rows.groupBy("table").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("files"), root_of().alias("root")).collect()  # a row for each table
        entry["tables"] = sorted(entry["tables"])
        entry["rows"] = {r["table"]: r["n"] for r in sums}
        entry["files"] = {r["table"]: r["files"] for r in sums}
        entry["roots"] = {r["table"]: r["root"] for r in sums}

    def surveys(self, commits: list[Commit]) -> DataFrame:
        base, schema = f"{self.path}/data/survey", f"{surveys.SURVEY}, commit string"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/commit={c['name']}" for c in commits])

    def files_with(self, names: tuple[str, ...], sessions: list[str], m: Manifest) -> dict[str, dict[str, list[str]]]:
        """table -> commit -> the files that may hold rows of any of a few sessions."""
        out: dict[str, dict[str, list[str]]] = {}
        for r in surveys.holding(self.surveys(m["commits"]).filter(F.col("table").isin(*names)), sessions).toLocalIterator():
            out.setdefault(r["table"], {}).setdefault(r["commit"], []).append(below(r["file"]))
        return out

    # Merging

    def tidy(self) -> None:
        """Merges the newest commits where ``FANOUT`` of them are of one size class, until none are."""
        while run := tail(self.manifest()["commits"]):
            if not self.merge(run):
                return

    def copy(self, into: Log) -> None:
        """The version there is now, with its files, under another log; files are copied by tasks."""
        m = self.manifest()
        if m["commits"]:
            known = self.surveys(m["commits"])
            held = [(t, c["name"]) for c in m["commits"] for t in c["tables"]]
            there = F.concat_ws("/", "table", "commit")
            known = known.filter(there.isin(*[f"{t}/{c}" for t, c in held])).select("file")  # not what a later index has replaced
            own = [f.removeprefix("data/") for c in m["commits"] for f in self.store.files(f"data/survey/commit={c['name']}")]
            files = known.unionByName(self.spark.createDataFrame([(f,) for f in own], "file string"))
            surveys.copy(files, self.uri, into.uri)
        into.publish(m, 0)

    @property
    def uri(self) -> str:
        """Where the data lie, as tasks open it."""
        base = f"{self.path}/data"
        return base if "://" in base else f"file://{os.path.abspath(base)}"

    def merge(self, run: list[Commit]) -> bool:
        """One commit in place of neighbours: their live rows in order. False if another writer has merged one of them."""
        base = self.manifest()
        entry = self._entry(base["tokenizer"])
        if any(map(indexes_others, run)) and len(run) < len(base["commits"]):
            raise ValueError("a commit that indexes others is merged with all of them or with none")
        whole = run[0]["name"] == base["commits"][0]["name"]
        rows = {t: self.table(t, commits=run) for t in M.TABLES if any(t in c["tables"] for c in run)}
        if "events" in rows:
            rows["events"] = rows["events"].repartitionByRange("session_id").sortWithinPartitions("session_id", "idx")
        if "sessions" in rows:
            rows["sessions"] = rows["sessions"].repartitionByRange(sort_time()).sortWithinPartitions(sort_time())
        if not whole and any("replaced" in c["tables"] for c in run):
            rows["replaced"] = self.table("replaced", commits=run).distinct()
        kept = keeps_roots(run)
        if kept and any("roots" in c["tables"] for c in run):
            rows["roots"] = self.roots(base, run, bare=not whole)
        with ThreadPoolExecutor(len(rows) or 1) as side_by_side:
            list(side_by_side.map(lambda item: self._put(entry, *item), rows.items()))
        entry["lineage"] = kept or (whole and self._keep(entry, base | {"commits": []}))  # all sessions anew, for an archive from before roots were kept
        if "events" in rows:
            self.index(self.scan("events", [entry]).drop("commit"), entry)
        if not whole and "terms" in entry["tables"]:  # what the run took off older commits stays off
            self._off(run, entry)
        self.survey(entry)
        sums = {k: sum(c["totals"][k] - c["dead"][k] for c in run) for k in ("n_docs", "n_tokens")}
        entry["dead"] = {k: entry["totals"][k] - sums[k] for k in sums}
        names = [c["name"] for c in run]

        def swapped(m: Manifest) -> Manifest:
            there = [c["name"] for c in m["commits"]]
            at = there.index(names[0]) if names[0] in there else -1
            if at < 0 or there[at : at + len(names)] != names or m["tokenizer"] != entry["tokenizer"]:
                raise Conflict("merged by another writer")
            return m | {"commits": [*m["commits"][:at], entry | {"seq": run[-1]["seq"]}, *m["commits"][at + len(names) :]]}

        try:
            self.change(swapped)
            return True
        except Conflict:
            self._discard(entry)
            return False

    def _off(self, run: list[Commit], entry: Commit) -> None:
        """Frequencies of a merged commit: the run's sums, which count what the run replaced in older commits."""
        sums = fulltext.frequencies(self.table("terms", commits=run))
        self.store.delete(f"data/terms/commit={entry['name']}")
        entry["tables"].remove("terms")
        self._put(entry, "terms", sums)

    def reindex(self, tokenizer: str) -> None:
        """The index of all live events, anew by an analyser, in place of all commits' own."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if not base["commits"]:
                return self.change(lambda m: m | {"tokenizer": tokenizer})
            entry = self._entry(tokenizer)
            self.index(self.table("events", base), entry)
            self.survey(entry)

            def swapped(m: Manifest, base=base, entry=entry) -> Manifest:
                known, later = [c for c in m["commits"] if c["seq"] <= base["version"]], [c for c in m["commits"] if c["seq"] > base["version"]]
                if later and m["tokenizer"] != tokenizer:
                    raise Conflict("commits by another analyser came in between")
                none = {"n_docs": 0, "n_tokens": 0}
                bare = [c | {"tables": [t for t in c["tables"] if t not in INDEX], "totals": none, "dead": none, "held": {}} for c in known]
                return m | {"commits": [*[c for c in bare if c["tables"]], entry | {"seq": base["version"]}, *later], "tokenizer": tokenizer}

            try:
                return self.change(swapped)
            except Conflict:
                self._discard(entry)
        raise ArchiveError(f"no index in {ATTEMPTS} attempts: other writers came first")


def root_of() -> Column:
    """One number over a survey's rows, in any order."""
    return F.sum(F.xxhash64("table", "file", "rows", "digest", "low", "high", "low_time", "high_time", "bits").cast("decimal(38,0)")).cast("string")


def keeps_roots(commits: list[Commit]) -> bool:
    """Whether every commit that changes sessions has kept the roots it changes."""
    return all(c.get("lineage", False) for c in commits if {"sessions", "replaced"} & set(c["tables"]))


def below(file: str) -> str:
    """A surveyed file's name below its commit's folder."""
    return file.split("/", 2)[2]


def _seq(commits: list[Commit]) -> Column:
    """A row's sequence number, by the name of its commit."""
    pairs = [x for c in commits for x in (F.lit(c["name"]), F.lit(int(c["seq"])))]
    return F.element_at(F.create_map(*pairs), F.col("commit"))


def weight(c: Commit) -> int:
    return sum(c["rows"].get(t, 0) for t in M.TABLES) + c["rows"].get("replaced", 0)


def size_class(c: Commit) -> int:
    """The power of FANOUT that a commit's rows come to."""
    n, out = weight(c), 0
    while n >= FANOUT:
        n, out = n // FANOUT, out + 1
    return out


def indexes_others(c: Commit) -> bool:
    tables = c.get("tables", ())
    return "docs" in tables and "events" not in tables


def tail(commits: list[Commit]) -> list[Commit]:
    """The newest commits that are to be merged: those of smaller classes before the newest, so that classes fall from old to new; else the tail
    of at most one class, for the least class that has FANOUT of them. So no more than FANOUT - 1 of a class stay.

    A commit that indexes the events of those before it (a reindex) is not merged with some of them: the tail begins behind it, until ``compact`` takes all."""
    barrier = max((i for i, c in enumerate(commits) if indexes_others(c)), default=-1)
    commits = commits[barrier + 1 :]
    smaller = 0
    while smaller + 1 < len(commits) and size_class(commits[-2 - smaller]) < size_class(commits[-1]):
        smaller += 1
    if smaller:
        return commits[-1 - smaller :]
    for most in sorted({size_class(c) for c in commits}):
        run: list[Commit] = []
        for c in reversed(commits):
            if size_class(c) > most:
                break
            run.append(c)
        if len(run) >= FANOUT and sum(size_class(c) == most for c in run) >= FANOUT:
            return run[::-1]
    return []
