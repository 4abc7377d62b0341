"""The six integrity checks of an archive, as one report of (name, checked, passed, n_failures, failures, failed).

Every check counts its failures and shows the first ``SHOWN`` of them; ``failed`` is the path of a table of all of them, where there are any.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from . import schema as M
from .commits import root_of
from .functions.analysers import analyser
from .operators import fulltext, tables as K
from .scratch import shared_dir

_REPORT = "name string, checked long, passed boolean, n_failures long, failures array<string>, failed string"
SHOWN = 100


@F.pandas_udf(BooleanType())
def _sound(codec: pd.Series, size: pd.Series, payload: pd.Series, digest: pd.Series) -> pd.Series:
    def one(c, n, p, h):
        try:
            raw = zstandard.ZstdDecompressor().decompress(p, max_output_size=max(int(n), 1)) if c == "zstd" else None
        except zstandard.ZstdError:
            return False
        return raw is not None and len(raw) == n and hashlib.sha256(raw).hexdigest() == h

    return pd.Series([one(*x) for x in zip(codec, size, payload, digest, strict=True)], dtype=bool)


def damaged(archive, m) -> tuple[int, DataFrame]:
    """How many files there are, and what is wrong with which: every file's rows and digest are computed again and held against its survey, the survey against the manifest's root."""
    log, out = archive.log, archive.spark.createDataFrame([], "failure string")
    for c in m["commits"]:
        try:
            known = log.surveys([c]).drop("commit")
            roots = {r["table"]: r["root"] for r in known.groupBy("table").agg(root_of().alias("root")).collect()}
        except Exception as e:  # noqa: BLE001  a survey that can't be read is the finding
            out = out.unionByName(archive.spark.createDataFrame([(f"survey of {c['name']}: {str(e)[:200]}",)], "failure string"))
            continue
        if wrong := [t for t, root in c["roots"].items() if t in c["tables"] and roots.get(t) != root]:
            out = out.unionByName(archive.spark.createDataFrame([(f"survey of {c['name']}: {t} differs from its root",) for t in wrong], "failure string"))
        if not c["tables"]:
            continue
        known = known.filter(F.col("table").isin(*c["tables"])).select("table", "file", F.col("rows").alias("n"), F.col("digest").alias("d"))
        both = known.join(log.surveyed(c).select("table", "file", "rows", "digest"), ["table", "file"], "full_outer")
        bad = both.filter("d IS NULL OR NOT (n <=> rows AND d <=> digest)")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("no"))
        out = out.unionByName(bad.select(F.concat(F.col("file"), F.lit(": "), text("rows"), F.lit(" rows of "), text("n"), F.lit(", digest "), text("digest"), F.lit(" for "), text("d")).alias("failure")))
    return sum(n for c in m["commits"] for t, n in c["files"].items() if t in c["tables"]), out


def checks(archive) -> DataFrame:
    spark, rows = archive.spark, []
    folder = f"{shared_dir(spark)}/verify-{uuid.uuid4().hex}"

    def add(name: str, checked: int, bad: DataFrame | list[str]) -> None:
        """A check's row; all failures are written, where there are any."""
        if isinstance(bad, list):
            bad = spark.createDataFrame([(b,) for b in bad], "failure string") if bad else None
        n, shown = 0, []
        if bad is not None and (shown := [r[0] for r in bad.select(F.col(bad.columns[0]).cast("string")).limit(SHOWN).collect()]):
            bad.select(F.col(bad.columns[0]).cast("string").alias("failure")).write.parquet(f"{folder}/{name}")
            n = spark.read.parquet(f"{folder}/{name}").count()
        rows.append((name, checked, not n, n, shown, f"{folder}/{name}" if n else None))

    m = archive.manifest()
    n, bad = damaged(archive, m)
    add("storage", n, bad)
    if not rows[0][2]:
        return spark.createDataFrame(rows, _REPORT)
    s, e, r, o = (archive.table(t) for t in ("sessions", "events", "raw_sources", "objects"))
    ids = s.select(F.col("id").alias("session_id"))
    stray = e.select("session_id").unionByName(r.select("session_id")).join(ids, "session_id", "left_anti").distinct()
    add("foreign_keys", e.count() + r.count(), stray)
    wrong = [f"{k}: {m.get(k)!r}" for k, v in (("schema_version", M.SCHEMA_VERSION), ("contract", M.CONTRACT)) if m.get(k) != v]
    partial = s.filter("mode = 'partial'").count()
    add("contract", 3, wrong + ([f"{partial} partial sessions"] if partial else []))
    docs, posts = archive.table("docs"), archive.postings()
    size, stored = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first(), m["index"]
    wrong = [] if tuple(size) == (stored["n_docs"], stored["n_tokens"]) else [f"totals {stored} of {tuple(size)}"]
    listed = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).first()["n"]
    if analyser(m["tokenizer"]).plain and listed != size["t"]:  # other analysers list some places twice
        wrong.append(f"{listed} tokens listed of {size['t']}")
    if analyser(m["tokenizer"]).plain:
        counted = posts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(archive.table("terms").filter("NOT pair").groupBy("term").agg(F.sum("df").alias("df")), "term", "full_outer")
        odd = counted.filter("coalesce(n, 0) != coalesce(df, 0)").count()
        wrong += [f"{odd} terms with another frequency than stored"] if odd else []
    keys = ["session_id", "idx"]
    want = fulltext.searchable(e).select(keys)
    at = lambda rows: rows.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    add("index", size["n"], at(want.join(docs, keys, "left_anti").unionByName(docs.select(keys).join(want, keys, "left_anti"))) if not wrong else wrong)
    add("object_references", r.count(), K.dangling(r, o).select("object_hash"))
    add("objects", o.count(), o.filter(~_sound("compression", "bytes", "payload", "hash")).select("hash"))
    return spark.createDataFrame(rows, _REPORT)
