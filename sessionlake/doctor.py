"""Whether everything that an archive needs is in order: the archive, its sources, permissions, the watch, the analyser, a backup."""

from __future__ import annotations

import os
import platform
import stat
import sys
import time
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import functions as F

from .functions.analysers import analyser
from .schema import AGENTS
from .scratch import Scratch
from .sources import distributed as D
from .sources.connectors import native_root


FAILURES_TOLD = 1000


def agents(spark, names: tuple[str, ...], roots: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """Per agent: its root, whether it can be read, how many candidates it has, the newest one's time, and what fails there."""
    out = []
    for agent in names:
        root = (roots or {}).get(agent) or native_root(agent)
        there, n, latest, failures = os.path.isdir(root), 0, None, []
        if there:
            scratch = Scratch(spark, "doctor")
            listed = D.walked(spark, agent, root, scratch, agent)
            names = scratch.write(listed.filter("category is null").select(*D.NAMED, F.monotonically_increasing_id().alias("i")), f"{agent}-names")
            seen = scratch.write(D.examined(spark, agent, names, names.count()).select("path", "category", "message", "updated_at_ms"), f"{agent}-seen")
            one = seen.agg(F.count_if(F.col("category").isNull()).alias("n"), F.max("updated_at_ms").alias("latest")).first()
            n, latest = one["n"], one["latest"]
            bad = listed.select("path", "category", "message").unionByName(seen.select("path", "category", "message")).filter("category is not null")
            failures = [{"path": r["path"], "message": r["message"]} for r in bad.orderBy("path").limit(FAILURES_TOLD).collect()]
        out.append({"agent": agent, "root": root, "exists": there, "readable": os.access(root, os.R_OK | os.X_OK), "discovered": n, "latest_updated_at_ms": latest, "failures": failures})
    return out


def permissions(archive, sources: list[dict[str, Any]]) -> dict[str, Any]:
    """What can't be read or written, and what others can read."""
    problems = [f"{s['root']} can't be read" for s in sources if s["exists"] and not s["readable"]]
    notes = []
    if archive.store.local:
        folder = Path(archive.path.removeprefix("file://"))
        if not os.access(folder, os.W_OK):
            problems.append(f"{folder} can't be written")
        if stat.S_IMODE(os.stat(folder).st_mode) & 0o007:
            notes.append(f"{folder} is open to other users")
    return {"healthy": not problems, "problems": problems, "notes": notes}


def report(archive, names: tuple[str, ...] = AGENTS, interval_seconds: int = 300, debounce_ms: int = 1000, roots: dict[str, str] | None = None) -> dict[str, Any]:
    m, sources = archive.manifest(), agents(archive.spark, names, roots)
    checks = archive.verify().collect()
    telemetry = m["telemetry"]
    done, last = telemetry.get("completed_at_ms"), telemetry.get("last_ingest")
    newest = max((s["latest_updated_at_ms"] for s in sources if s["latest_updated_at_ms"] is not None), default=None)
    try:
        analyser(m["tokenizer"])
        tokenizer = {"tokenizer": m["tokenizer"], "available": True, "error": None}
    except (ValueError, OSError) as e:
        tokenizer = {"tokenizer": m["tokenizer"], "available": False, "error": str(e)}
    rights = permissions(archive, sources)
    watched = [s["root"] for s in sources if s["exists"] and s["readable"]]
    watch = {"ready": interval_seconds > 0 and debounce_ms > 0, "roots": watched, "interval_seconds": interval_seconds, "debounce_ms": debounce_ms}
    size = archive.table("objects").agg(F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("n")).first()["n"]
    healthy = all(c["passed"] for c in checks) and tokenizer["available"] and not any(s["failures"] for s in sources) and not (last or {}).get("failed") and rights["healthy"] and watch["ready"]
    return {
        "healthy": healthy,
        "database": {"path": archive.path, "version": m["version"], "checks": checks, "last_ingest": last, "total_failures": telemetry.get("total_failures", 0), "lag_ms": max(newest - done, 0) if newest is not None and done is not None else None},
        "agents": sources,
        "tokenizer": tokenizer,
        "permissions": rights,
        "watch": watch,
        "runtime": {"python": sys.version.split()[0], "spark": pyspark.__version__, "platform": platform.platform(), "at_ms": int(time.time() * 1000)},
        "backup": {"advice": f"sessionlake backup PATH copies {len(m['commits'])} commits ({size} bytes of originals) and checks the copy", "commits": len(m["commits"])},
    }
