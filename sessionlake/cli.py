"""Command line: ``python -m sessionlake.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict

from pyspark.sql import SparkSession

from . import doctor
from .api import plain, serve
from .archive import Archive, ArchiveError
from .config import resolve
from .functions.values import since_ms
from .service import Service


def shown(value, style: str) -> str:
    value = plain(value)
    if style == "jsonl":
        return "\n".join(json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value]))
    body = json.dumps(value, ensure_ascii=False, indent=None if style == "json" else 2)
    return f"```json\n{body}\n```" if style == "markdown" else body


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionlake")
    p.add_argument("--config")
    p.add_argument("--database-path")
    p.add_argument("--output-format")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple[str, dict]):
        c = sub.add_parser(name)
        for flag, how in args:
            c.add_argument(flag, **how)

    text, many, flag, number = {}, {"action": "append"}, {"action": "store_true"}, {"type": int}
    command("ingest", ("--agent", many), ("--root", text), ("--since", text), ("--exclude", many), ("--dry-run", flag), ("--strict", flag))
    command("watch", ("--agent", many), ("--root", text), ("--interval", number), ("--debounce-ms", number), ("--once", flag))
    command("search", ("query", text), ("--limit", number | {"default": 20}), ("--agent", text), ("--cwd", text), ("--since", text))
    command("list", ("--limit", number | {"default": 50}), ("--cursor", text), ("--agent", text), ("--cwd", text), ("--since", text), ("--mode", text), ("--model", text), ("--provider", text))
    command("show", ("session_id", text), ("--from", number | {"dest": "low"}), ("--to", number | {"dest": "high"}), ("--kind", many), ("--include-tools", flag))
    for name in ("stats", "reindex", "verify", "doctor", "api", "compact"):
        command(name)
    command("backup", ("target", text))
    command("import", ("source", text))
    command("gc", ("--dry-run", flag))
    command("restore", ("session_id", text), ("out", text), ("--overwrite", flag), ("--manifest", text))
    command("serve", ("--listen", {"default": "127.0.0.1:50051"}), ("--socket", text), ("--allow-remote", flag), ("--reconstruct-root", text))
    command("service", ("action", {"choices": ("install", "uninstall", "start", "stop", "status")}))
    command("completion", ("shell", {"choices": ("bash",)}))
    return p


def run(a: argparse.Namespace, spark: SparkSession, lines=sys.stdin):
    """The command's result; ``api`` gives an iterator of lines."""
    if a.command == "service":
        return getattr(Service(), a.action)()
    if a.command == "completion":
        names = next(x for x in parser()._actions if isinstance(x, argparse._SubParsersAction)).choices
        return {"script": f"complete -W '{' '.join(sorted(names))}' sessionlake"}
    config = resolve({"database_path": a.database_path, "output_format": a.output_format}, file=a.config)
    archive, now = Archive(spark, config.database_path), int(time.time() * 1000)
    since = since_ms(a.since, now) if getattr(a, "since", None) else None
    agents = tuple(getattr(a, "agent", None) or config.default_agents) if a.command in ("ingest", "watch") else ()
    match a.command:
        case "ingest":
            report = archive.ingest(agents, a.root, since, tuple(a.exclude or config.exclude), a.dry_run)
            if a.strict and report.failed:
                print(shown(asdict(report), config.output_format))
                raise ArchiveError(f"{report.failed} sources failed")
            return asdict(report)
        case "watch":
            from .streaming.watch import watch

            tell = lambda e: print(json.dumps(e, default=lambda x: asdict(x)))
            done = watch(archive, tell, a.interval or config.watch_interval_seconds, a.debounce_ms or config.watch_debounce_ms, a.once, agents=agents, root=a.root, exclude=config.exclude)
            return asdict(done)
        case "search":
            return archive.search(a.query, a.limit, a.agent, a.cwd, since).collect()
        case "list":
            rows, cursor = archive.list(a.limit, a.cursor, agent=a.agent, cwd=a.cwd, since_ms=since, mode=a.mode, model=a.model, provider=a.provider)
            return {"sessions": rows, "next_cursor": cursor}
        case "show":
            found = archive.show(a.session_id, a.low, a.high, tuple(a.kind or ()))
            if found is None:
                return None
            session, sources, events = found
            if not a.kind and not a.include_tools:
                events = [e for e in events if e["kind"] in ("user", "assistant")]
            return {"session": session, "sources": sources, "events": events}
        case "stats":
            return archive.stats().collect()
        case "verify":
            return archive.verify().collect()
        case "doctor":
            return doctor.report(archive, config.default_agents, config.watch_interval_seconds, config.watch_debounce_ms)
        case "reindex":
            return archive.reindex()
        case "compact":
            return archive.compact()
        case "backup":
            return archive.backup(a.target)
        case "import":
            return archive.import_archive(a.source)
        case "gc":
            return archive.gc(a.dry_run)
        case "restore":
            return archive.restore(a.session_id, a.out, a.overwrite, a.manifest)
        case "serve":
            from .daemon import Daemon

            return Daemon(archive, a.listen, a.socket, a.allow_remote, a.reconstruct_root).run()
        case "api":
            return serve(archive, lines)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sessionlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(a, spark)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.command == "api":
        for line in out:
            print(line, flush=True)
    elif not a.quiet:
        print(shown(out, resolve({"output_format": a.output_format}, file=a.config).output_format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
