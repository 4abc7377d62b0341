"""Services over an archive: one request, one answer; an error never ends a service.

A request is a JSON object whose ``op`` names the operation; sessions are named by ``id``. ``serve`` speaks JSON lines, :mod:`sessionlake.daemon`
the same requests over a socket.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from .archive import Archive
from .functions.values import since_ms
from .schema import MODES, parse_agent, parse_kind


class Refused(Exception):
    """A request that can't be served: its code, message and details."""

    def __init__(self, code: str, message: str, details: Any = None):
        super().__init__(message)
        self.code, self.details = code, details


def plain(value: Any) -> Any:
    """Rows, bytes and tuples as JSON values."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


class Fields:
    """A request's members, by name and type."""

    def __init__(self, request: dict[str, Any]):
        self.request = request

    def get(self, name: str, kind: type, default: Any = None) -> Any:
        value = self.request.get(name)
        if value is None:
            return default
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise Refused("invalid_argument", f"{name} must be a {kind.__name__}")
        return value

    def need(self, name: str) -> str:
        value = self.get(name, str)
        if value is None:
            raise Refused("invalid_argument", f"{name} is missing")
        return value

    def checked(self, name: str, check: Callable[[str], Any]) -> Any:
        value = self.get(name, str)
        return None if value is None else check(value)

    def since(self) -> int | None:
        return self.checked("since", lambda v: since_ms(v, int(time.time() * 1000)))

    def kinds(self) -> tuple[str, ...]:
        value = self.request.get("kind")
        if value is None:
            return ()
        if not isinstance(value, (str, list)) or (isinstance(value, list) and not all(isinstance(v, str) for v in value)):
            raise Refused("invalid_argument", "kind must be a string or an array of strings")
        return tuple(parse_kind(v.strip()) for v in (value.split(",") if isinstance(value, str) else value) if v.strip())


def _mode(name: str) -> str:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}")
    return name


def stats(archive: Archive, f: Fields) -> Any:
    rows = archive.stats().collect()
    return {"agents": rows, "sessions": sum(r["sessions"] for r in rows), "events": sum(r["events"] for r in rows)}


def search(archive: Archive, f: Fields) -> Any:
    query = f.need("query")
    if not query.strip():
        raise Refused("invalid_argument", "query is blank")
    return archive.search(query, f.get("limit", int) or 20, f.checked("agent", parse_agent), f.get("cwd", str), f.since()).collect()


def listing(archive: Archive, f: Fields) -> Any:
    rows, cursor = archive.list(f.get("limit", int) or 50, f.get("cursor", str), agent=f.checked("agent", parse_agent), cwd=f.get("cwd", str), since_ms=f.since(), mode=f.checked("mode", _mode), model=f.get("model", str), provider=f.get("provider", str))
    rows = [{("events" if k == "event_count" else k): v for k, v in plain(r).items() if k != "sort_time"} for r in rows]
    return {"sessions": rows, "next_cursor": cursor}


def show(archive: Archive, f: Fields) -> Any:
    found = archive.show(f.need("id"), f.get("from", int), f.get("to", int), f.kinds())
    return None if found is None else dict(zip(("session", "sources", "events"), found, strict=True))


def reconstruct(archive: Archive, f: Fields) -> Any:
    return [x["path"] for x in archive.restore(f.need("id"), f.need("out"), f.get("overwrite", bool, False))["files"]]


OPERATIONS: dict[str, Callable[[Archive, Fields], Any]] = {"stats": stats, "search": search, "list": listing, "show": show, "reconstruct": reconstruct}


def answer(archive: Archive, text: str | bytes, operations: dict[str, Callable[[Archive, Fields], Any]] = OPERATIONS) -> dict[str, Any]:
    """The answer to one request, whatever happens."""
    try:
        request = json.loads(text)
        if not isinstance(request, dict):
            raise Refused("invalid_argument", "a request is a JSON object")
        f = Fields(request)
        op = f.need("op")
        if op not in operations:
            raise Refused("unsupported_operation", f"{op!r} is no operation of this service", {"supported": sorted(operations)})
        return {"ok": True, "result": plain(operations[op](archive, f))}
    except Refused as e:
        code, message, details = e.code, str(e), e.details
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        code, message, details = "invalid_json", str(e), None
    except (ValueError, TypeError) as e:
        code, message, details = "invalid_argument", str(e), None
    except Exception as e:  # noqa: BLE001  an operation's failure is an answer
        code, message, details = "operation_failed", str(e), None
    return {"ok": False, "error": {"code": code, "message": message} | ({"details": details} if details else {})}


def serve(archive: Archive, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip():
            yield json.dumps(answer(archive, line), ensure_ascii=False)
