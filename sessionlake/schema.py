"""Schemas, enumerations and JSON-to-text projections of a session archive."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

SCHEMA_VERSION = 1
CONTRACT = "lossless-v1"
AGENTS = ("claude", "codex", "gemini", "opencode", "pi")
KINDS = ("user", "assistant", "system", "thinking", "tool_call", "tool_result", "usage")
NOT_SEARCHABLE = ("tool_result", "usage")
USAGE_PARTS = ("input", "output", "reasoning", "cache_read", "cache_write")
MODES = ("partial", "full")

_S, _L, _I, _B, _N = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.BinaryType()


def _struct(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in columns])


USAGE = _struct(*[(n, _L, True) for n in (*USAGE_PARTS, "total")])
SESSIONS = _struct(
    ("id", _S, False), ("agent", _S, False), ("cwd", _S, True), ("started_at_ms", _L, True), ("ended_at_ms", _L, True), ("title", _S, True),
    ("model", _S, True), ("provider", _S, True), ("git_branch", _S, True), ("parent_session_id", _S, True), ("forked_from", _S, True),
    ("mode", _S, False), ("fingerprint", _S, False), ("meta_json", _S, False), ("ingested_at_ms", _L, False),
)
EVENTS = _struct(
    ("session_id", _S, False), ("idx", _L, False), ("kind", _S, False), ("subtype", _S, True), ("role", _S, True), ("name", _S, True),
    ("call_id", _S, True), ("is_error", _B, True), ("native_id", _S, True), ("parent_id", _S, True), ("model", _S, True), ("provider", _S, True),
    ("usage", USAGE, True), ("text", _S, False), ("data_json", _S, True), ("created_at_ms", _L, True),
)
RAW_SOURCES = _struct(
    ("session_id", _S, False), ("locator", _S, False), ("kind", _S, False), ("restore_path", _S, False), ("role", _S, True),
    ("bytes", _L, True), ("mtime_ns", _L, True), ("mode", _L, True), ("object_hash", _S, True),
)
OBJECTS = _struct(("hash", _S, False), ("compression", _S, False), ("bytes", _L, False), ("payload", _N, False), ("created_at_ms", _L, False))
TABLES = {"sessions": SESSIONS, "events": EVENTS, "raw_sources": RAW_SOURCES, "objects": OBJECTS}
KEYS = {"sessions": ("id",), "events": ("session_id", "idx"), "raw_sources": ("session_id", "locator"), "objects": ("hash",)}


#: Agents whose parsers were registered beside the five.
REGISTERED: set[str] = set()


def parse_agent(name: str) -> str:
    found = name.lower().replace("open-code", "opencode")
    if found not in AGENTS and found not in REGISTERED:
        raise ValueError(f"unknown agent {name!r}")
    return found


def parse_kind(name: str) -> str:
    if name not in KINDS:
        raise ValueError(f"unknown event kind {name!r}")
    return name


def compact(value: Any) -> str:
    """Null is empty, a string is itself, anything else its compact JSON with sorted keys."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def flatten(value: Any) -> str:
    """The readable text of a content value: strings, ``text`` or ``content`` members, and arrays of them joined by lines."""

    def member(item: dict) -> Any:
        return item["text"] if "text" in item else item.get("content", item)

    if isinstance(value, list):
        parts = [compact(member(x)) if isinstance(x, dict) else compact(x) for x in value]
        return "\n".join(p for p in parts if p)
    if isinstance(value, dict):
        return compact(member(value))
    return compact(value)
