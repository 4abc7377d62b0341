"""The five connectors. Each turns native records into events by a table of record types."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path
from typing import Any
from urllib.parse import quote

from ..schema import REGISTERED, compact, flatten
from .base import Candidate, Firsts, Parsed, Source, SourceError, Times, event, get, json_lines, listed, read, relative, source, text_of, time_ms

#: Codex record types by what they become.
CODEX_CALLS = {"function_call", "custom_tool_call", "tool_search_call", "web_search_call"}
CODEX_OUTPUTS = {"function_call_output", "custom_tool_call_output", "tool_search_output"}
CODEX_SILENT = {"agent_message", "item_completed"}
CLAUDE_SYSTEM = {"system", "mode", "permission-mode", "attachment"}


def first_there(*values: Any) -> Any:
    return next((v for v in values if v is not None), None)


class Codex(Source):
    agent = "codex"

    def keeps(self, p: Path) -> bool:
        return p.name.startswith("rollout-") and p.suffix == ".jsonl"

    def examine(self, c: Candidate) -> list[Candidate]:
        (c,) = super().examine(c)
        try:
            records = json_lines(read(c.path), c.path)
        except SourceError:
            return [c]  # reported when it is parsed
        meta = [r["payload"] for r in records if get(r, "type") == "session_meta" and isinstance(get(r, "payload"), dict)]
        native = first_there(*[text_of(first_there(m.get("id"), m.get("session_id"))) for m in meta])
        return [replace(c, native_id=native, spawned=list(self.spawned(records)))] if native else [c]

    @staticmethod
    def spawned(records: list[Any]):
        """(child id, agent type) of each spawning call that an output answers; an output serves one call."""
        open_calls: dict[str, str | None] = {}
        for r in records:
            p = get(r, "payload")
            call = text_of(get(p, "call_id"))
            if get(p, "type") == "function_call" and get(p, "name") == "spawn_agent" and call:
                open_calls[call] = text_of(get(_inner(get(p, "arguments")), "agent_type"))
            elif get(p, "type") == "function_call_output" and call in open_calls:
                child = text_of(get(_inner(get(p, "output")), "agent_id"))
                if child:
                    yield child, open_calls.pop(call)

    def parse(self, c: Candidate, root: str) -> Parsed | None:
        head, times, events, seen, meta = Firsts(), Times(), [], set(), {}

        def user(text: str, at: Any, ms: int | None, record: Any) -> None:
            key = f"{hashlib.sha256(text.encode()).hexdigest()}:{at}"
            if key not in seen:
                seen.add(key)
                events.append(event("user", text, record, role="user", created_at_ms=ms))

        for r in json_lines(read(c.path), c.path):
            kind, p, at = get(r, "type"), get(r, "payload"), get(r, "timestamp")
            sub, ms = get(p, "type"), times.see(time_ms(at))
            if kind == "session_meta":
                meta = p if isinstance(p, dict) else meta
                head.offer(id=text_of(first_there(get(p, "id"), get(p, "session_id"))), cwd=text_of(get(p, "cwd")), provider=text_of(get(p, "model_provider")), branch=text_of(get(p, "git", "branch")))
            elif kind == "turn_context":
                head.offer(model=text_of(get(p, "model")))
            elif kind == "event_msg" and sub == "user_message":
                user(text_of(get(p, "message")) or flatten(get(p, "text_elements")), at, ms, r)
            elif kind == "event_msg" and sub == "token_count":
                info = get(p, "info")
                total = get(info, "last_token_usage", "total_tokens")
                events.append(event("usage", compact(first_there(info, p)), r, subtype=sub, usage={"total": total if isinstance(total, int) else None}, created_at_ms=ms))
            elif kind == "event_msg" and sub not in CODEX_SILENT:
                events.append(event("system", compact(p), r, subtype=text_of(sub), created_at_ms=ms))
            elif kind == "response_item" and sub == "message":
                role = get(p, "role")
                if role == "assistant":
                    events.append(event("assistant", flatten(get(p, "content")), r, role=role, created_at_ms=ms))
                elif role in ("user", "developer"):
                    user(flatten(get(p, "content")), at, ms, r)
            elif kind == "response_item" and sub == "reasoning":
                events.append(event("thinking", compact(first_there(get(p, "summary"), p)), r, subtype="summary", created_at_ms=ms))
            elif kind == "response_item" and sub in CODEX_CALLS:
                body = first_there(get(p, "arguments"), get(p, "input"), get(p, "query"), p)
                events.append(event("tool_call", compact(body), r, name=text_of(get(p, "name")) or sub, call_id=text_of(get(p, "call_id")), created_at_ms=ms))
            elif kind == "response_item" and sub in CODEX_OUTPUTS:
                events.append(event("tool_result", compact(first_there(get(p, "output"), p)), r, call_id=text_of(get(p, "call_id")), created_at_ms=ms))
            elif kind in ("compacted", "world_state"):
                events.append(event("system", compact(first_there(p, r)), r, subtype=kind, created_at_ms=ms))
        if not head.get("id"):
            raise SourceError(f"{c.path}: no session id", "unsupported_format")
        meta = dict(meta) | ({"agentType": c.agent_type} if c.agent_type else {})
        return Parsed(_session("codex", head["id"], times, meta, cwd=head.get("cwd"), model=head.get("model"), provider=head.get("provider"), git_branch=head.get("branch"), parent_session_id=c.parent_session_id), events, [source(c, root)])


class Claude(Source):
    agent = "claude"

    def keeps(self, p: Path) -> bool:
        return p.suffix == ".jsonl" and not (p.name == "journal.jsonl" and "workflows" in p.parts)

    def candidate(self, p: Path) -> Candidate:
        nested = p.parent.name == "subagents"
        return listed(p, f"{p.parents[1].name}/{p.stem}" if nested else p.stem, [p.with_suffix(".meta.json")], parent_session_id=f"claude:{p.parents[1].name}" if nested else None)

    def parse(self, c: Candidate, root: str) -> Parsed | None:
        head, times, events = Firsts(), Times(), []
        for r in json_lines(read(c.path), c.path):
            kind, message = get(r, "type"), get(r, "message")
            ms = times.see(time_ms(get(r, "timestamp")))
            fork = get(r, "forkedFrom")
            head.offer(
                id=text_of(get(r, "sessionId")), cwd=text_of(get(r, "cwd")), branch=text_of(get(r, "gitBranch")), title=text_of(get(r, "aiTitle")) if kind == "ai-title" else None,
                model=text_of(get(message, "model")) if kind == "assistant" else None, fork=f"claude:{get(fork, 'sessionId')}#{get(fork, 'messageUuid')}" if isinstance(get(fork, "sessionId"), str) else None,
            )
            base = {"native_id": text_of(get(r, "uuid")), "parent_id": text_of(get(r, "parentUuid")), "created_at_ms": ms or 0}
            if kind == "user" and get(r, "toolUseResult") is not None:
                events.append(event("tool_result", compact(r["toolUseResult"]), r, **base))
            elif kind == "user":
                events.append(event("user", flatten(message), r, role="user", **base))
            elif kind == "assistant":
                content = get(message, "content")
                blocks = content if isinstance(content, list) else [None]
                model = text_of(get(message, "model"))
                for b in blocks:
                    if b is None:
                        events.append(event("assistant", flatten(content), r, role="assistant", model=model, **base))
                        continue
                    t = text_of(get(b, "type")) or "text"
                    more = {"subtype": t, "name": text_of(get(b, "name")), "call_id": text_of(first_there(get(b, "id"), get(b, "tool_use_id"))), "is_error": get(b, "is_error") if isinstance(get(b, "is_error"), bool) else None, "model": model, **base}
                    if t == "thinking":
                        events.append(event("thinking", text_of(first_there(get(b, "thinking"), get(b, "text"))) or "", b, **more))
                    elif t == "tool_use":
                        events.append(event("tool_call", compact(first_there(get(b, "input"), b)), b, **more))
                    elif t == "tool_result":
                        events.append(event("tool_result", compact(first_there(get(b, "content"), b)), b, **more))
                    else:
                        events.append(event("assistant", text_of(get(b, "text")) or "", b, role="assistant", **more))
            elif kind in CLAUDE_SYSTEM:
                events.append(event("system", compact(first_there(get(r, "content"), get(r, "attachment"), r)), r, subtype=kind, **base))
        if not head.get("id") and not events:
            raise SourceError(f"{c.path}: no session records", "unsupported_format")
        meta: dict[str, Any] = {}
        if c.parent_session_id:
            meta["isSubagent"] = True
            for path in c.extra:
                agent_type = get(json.loads(read(path)), "agentType")
                meta |= {"agentType": agent_type} if agent_type is not None else {}
        native = c.native_id if c.parent_session_id else head.get("id") or c.native_id
        sources = [source(c, root), *[source(c, root, p, "subagent-meta") for p in c.extra]]
        return Parsed(_session("claude", native, times, meta, cwd=head.get("cwd"), model=head.get("model"), title=head.get("title"), git_branch=head.get("branch"), parent_session_id=c.parent_session_id, forked_from=head.get("fork")), events, sources)


class Gemini(Source):
    agent = "gemini"

    def keeps(self, p: Path) -> bool:
        return p.name.startswith("session-") and p.suffix in (".json", ".jsonl")

    def parse(self, c: Candidate, root: str) -> Parsed | None:
        content = read(c.path)
        records = [json.loads(content)] if c.path.endswith(".json") else json_lines(content, c.path)
        native, times, rows = None, Times(), []
        for r in records:
            if isinstance(get(r, "sessionId"), str):
                native = r["sessionId"]
                times.first = first_there(times.first, time_ms(get(r, "startTime")))
                times.last = first_there(time_ms(get(r, "lastUpdated")), times.last)
                rows += get(r, "messages") or []
            elif isinstance(get(r, "$set", "messages"), list):
                rows += r["$set"]["messages"]
                times.last = first_there(time_ms(get(r, "$set", "lastUpdated")), times.last)
            elif get(r, "type") is not None:
                rows.append(r)
        events, seen, known = [], set(), native is not None
        for r in rows:
            key = text_of(get(r, "id")) or ""
            if key in seen:
                continue
            seen.add(key)
            kind, body, ms = get(r, "type"), first_there(get(r, "content"), get(r, "message")), time_ms(get(r, "timestamp"))
            if ms is not None and native is None:
                times.see(ms)
            base = {"native_id": key or None, "created_at_ms": ms}
            if kind == "user":
                known = True
                if not flatten(body).startswith("<session_context>"):
                    events.append(event("user", flatten(body), r, role="user", **base))
            elif kind == "gemini":
                known = True
                events.append(event("assistant", flatten(body), r, role="assistant", model=text_of(get(r, "model")), **base))
                events += [event("thinking", compact(t), t, **base) for t in get(r, "thoughts") or []]
                for call in get(r, "toolCalls") or []:
                    more = {"name": text_of(get(call, "name")), "call_id": text_of(get(call, "id")), **base}
                    events.append(event("tool_call", compact(first_there(get(call, "args"), call)), call, **more))
                    if get(call, "result") is not None:
                        events.append(event("tool_result", compact(call["result"]), call, **more))
            elif kind in ("info", "error"):
                known = True
                events.append(event("system", flatten(body), r, subtype=kind, **base))
        if not known:
            raise SourceError(f"{c.path}: nothing recognised", "unsupported_format")
        return Parsed(_session("gemini", native or Path(c.path).stem, times, {}, provider="google"), events, [source(c, root)])


class Pi(Source):
    agent = "pi"

    def keeps(self, p: Path) -> bool:
        return p.suffix == ".jsonl" and p.name != "None.jsonl"

    @staticmethod
    def time(value: Any) -> int | None:
        return value // 1000 if isinstance(value, int) and not isinstance(value, bool) else time_ms(value)

    def parse(self, c: Candidate, root: str) -> Parsed | None:
        records = json_lines(read(c.path), c.path)
        header = next((r for r in records if get(r, "type") == "session"), None)
        if header is None or not text_of(get(header, "id")):
            raise SourceError(f"{c.path}: no session header", "unsupported_format")
        head, times, events = Firsts(), Times(), []
        times.see(self.time(get(header, "timestamp")))
        for r in records:
            kind, m = get(r, "type"), get(r, "message")
            ms = times.see(self.time(first_there(get(m, "timestamp"), get(r, "timestamp"))))
            base = {"native_id": text_of(get(r, "id")), "parent_id": text_of(get(r, "parentId")), "created_at_ms": ms}
            if kind in ("model_change", "thinking_level_change"):
                if kind == "model_change":
                    head.offer(model=text_of(first_there(get(r, "modelId"), get(r, "model"))), provider=text_of(get(r, "provider")))
                events.append(event("system", compact(r), r, subtype=kind, **base))
            elif kind == "message":
                role, content = get(m, "role"), get(m, "content")
                head.offer(model=text_of(get(m, "model")), provider=text_of(get(m, "provider")))
                speaker = "user" if role == "user" else "assistant"
                if role == "toolResult":
                    error = get(m, "isError")
                    events.append(event("tool_result", flatten(content), r, name=text_of(get(m, "toolName")), call_id=text_of(get(m, "toolCallId")), is_error=error if isinstance(error, bool) else None, **base))
                elif isinstance(content, list):
                    for b in content:
                        t = text_of(get(b, "type")) or "text"
                        kind = {"thinking": "thinking", "toolCall": "tool_call", "text": speaker}.get(t, "system")
                        shown = compact(first_there(get(b, "arguments"), b)) if kind == "tool_call" else flatten(b)
                        events.append(event(kind, shown, b, subtype=t, role=text_of(role), name=text_of(get(b, "name")), call_id=text_of(first_there(get(b, "toolCallId"), get(b, "id"))), **base))
                else:
                    events.append(event(speaker, flatten(first_there(content, m)), r, role=text_of(role), **base))
        cwd = text_of(get(header, "cwd"))
        if cwd == "/tmp" or head.get("provider") == "faux":
            return None
        return Parsed(_session("pi", header["id"], times, {}, cwd=cwd, model=head.get("model"), provider=head.get("provider")), events, [source(c, root)])


class OpenCode(Source):
    agent = "opencode"
    FILE = "opencode.db"

    def keeps(self, p: Path) -> bool:
        return p.suffix in (".db", ".sqlite")

    def candidate(self, p: Path) -> Candidate:
        return listed(p, p.stem, [p.with_name(p.name + "-wal")])

    def examine(self, c: Candidate) -> list[Candidate]:
        (c,) = super().examine(c)
        try:
            with _open(c.path) as db:
                rows = db.execute("SELECT id, time_updated, time_created FROM session ORDER BY id").fetchall()
        except sqlite3.Error as e:
            raise SourceError(str(e), "unsupported_format", "discovery") from e
        return [replace(c, locator=f"{c.path}#{native}", native_id=native, fingerprint=f"{c.fingerprint}:{native}:{updated}", updated_at_ms=first_there(updated, created)) for native, updated, created in rows]

    def parse(self, c: Candidate, root: str) -> Parsed | None:
        with _open(c.path) as db:
            db.row_factory = sqlite3.Row
            s = db.execute("SELECT * FROM session WHERE id = ?", (c.native_id,)).fetchone()
            if s is None:
                return None
            messages = [dict(x) for x in db.execute("SELECT * FROM message WHERE session_id = ? ORDER BY time_created, id", (c.native_id,))]
            parts = [dict(x) for x in db.execute("SELECT * FROM part WHERE session_id = ? ORDER BY time_created, id", (c.native_id,))]
        s, events, of_message = dict(s), [], {}
        for p in parts:
            of_message.setdefault(p["message_id"], []).append(p)
        for m in messages:
            data = json.loads(m["data"])
            role = text_of(get(data, "role")) or "assistant"
            for p in of_message.get(m["id"], []):
                body = json.loads(p["data"])
                kind = {"text": "user" if role == "user" else "assistant", "reasoning": "thinking", "tool": "tool_call"}.get(get(body, "type"), "system")
                shown = first_there(get(body, "state"), body) if kind == "tool_call" else first_there(get(body, "text"), get(body, "output"), body)
                events.append(event(kind, compact(shown), body, subtype=text_of(get(body, "type")), role=role, name=text_of(get(body, "tool")), call_id=text_of(get(body, "callID")), native_id=m["id"], parent_id=text_of(get(data, "parentID")), model=text_of(get(data, "modelID")), provider=text_of(get(data, "providerID")), created_at_ms=first_there(p.get("time_created"), m.get("time_created"))))
        times = Times()
        times.first, times.last = s.get("time_created"), first_there(s.get("time_updated"), s.get("time_created"))
        portable = json.dumps({"session": s, "message": messages, "part": parts}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
        sources = [source(c, root, kind="sqlite"), *[source(c, root, p, "wal") for p in c.extra], {"locator": f"{c.locator}/portable.json", "kind": "derived", "restore_path": f"{relative(c.path, root)}.{c.native_id}.json", "role": "portable", "path": None, "content": portable}]
        parent = s.get("parent_id")
        return Parsed(_session("opencode", c.native_id, times, {"agent": s["agent"]} if s.get("agent") else {}, cwd=s.get("directory"), title=s.get("title"), model=s.get("model"), parent_session_id=f"opencode:{parent}" if parent else None), events, sources)


def bundle(path: str, session_id: str, target: str) -> int:
    """A SQLite file with one session's rows of every table that names sessions; returns the number of rows."""
    n = 0
    with _open(path) as src, sqlite3.connect(target) as out:
        for name, sql in src.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND sql IS NOT NULL AND name NOT LIKE 'sqlite_%'").fetchall():
            out.execute(sql)
            columns = [r[1] for r in src.execute(f'PRAGMA table_info("{name}")')]
            key = "id" if name == "session" else "session_id" if "session_id" in columns else None
            if key:
                rows = src.execute(f'SELECT * FROM "{name}" WHERE "{key}" = ?', (session_id,)).fetchall()
                out.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns))})', rows)
                n += len(rows)
    return n


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _inner(value: Any) -> Any:
    try:
        return json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return None


def _session(agent: str, native: str, times: Times, meta: dict[str, Any], **more: Any) -> dict[str, Any]:
    names = ("cwd", "title", "model", "provider", "git_branch", "parent_session_id", "forked_from")
    return {"id": f"{agent}:{native}", "agent": agent, "started_at_ms": times.first, "ended_at_ms": times.last, "meta_json": compact(meta), **{n: more.get(n) for n in names}}


REGISTRY: dict[str, Source] = {s.agent: s for s in (Claude(), Codex(), Gemini(), OpenCode(), Pi())}

#: Where each agent keeps its sessions, below the home folder.
ROOTS = {"claude": ".claude/projects", "codex": ".codex/sessions", "gemini": ".gemini/tmp", "opencode": ".local/share/opencode", "pi": ".pi/agent/sessions"}


def register(source: Source, root: str | None = None) -> None:
    """A parser of one's own, by its agent's name; ``root`` is where that keeps its sessions, below the home folder."""
    if source.agent in REGISTRY or source.agent != source.agent.lower():
        raise ValueError(f"agent {source.agent!r} is there already, or not lower case")
    REGISTRY[source.agent] = source
    REGISTERED.add(source.agent)
    if root is not None:
        ROOTS[source.agent] = root


def native_root(agent: str, home: str | None = None) -> str:
    if agent not in ROOTS:
        raise ValueError(f"agent {agent!r} has no native root: give one")
    return str(Path(home or Path.home()) / ROOTS[agent])
