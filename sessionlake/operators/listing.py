"""Session listing with keyset pages, single-session views and per-agent statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_ascii
from ..schema import parse_kind

MOST = 500
SUMMARY = ("id", "agent", "cwd", "started_at_ms", "ended_at_ms", "title", "model", "provider", "mode")


def sort_time() -> Column:
    return F.coalesce("ended_at_ms", "started_at_ms", "ingested_at_ms")


def encode_cursor(time_ms: int, session_id: str) -> str:
    return f"{time_ms}:{session_id.encode().hex()}"


def decode_cursor(cursor: str) -> tuple[int, str]:
    head, sep, tail = cursor.partition(":")
    try:
        if not sep or not tail:
            raise ValueError
        return int(head), bytes.fromhex(tail).decode()
    except ValueError:
        raise ValueError(f"invalid cursor {cursor!r}") from None


def matching(sessions: DataFrame, agent: str | None = None, cwd: str | None = None, since_ms: int | None = None, mode: str | None = None, model: str | None = None, provider: str | None = None) -> DataFrame:
    for name, value in (("agent", agent), ("model", model), ("provider", provider)):
        if value is not None:
            sessions = sessions.filter(F.col(name) == value)
    if cwd is not None:
        sessions = sessions.filter(contains_ascii(F.col("cwd"), cwd))
    if since_ms is not None:
        sessions = sessions.filter(sort_time() >= since_ms)
    if mode is not None:
        sessions = sessions.filter(F.col("mode").isin("partial", "full") if mode == "partial" else F.col("mode") == mode)
    return sessions


def after(time_ms: int, session_id: str) -> Column:
    """Rows past a place in the order (time descending, id ascending)."""
    return (F.col("sort_time") < time_ms) | ((F.col("sort_time") == time_ms) & (F.col("id") > session_id))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("event_count"))


def keys(sessions: DataFrame, limit: int = 50, cursor: str | None = None, **filters) -> DataFrame:
    """The place in order of a page's rows: sort_time and id of up to ``limit`` + 1 sessions."""
    rows = matching(sessions, **filters).select("id", sort_time().alias("sort_time"))
    if cursor is not None:
        rows = rows.filter(after(*decode_cursor(cursor)))
    return rows.orderBy(F.desc("sort_time"), "id").limit(max(1, min(limit, MOST)) + 1)


def page(sessions: DataFrame, events: DataFrame, limit: int = 50, cursor: str | None = None, **filters) -> DataFrame:
    """Up to ``limit`` + 1 summaries in order; the last tells whether another page follows."""
    rows = matching(sessions, **filters).withColumn("sort_time", sort_time())
    if cursor is not None:
        rows = rows.filter(after(*decode_cursor(cursor)))
    rows = rows.orderBy(F.desc("sort_time"), "id").limit(max(1, min(limit, MOST)) + 1)
    counts = event_counts(events.join(rows.select(F.col("id").alias("session_id")), "session_id", "left_semi"))
    return rows.select(*SUMMARY, "sort_time").join(counts, "id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0))).orderBy(F.desc("sort_time"), "id")


def event_range(events: DataFrame, session_id: str, low: int | None = None, high: int | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    if (low is not None and low < 0) or (high is not None and high < 0) or (low is not None and high is not None and low > high):
        raise ValueError(f"bad event range {low}..{high}")
    rows = events.filter(F.col("session_id") == session_id)
    if low is not None:
        rows = rows.filter(F.col("idx") >= low)
    if high is not None:
        rows = rows.filter(F.col("idx") <= high)
    if kinds:
        rows = rows.filter(F.col("kind").isin(*[parse_kind(k) for k in kinds]))
    return rows.orderBy("idx")


def talk(events: DataFrame, include_tools: bool = False) -> DataFrame:
    return events if include_tools else events.filter(F.col("kind").isin("user", "assistant"))


def stats(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """agent, sessions, events, full_sessions; events are counted by session first, so one shuffle of events."""
    rows = sessions.select("id", "agent", "mode").join(event_counts(events), "id", "left")
    return rows.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.count_if(F.col("mode") == "full").alias("full_sessions"))


def totals(per_agent: DataFrame) -> DataFrame:
    return per_agent.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("sessions", "events", "full_sessions")])


def turn_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count_if(F.col("kind").isin("user", "assistant")).alias("turns"))


def nested(sessions: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Each session with its sources (by locator) and events (by idx) as arrays."""
    e = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in events.columns if c not in ("session_id", "idx")]))).alias("events"))
    s = sources.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("locator", *[c for c in sources.columns if c not in ("session_id", "locator")]))).alias("sources"))
    return sessions.join(s, sessions["id"] == s["session_id"], "left").drop("session_id").join(e, sessions["id"] == e["session_id"], "left").drop("session_id")
