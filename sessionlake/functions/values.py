"""Time, JSON, usage and score expressions."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000
UNKNOWN_AGE_DAYS = 3650.0
HALF_LIFE_DAYS = 30.0
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

#: What a best hit's kind adds to a session's score.
KIND_WEIGHTS = {"user": 1.0, "assistant": 0.8, "system": 0.5, "thinking": 0.4, "tool_call": 0.3}
OTHER_KIND = 0.2


def rfc3339_ms(text: Column) -> Column:
    """Epoch milliseconds, or null where the text is no RFC 3339 time."""
    return F.when(text.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(F.upper(text))))


def rfc3339_or_number_ms(text: Column) -> Column:
    """As above; a bare integer is divided by a thousand and kept as it is."""
    return F.coalesce(rfc3339_ms(text), F.floor(text.try_cast("bigint") / 1000).cast("bigint"))


def parse_rfc3339(value: object) -> int | None:
    """The driver's twin of :func:`rfc3339_ms`."""
    if not isinstance(value, str) or not re.match(RFC3339, value):
        return None
    try:
        t = datetime.fromisoformat(value.upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def since_ms(text: str, now_ms: int) -> int:
    """A number of days back from now, or an RFC 3339 time."""
    if text.isascii() and text.isdigit():
        return now_ms - int(text) * DAY_MS
    found = parse_rfc3339(text)
    if found is None:
        raise ValueError(f"not a number of days or an RFC 3339 time: {text!r}")
    return found


def age_days(ended_ms: Column, as_of_ms: int) -> Column:
    return F.when(ended_ms.isNull(), F.lit(UNKNOWN_AGE_DAYS)).otherwise(F.greatest(F.lit(0.0), (F.lit(as_of_ms) - ended_ms) / F.lit(float(DAY_MS))))


def recency(ended_ms: Column, as_of_ms: int) -> Column:
    return F.exp(F.lit(-math.log(2)) * age_days(ended_ms, as_of_ms) / HALF_LIFE_DAYS)


def kind_weight(kind: Column) -> Column:
    out = F.lit(OTHER_KIND)
    for k, w in KIND_WEIGHTS.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out


def usage_total(usage: str = "usage") -> Column:
    """``total``, else the sum of the parts that are there, else null."""
    parts = [F.col(f"{usage}.{p}") for p in ("input", "output", "reasoning", "cache_read", "cache_write")]
    some = F.coalesce(*parts)
    return F.coalesce(F.col(f"{usage}.total"), F.when(some.isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def split_ns(ns: Column) -> tuple[Column, Column]:
    """Whole seconds and the nanoseconds that remain, never negative."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    return ((ns - rest) / 1_000_000_000).cast("bigint"), rest


def object_hash(content: Column) -> Column:
    return F.sha2(content, 256)
