"""Text expressions that stay inside Catalyst."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

PREVIEW_CHARS = 500
TOKEN = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Every precomposed letter whose canonical decomposition is one base letter and marks, with that letter."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.combining(x) for x in d[1:]):
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), _FROM, _TO))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


def fold_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def tokens_py(text: str) -> list[str]:
    """The driver's twin of :func:`tokens`, for query terms."""
    out, word = [], []
    for c in fold_py(text):
        if unicodedata.category(c)[0] in "LN":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def like_ascii(column: Column, pattern: str) -> Column:
    """LIKE whose letters A-Z match either case and whose wildcards have no escape."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) if ord(c) < 128 else c for c in pattern)
    return column.rlike(f"(?is)^{body}$")


def contains_ascii(column: Column, part: str) -> Column:
    """``LIKE '%part%'`` with ``part``'s own wildcards alive."""
    return like_ascii(column, f"%{part}%")


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def term_hits(terms: list[str], text: Column) -> Column:
    """How many of the terms occur in the text as substrings."""
    return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def covered(terms: list[str], text: Column) -> Column:
    """The terms that occur in the text as substrings."""
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: text.contains(t))


def glob(pattern: str) -> str:
    """A regular expression for a file glob whose ``*`` crosses ``/`` and whose backslash is a slash."""
    p, out, i = pattern.replace("\\", "/"), [], 0
    while i < len(p):
        c = p[i]
        if c == "*":
            while p[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c in "[{":
            end = p.find("]" if c == "[" else "}", i + 1)
            if end < 0:
                raise ValueError(f"bad glob {pattern!r}")
            inner = p[i + 1 : end]
            if c == "[":
                out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("[", "\\[") + "]")
            else:
                out.append("(?:" + "|".join(glob(x)[4:-1] for x in inner.split(",")) + ")")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
