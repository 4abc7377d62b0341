"""Search snippets: the best window of 24 tokens around a query's phrases, with the hits marked."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..workers import small_batches
from .text import fold_py

OPEN, CLOSE, ELLIPSIS, TOKENS = "«", "»", "…", 24


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded token) of each run of letters, digits and marks."""
    out, start = [], None
    for i, c in enumerate(text + " "):
        inside = unicodedata.category(c)[0] in "LN" or (start is not None and unicodedata.combining(c))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append((start, i, fold_py(text[start:i])))
            start = None
    return out


def analysed(text: str, analyser) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, the tokens at that place) by an analyser's own cuts."""
    out: list[list] = []
    for t in analyser.cutter.tokens(text):
        if t.colocated:
            out[-1][2] += (t.text,)
        else:
            out.append([t.start, t.end, (t.text,)])
    return [tuple(x) for x in out]


def snippet(text: str, phrases: list[tuple], size: int = TOKENS, analyser=None) -> str:
    """The window that scores most: 1000 for each phrase's first hit in it, 1 for each further, 120 at the text's start, 100 at a sentence's."""
    toks = spans(text) if analyser is None or analyser.plain else analysed(text, analyser)
    words = [{t[2]} if isinstance(t[2], str) else set(t[2]) for t in toks]
    wanted = [tuple({w} if isinstance(w, str) else set(w) for w in p) for p in phrases]
    hits = sorted((i, k) for k, p in enumerate(wanted) if p for i in range(len(words) - len(p) + 1) if all(words[i + j] & w for j, w in enumerate(p)))
    if not toks:
        return text
    if not hits:
        hits = [(0, -1)]
    # A sentence starts at the text's start and after a stop or colon.
    sentence = {0}
    for i in range(1, len(toks)):
        between = text[toks[i - 1][1] : toks[i][0]].strip()
        if between[-1:] in (".", ":"):
            sentence.add(i)

    def value(start: int) -> tuple[int, int]:
        seen, score, first, last = set(), 0, None, None
        for i, k in hits:
            if i < start or i >= start + size:
                continue
            score += 1 if k in seen else 1000
            seen.add(k)
            first = i if first is None else first
            last = i + (len(phrases[k]) if k >= 0 else 1)
        centre = max(0, first - (size - (last - first)) // 2) if first is not None else 0
        return score, centre

    best, begin = -1, 0
    for i, _ in hits:
        score, centre = value(i)
        if score > best:
            best, begin = score, centre
        starts = [s for s in sentence if i - size < s <= i]
        if starts:
            s = max(starts)
            score, _ = value(s)
            score += 120 if s == 0 else 100
            if score > best:
                best, begin = score, s
    begin = max(0, min(begin, len(toks) - size)) if len(toks) > size else 0
    end = min(len(toks), begin + size)
    marked = set()
    for i, k in hits:
        if k >= 0:
            marked |= set(range(i, i + len(phrases[k])))
    out, at = [ELLIPSIS if begin else "", ], toks[begin][0] if begin else 0
    i = begin
    while i < end:
        if i in marked:
            j = i
            while j + 1 < end and j + 1 in marked:
                j += 1
            out += [text[at : toks[i][0]], OPEN, text[toks[i][0] : toks[j][1]], CLOSE]
            at, i = toks[j][1], j + 1
        else:
            i += 1
    out.append(text[at : toks[end - 1][1]] if end < len(toks) else text[at:])
    return "".join(out) + (ELLIPSIS if end < len(toks) else "")


def snippet_column(text: Column, phrases: list[tuple], analyser=None) -> Column:
    """A text at a time is a Python string; what a worker holds beside it is one small Arrow batch."""
    small_batches(SparkSession.active())

    @F.arrow_udf(StringType())
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array((snippet(t.as_py() or "", phrases, analyser=analyser) for t in texts), pa.string())

    return cut(text)
