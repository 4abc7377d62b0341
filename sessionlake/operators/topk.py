"""The best hits of a query from blocked postings, without reading blocks that can't hold one.

A plain query's phrases of one or two words are lists of postings of their own (words, and pairs of neighbouring words), whose frequencies are stored, so a text's score is a sum over
lists. Blocks are the same runs of texts in every list. A block's score is bounded by the sum, over the lists, of the score of its most occurrences in its shortest text.

The blocks of greatest bound are read first, in order of their keys where bounds are equal. The least of the ``cap`` best hits is then a threshold: blocks that can't exceed it, or only
equal it behind the last hit's key, are skipped. If the first ``READ`` blocks don't settle it, a last pass reads all blocks that are left, by a join. The result is that of
reading every posting: bounds are computed as scores are, in the same order, with room for rounding where a block has texts of several occurrences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, functions as F

from ..plans.query import Node, Phrase, Plan
from . import fulltext

READ = (16, 256)
AHEAD = 1024
ROOM = 1e-12


def lists(plan: Plan) -> list[tuple[str, bool]] | None:
    """(term, whether it is a pair) of each scored phrase, or None where the plan asks for more than such lists hold."""
    parts = (plan.expr,) if isinstance(plan.expr, Phrase) else plan.expr.parts if isinstance(plan.expr, Node) and plan.expr.op == "or" else ()
    plain = parts and all(isinstance(p, Phrase) and 1 <= len(p.terms) <= 2 and not (p.prefix or p.first or p.also) for p in parts)
    return [(" ".join(p.terms), len(p.terms) == 2) for p in parts] if plain else None


@dataclass
class Lists:
    """Where a query's lists are: ``blocks(pair, terms)`` scans their blocks, ``live`` drops dead posts, ``terms`` holds frequencies."""

    blocks: Callable[[bool, list[str]], DataFrame]
    live: Callable[[DataFrame], DataFrame]
    terms: DataFrame
    n_docs: int
    avgdl: float


def _of(wanted: list[tuple[str, bool]], stored: Lists, columns: list[str]) -> DataFrame:
    """The blocks of the wanted lists, with ``pair``."""
    parts = []
    for pair in (False, True):
        names = sorted({t for t, p in wanted if p == pair})
        if names:
            parts.append(stored.blocks(pair, names).filter(F.col("term").isin(*names)).select(*columns, F.lit(pair).alias("pair")))
    return reduce(DataFrame.unionByName, parts)


def _is(name: tuple[str, bool]) -> str:
    return f"(term = {_text(name[0])} AND pair = {str(name[1]).lower()})"


def _text(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _sum(parts: list[str]) -> str:
    """Added up from the left, beginning with nothing, as scores are."""
    out = "0.0D"
    for p in parts:
        out = f"({out} + {p})"
    return out


def _term_score(tf: str, dl: str, avgdl: float) -> str:
    """:func:`fulltext.term_score` as SQL text: a statement is quicker to make than as many expressions."""
    k1, b = fulltext.K1, fulltext.B
    return f"(({tf} * {_number(k1 + 1)}) / ({tf} + ({_number(k1)} * ({_number(1 - b)} + (({_number(b)} * {dl}) / {_number(avgdl)})))))"


def headers(wanted: list[tuple[str, bool]], stored: Lists) -> DataFrame:
    """commit, block, ub (no text's score exceeds it), low (the least key) and each list's idf."""
    lists_of, n = range(len(wanted)), f"{stored.n_docs}L"
    rows = _of(wanted, stored, ["term", "commit", "block", "max_tf", "min_dl", "low"])
    sums = ", ".join(f"'d{i}', coalesce(sum(CASE WHEN {_is(w)} THEN df END), 0L)" for i, w in enumerate(wanted))
    df = stored.terms.filter(" OR ".join(_is(w) for w in wanted)).agg(F.expr(f"named_struct({sums})").alias("s")).scalar()
    most = [F.expr(f"coalesce(max(CASE WHEN {_is(w)} THEN {_term_score('max_tf', 'min_dl', stored.avgdl)} END), 0.0D)").alias(f"m{i}") for i, w in enumerate(wanted)]
    per = rows.groupBy("commit", "block").agg(*most, F.min("low").alias("low"), F.max("max_tf").alias("most_tf")).withColumn("s", df)
    raw = [f"ln(({n} - s.d{i} + 0.5D) / (s.d{i} + 0.5D))" for i in lists_of]
    idf = [f"CASE WHEN {r} > 0 THEN {r} ELSE {_number(fulltext.LEAST_IDF)} END AS idf{i}" for i, r in zip(lists_of, raw, strict=True)]
    bound = _sum([f"(idf{i} * m{i})" for i in lists_of])
    return per.selectExpr("*", *idf).selectExpr("commit", "block", f"CASE WHEN most_tf > 1 THEN {bound} * {_number(1 + ROOM)} ELSE {bound} END AS ub", "low", *[f"idf{i}" for i in lists_of])


def _scored(blocks: DataFrame, wanted: list[tuple[str, bool]], stored: Lists, weights: list[float], sessions: DataFrame | None) -> DataFrame:
    """session_id, idx, bm25 of all texts in the given blocks."""
    posts = stored.live(blocks.selectExpr("term", "pair", "commit", "inline(posts)"))
    if sessions is not None:
        posts = posts.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    per = posts.groupBy("session_id", "idx", "dl").agg(*[F.expr(f"coalesce(sum(CASE WHEN {_is(w)} THEN tf END), 0L)").alias(f"f{i}") for i, w in enumerate(wanted)])
    score = _sum([f"({_number(w)} * {_term_score(f'f{i}', 'dl', stored.avgdl)})" for i, w in enumerate(weights)])
    return per.selectExpr("session_id", "idx", f"-{score} AS bm25")


def _place(r: Row) -> tuple:
    return r["session_id"], r["idx"]


def top(plan: Plan, stored: Lists, cap: int, best: Callable[[DataFrame, int], DataFrame], sessions: DataFrame | None = None, seen: dict | None = None) -> list[Row] | None:
    """The rows that ``best`` (per session and over all) leaves of all hits, or None where the plan is not one of lists. ``seen`` is told how many blocks were read."""
    wanted = lists(plan)
    if wanted is None:
        return None
    ahead = headers(wanted, stored).orderBy(F.desc("ub"), "low", "commit", "block").limit(AHEAD + 1).collect()
    if not ahead:
        return []
    weights = [ahead[0][f"idf{i}"] for i in range(len(wanted))]
    whole, columns = len(ahead) <= AHEAD, ["term", "commit", "block", "posts"]
    tell = seen if seen is not None else {}
    hits: list[Row] = []

    def beats(ub: float, low: Row) -> bool:
        """Whether a block may hold one of the best."""
        if len(hits) < cap:
            return True
        last = hits[-1]
        return ub > -last["bm25"] or (ub == -last["bm25"] and _place(low) < _place(last))

    for n in READ:
        chosen: dict[str, list[int]] = {}
        for r in ahead[:n]:
            chosen.setdefault(r["commit"], []).append(r["block"])
        these = " OR ".join(f"(commit = {_text(c)} AND block IN ({', '.join(map(str, b))}))" for c, b in chosen.items())
        rows = _scored(_of(wanted, stored, columns).filter(these), wanted, stored, weights, sessions)
        hits = best(rows, cap).collect()  # at most cap rows
        tell |= {"read": min(n, len(ahead)), "of": len(ahead)}
        rest = ahead[n:]
        if not rest:
            return hits
        if not beats(rest[0]["ub"], rest[0]["low"]):  # in order of bounds: nor does any behind it
            return hits
        if whole and len(rest) <= n:
            break
    left = headers(wanted, stored)
    if len(hits) >= cap:
        last = hits[-1]
        key = F.struct(F.lit(last["session_id"]).alias("session_id"), F.lit(last["idx"]).alias("idx"))
        left = left.filter((F.col("ub") > -last["bm25"]) | ((F.col("ub") == -last["bm25"]) & (F.col("low") < key)))
    # Blocks with as good a bound as the last hit's score hold all that can be among the best.
    rows = _of(wanted, stored, columns).join(left.select("commit", "block"), ["commit", "block"], "left_semi")
    tell |= {"read": None}
    return best(_scored(rows, wanted, stored, weights, sessions), cap).collect()
