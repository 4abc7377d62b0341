"""Full-text query planning: plain queries and the match syntax (phrases, AND/OR/NOT, NEAR, prefixes, ``text:``, ``^``)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.analysers import PORTABLE, Analyser


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last may be a prefix; ``first`` ties them to the text's start; ``also`` holds what will do in each one's place."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    also: tuple[tuple[str, ...], ...] = ()

    def places(self) -> tuple[tuple[str, ...], ...]:
        """Any of the words that will do at each place."""
        return tuple((t, *(self.also[k] if self.also else ())) for k, t in enumerate(self.terms))


def phrase_of(words: list[tuple[str, ...]], prefix: bool = False, first: bool = False) -> Phrase:
    return Phrase(tuple(w[0] for w in words), prefix, first, tuple(w[1:] for w in words) if any(len(w) > 1 for w in words) else ())


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple = ()


@dataclass
class Plan:
    expr: object  # Phrase, Near or Node; None matches nothing
    phrases: list[Phrase] = field(default_factory=list)  # those that score, in order, with repeats
    terms: list[str] = field(default_factory=list)  # lower-cased words for coverage; empty in syntax mode
    empty: bool = False


_SYNTAX = re.compile(r'["*():]| OR | AND | NOT |NEAR\(', re.ASCII)


def has_syntax(query: str) -> bool:
    return any(c in query for c in '"*():') or any(w in query.upper() for w in (" OR ", " AND ", " NOT ", "NEAR("))


def plain_terms(query: str) -> list[str]:
    return [] if has_syntax(query) else [w.lower() for w in query.split()]


def plan(query: str, analyser: Analyser = PORTABLE) -> Plan:
    """A plain query asks for the whole phrase or any of its words; one with syntax is parsed as it stands."""
    if not query.strip():
        return Plan(None, empty=True)
    if has_syntax(query):
        expr = _Parser(query, analyser).parse()
        return Plan(expr, list(leaves(expr)))
    words = query.split()
    phrases = [phrase_of(analyser.words(w)) for w in ([query, *words] if len(words) > 1 else words)]
    phrases = [p for p in phrases if p.terms]
    return Plan(Node("or", tuple(phrases)) if phrases else None, phrases, plain_terms(query))


def leaves(expr: object):
    if isinstance(expr, Phrase):
        yield expr
    elif isinstance(expr, Near):
        yield from expr.phrases
    elif isinstance(expr, Node):
        for p in expr.parts:
            yield from leaves(p)


class _Parser:
    """expr := and-terms joined by OR; AND binds tighter, NOT tightest; juxtaposition is AND."""

    WORD = re.compile(r'\s*(?:("(?:[^"]|"")*")|([^\s"(){}:*+^,]+)|(.))', re.DOTALL)

    def __init__(self, text: str, analyser: Analyser = PORTABLE):
        self.analyser, self.items, at = analyser, [], 0
        while at < len(text.rstrip()):
            m = self.WORD.match(text, at)
            if m[1]:
                self.items.append(("string", m[1][1:-1].replace('""', '"')))
            elif m[2]:
                self.items.append(("op" if m[2] in ("AND", "OR", "NOT") else "word", m[2]))
            else:
                if m[3] == '"':
                    raise ValueError("unterminated string in query")
                self.items.append((m[3], m[3]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None):
        item = self.peek()
        if kind and item[0] != kind:
            raise ValueError(f"query: expected {kind}, found {item[1] or 'the end'}")
        self.at += 1
        return item

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise ValueError(f"query: unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        parts = [self.both()]
        while self.peek() == ("op", "OR"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self):
        parts = [self.negated()]
        while True:
            if self.peek() == ("op", "AND"):
                self.take()
            elif self.peek()[0] not in ("string", "word", "(", "^"):
                break
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negated(self):
        out = self.unit()
        while self.peek() == ("op", "NOT"):
            self.take()
            out = Node("not", (out, self.unit()))
        return out

    def unit(self):
        kind, word = self.peek()
        if kind == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if kind in ("word", "string") and self.peek(1)[0] == ":":
            if word.lower() != "text":
                raise ValueError(f"query: no such column: {word}")
            self.take()
            self.take()
            return self.unit()
        if kind == "word" and word == "NEAR" and self.peek(1)[0] == "(":
            self.take()
            self.take()
            phrases, distance = [], 10
            while self.peek()[0] not in (")", ",", "end"):
                phrases.append(self.phrase())
            if self.peek()[0] == ",":
                self.take()
                kind, word = self.take("word")
                if not word.isdigit():
                    raise ValueError(f"query: NEAR distance {word!r}")
                distance = int(word)
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self):
        first = self.peek()[0] == "^"
        if first:
            self.take()
        terms, prefix = [], False
        while True:
            kind, word = self.peek()
            if kind not in ("string", "word"):
                raise ValueError(f"query: unexpected {word or 'the end'!r}")
            self.take()
            terms += self.analyser.words(word)
            if self.peek()[0] == "*":
                self.take()
                prefix = True
                break
            if self.peek()[0] != "+":
                break
            self.take()
        return phrase_of(terms, prefix, first)
