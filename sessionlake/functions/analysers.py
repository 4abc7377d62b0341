"""Analysers by name: how texts are cut into tokens for an index, and queries for the same index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession, functions as F

from . import lexicon, segment, text as X

#: One analyser's words at one place of a query: the word itself and what will do instead.
Word = tuple[str, ...]


class Analyser:
    """``column`` gives the token array of a text; if not ``plain``, a struct of it and of further (pos, term) at its places."""

    name = "unicode61 remove_diacritics 2"
    plain = True

    def column(self, text: Column) -> Column:
        return X.tokens(text)

    def words(self, text: str) -> list[Word]:
        return [(t,) for t in X.tokens_py(text)]


@dataclass
class Segmenting(Analyser):
    """Dictionary words in CJK runs, folded words and their stems elsewhere; a query's word also asks for its stem."""

    vocabulary: frozenset[str] = frozenset()
    name: str = "segmenting"
    path: str | None = None
    plain: bool = field(default=False, init=False)

    def __post_init__(self):
        self.cutter = segment.Segmenter(lexicon.loaded(self.path) if self.path else self.vocabulary)

    def column(self, text: Column) -> Column:
        """A word list goes to the tasks as a file, which each worker loads once; a vocabulary goes with the function."""
        file = send_file(SparkSession.active(), self.path) if self.path else None
        held = None if file else self.cutter

        @F.pandas_udf("toks array<string>, more array<struct<pos:int,term:string>>")
        def cut(texts: pd.Series) -> pd.DataFrame:
            cutter = held or segment.Segmenter(lexicon.loaded(SparkFiles.get(file)))
            toks, more = [], []
            for t in texts:
                own, extra = [], []
                for x in cutter.tokens(t or ""):
                    if x.colocated:
                        extra.append({"pos": len(own) - 1, "term": x.text})
                    else:
                        own.append(x.text)
                toks.append(own)
                more.append(extra)
            return pd.DataFrame({"toks": toks, "more": more})

        return cut(text)

    def words(self, text: str) -> list[Word]:
        out: list[list[str]] = []
        for x in self.cutter.tokens(text, query=True):
            if x.colocated:
                out[-1].append(x.text)
            else:
                out.append([x.text])
        return [tuple(w) for w in out]


PORTABLE = Analyser()


KINDS: dict[str, Callable[[str], Analyser]] = {}


@lru_cache(maxsize=8)
def analyser(name: str) -> Analyser:
    """By the name that a manifest holds: the portable one, ``segmenting``, ``segmenting:`` and the path of a word list (UTF-8, a word and its count a line), or one that was registered."""
    kind, _, path = name.partition(":")
    if name == PORTABLE.name:
        return PORTABLE
    if kind in KINDS:
        made = KINDS[kind](path)
        made.name = name
        return made
    if kind != "segmenting":
        raise ValueError(f"unknown tokenizer {name!r}")
    return Segmenting(name=name, path=path or None)


def send_file(spark: SparkSession, path: str) -> str:
    """Sends a word list to all tasks, and its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def register(kind: str, make: Callable[[str], Analyser]) -> None:
    """An analyser of one's own: ``make`` gets what follows the colon in a name (``kind:rest``), and is called again wherever an archive's manifest names it."""
    if kind in KINDS or kind == PORTABLE.name:
        raise ValueError(f"analyser {kind!r} is there already")
    KINDS[kind] = make
