"""URL filters: rules first, then host word segmentation and naive Bayes.

A URL's host and path are taken apart by one pattern; the longest rule that fits decides. Where none fits, the host's and
the path's runs of letters are split into words by a unigram Viterbi search (the word
sequence of greatest probability; word counts come from the text of all pages; a run that is no word costs as much more as it is longer), and
a multinomial naive Bayes model scores the words; any number is the one word ``#``. A host's last label says nothing and is left out, unless it is the only one.

The model's classes are trained on labelled URLs: a table of the caller's, or else the rows that the rules decide, each with its rule's verdict; all of
them, counted by Spark. So the model carries the rules' judgement to rows that no rule fits, and nothing that it knows is written here. Both classes are smoothed by the
words of all hosts of the table. ``quality`` tells how it judges labelled rows of hosts that it was not trained on, ``agreement`` how it judges those the rules decide.

The unigram table keeps the words that make up at least ``MIN_SHARE`` of all words (so at most 1 / MIN_SHARE
words, whatever the corpus); so do the background and the classes. Words seen nowhere say nothing.

Cases: a null url or one without ``://`` has an empty host and path, no words and the verdict ``allow``; ports and user names stay
in the host as given; with no labelled row, or none of one class, every score is as even as the words are, and equal scores (0.5) are ``allow``; of rules of one length the later in order of text; of equally cheap splits the one whose last word is longest,
then the one before it; equal ids and repeated rows are judged row by row; very long urls and runs are split whole; empty tables give no rows; further
columns of any name are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, ship

MIN_SHARE = 1e-5
MOST_RULES = 1000
PRIOR = 0.5
MASS = 50.0
UNKNOWN = math.log(10.0)
PATTERN = r"://([^/?#]*)([^?#]*)"
_RUN = regex.compile(r"\p{L}+|\p{N}+")
NUMBER = "#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; an expression takes {MOST_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Segmenter:
    counts: dict[str, int]

    def __post_init__(self):
        self.total = sum(self.counts.values()) + 1
        self.lengths = sorted({len(w) for w in self.counts}, reverse=True)
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, run: str) -> tuple[str, ...]:
        if run not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[run] = self._split(run)
        return self.known[run]

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return math.log(self.total / n) if n else math.log(self.total) + len(word) * UNKNOWN

    def _split(self, run: str) -> tuple[str, ...]:
        """The cheapest words of a run of letters; of equals, the one whose last words are longest."""
        best, last = [0.0], [0]
        open_cost, open_start = 0.0, 0  # of an unknown word: the cheapest start, with what its length will cost taken off
        for end in range(1, len(run) + 1):
            c, start = open_cost + end * UNKNOWN + math.log(self.total), open_start
            for n in self.lengths:
                if n <= end and (word := run[end - n : end]) in self.counts:
                    here = best[end - n] + self.cost(word)
                    if here < c or (here == c and end - n < start):
                        c, start = here, end - n
            best.append(c)
            last.append(start)
            if c - end * UNKNOWN < open_cost:
                open_cost, open_start = c - end * UNKNOWN, end
        out, end = [], len(run)
        while end:
            out.append(run[last[end] : end])
            end = last[end]
        return tuple(reversed(out))

    def words(self, host: str, path: str) -> list[str]:
        """Of the host without its last label (unless it has no other), and of the path."""
        return [w for part in (host.rpartition(".")[0] or host, path) for run in _RUN.findall(part.lower()) for w in (self.split(run) if run[0].isalpha() else (NUMBER,))]


@dataclass
class Bayes:
    """Multinomial naive Bayes; both classes are smoothed by MASS words dealt as the background is, so what is common here is no sign."""

    block: dict[str, int]
    allow: dict[str, int]
    background: dict[str, int]
    prior: float = PRIOR

    def __post_init__(self):
        known = self.block.keys() | self.allow.keys() | self.background.keys()
        total = sum(self.background.values()) + len(known)
        share = {w: MASS * (self.background.get(w, 0) + 1) / total for w in known}
        nb, na = sum(self.block.values()) + MASS, sum(self.allow.values()) + MASS
        self.weights = {w: math.log((self.block.get(w, 0) + share[w]) / nb * na / (self.allow.get(w, 0) + share[w])) for w in known}

    def score(self, words: list[str]) -> float:
        """Chance of the block class."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(self.weights.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _shares(counts: DataFrame, scratch: Scratch, name: str) -> dict[str, int]:
    """Of (w, n) rows, those of MIN_SHARE or more: at most 1 / MIN_SHARE."""
    counts = scratch.write(counts, name)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return {r["w"]: r["n"] for r in counts.filter(F.col("n") >= MIN_SHARE * total).collect()}


def by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """(url, verdict) of the rows that a rule decides."""
    found = rule(host(pages[url]), path(pages[url]), rules)
    return pages.select(pages[url].alias("url"), found["verdict"].alias("verdict")).filter("verdict is not null")


def held_out(url: Column) -> Column:
    """A quarter of all hosts."""
    return F.pmod(F.crc32(host(url)), F.lit(4)) == 2


def train(pages: DataFrame, labelled: DataFrame, url: str = "url", html: str = "html") -> tuple[Segmenter, Bayes]:
    """The word table of ``pages`` and a model of ``labelled`` (url, verdict) rows."""
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "urls")
    prose = F.lower(F.regexp_replace(F.coalesce(pages[html], F.lit("")), "<[^>]*>", " "))
    seen = pages.select(F.explode(F.split(prose, r"\P{L}+")).alias("w")).filter("w != ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = _shares(seen, scratch, "words")
    segmenter = Segmenter(counts)

    def split(batches):
        for b in batches:
            got: dict[str, int] = {}
            for h, p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w in segmenter.words(h, p):
                    got[w] = got.get(w, 0) + n
            yield pa.record_batch([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["w", "n"])

    def counted(parts: DataFrame, name: str) -> dict[str, int]:
        return _shares(parts.mapInArrow(split, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), scratch, name)

    hosts = pages.groupBy(host(pages[url]).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    background = counted(hosts.select("h", F.lit("").alias("p"), "n"), "hosts")
    parts = labelled.select(host(labelled["url"]).alias("h"), path(labelled["url"]).alias("p"), "verdict").groupBy("h", "p", "verdict").agg(F.count(F.lit(1)).alias("n"))
    parts = scratch.write(parts, "labelled")
    classes = {v: counted(parts.filter(F.col("verdict") == v).drop("verdict"), v) for v in ("block", "allow")}
    return segmenter, Bayes(classes["block"], classes["allow"], background)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """Per row: ``key``, host, path, rule, verdict, words, block_score; the model is of ``labelled`` (url, verdict) rows, or of those the rules decide."""
    scored = _scored(pages, *train(pages, by_rules(pages, rules, url) if labelled is None else labelled, url, html), key, url)
    rows = scored.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("s.block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(key, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "s.words", "s.block_score")


def _scored(pages: DataFrame, segmenter: Segmenter, bayes: Bayes, key: str, url: str) -> DataFrame:
    held = pages.sparkSession.sparkContext.broadcast((segmenter, bayes))  # at most 1 / MIN_SHARE words each

    @F.pandas_udf("words string, block_score double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        s, model = held.value
        words = [s.words(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"words": [" ".join(w) for w in words], "block_score": [model.score(w) for w in words]})

    rows = pages.select(pages[key], host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    return rows.withColumn("s", score("host", "path"))


def agreement(judged: DataFrame) -> DataFrame:
    """By verdict of the rules (null: none): how many rows, and how many the model alone blocks."""
    by_rule = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return judged.groupBy(by_rule.alias("rules_say")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("block_score") > 0.5).cast("long")).alias("model_blocks"))


def quality(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """verdict, n, right: the rows that the rules decide on held-out hosts, and how many a model of the other hosts' rows judges alike."""
    labelled = by_rules(pages, rules, url)
    model = train(pages, labelled.filter(~held_out(F.col("url"))), url, html)
    asked = labelled.filter(held_out(F.col("url"))).select(F.struct("url", "verdict").alias("row"), "url")
    judged = _scored(asked, *model, "row", "url").select("row.verdict", (F.col("s.block_score") > 0.5).alias("blocked"))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("blocked") == (F.col("verdict") == "block")).alias("right"))
