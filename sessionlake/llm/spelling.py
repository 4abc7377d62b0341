"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

One edit leaves one half of a word whole: the first stands at the start of the other word, or the second at its end. So every word is kept, by each of its halves, in a
shard; a shard's automaton holds the halves of its words, all words that may meet one of them are scanned by it, and a hit counts where its offset fits (start for first halves,
end for second ones) and the lengths differ by one at most. What is left of both words is then verified to differ by one edit.

Shards are hashes of (length, side, half), so a word is sent to six shards at most: two sides for each of three lengths. There are as many as keep ``SEGMENTS`` halves each;
one that a common half makes larger is split by a hash of the words it holds, and the words to scan go to each part. A task holds one automaton; the words to
scan stream by, sorted behind the words held. Of more than ``FEW`` words with one half, the rests are looked up by their deletions, so no task compares all pairs of a group.

A word's form is its near word of largest count, where that is at least ``FACTOR`` times its own. Counts thus grow along forms, chains end, and roots are found by pointer
doubling over written tables, in rounds of the logarithm of the longest chain.

Cases: null and empty texts have no words; a null id is an empty one in the checksum; equal ids and repeated rows count each time; ties of count go to the smaller word by
code point; words without a near word are their own root; very long words are verified directly; an empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, only, partitions, ship, trimmed

WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, FACTOR = 5, 3, 2
EVERY = 97
SEGMENTS = 50_000
FEW = 12
LONG = 64


def misspelt(key: Column, run: Column, every: int) -> Column:
    """The run, without one code point where ``every`` divides the checksum of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n of the words long and common enough."""
    runs = only(docs, key, text).toDF("k", "t").select("k", F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("run"))
    word = misspelt(F.col("k"), F.translate("run", UPPER, LOWER), every)
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts the two."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) > len(b) + 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))  # noqa: B905  the shorter one ends it
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


class Group:
    """The words of one length that share one half: their rests."""

    def __init__(self, length: int, side: int):
        self.length, self.side = length, side
        self.words: list[tuple[str, int]] = []
        self.rests: list[str] = []
        self.whole: dict[str, int] | None = None
        self.less: dict[str, list[tuple[int, int]]] = {}

    def add(self, word: str, n: int) -> None:
        half = self.length // 2
        self.words.append((word, n))
        self.rests.append(word[:half] if self.side else word[half:])

    def near(self, rest: str) -> Iterator[int]:
        """Which words' rests are one edit from ``rest``."""
        if len(self.words) <= FEW or len(rest) > LONG:
            yield from (k for k, r in enumerate(self.rests) if one_edit(r, rest))
            return
        if self.whole is None:
            self.whole = {r: k for k, r in enumerate(self.rests)}
            for k, r in enumerate(self.rests):
                for i in range(len(r)):
                    self.less.setdefault(r[:i] + r[i + 1 :], []).append((i, k))
        more = len(rest) - len(self.rests[0])
        cut = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
        if more == 0:  # one is replaced: both without it are equal
            for i, c in enumerate(cut):
                yield from (k for j, k in self.less.get(c, ()) if i == j and self.rests[k] != rest)
        elif more == 1:
            yield from {self.whole[c] for c in cut if c in self.whole}
        else:
            yield from {k for _, k in self.less.get(rest, ())}


class Shard:
    """An automaton over the halves of the words held."""

    def __init__(self):
        self.groups: dict[str, dict[tuple[int, int], Group]] = {}
        self.automaton = None

    def add(self, half: str, side: int, word: str, n: int) -> None:
        of = self.groups.setdefault(half, {})
        of.setdefault((len(word), side), Group(len(word), side)).add(word, n)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words held, by a half that ``word`` has in the fitting place, that are one edit from it."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for half, of in self.groups.items():
                self.automaton.add_word(half, (len(half), list(of.values())))
            self.automaton.make_automaton()
        size = len(word)
        for end, (length, groups) in self.automaton.iter(word) if self.groups else ():
            starts, ends = end + 1 == length, end + 1 == size
            if not (starts or ends):
                continue
            for g in groups:
                if abs(g.length - size) > 1 or not (ends if g.side else starts):
                    continue
                rest = word[: size - length] if g.side else word[length:]
                for k in g.near(rest):
                    found = g.words[k]
                    if not (g.side and word.startswith(found[0][: g.length // 2])):  # else its first half has found it
                        yield found


_ROLE_HELD, _ROLE_SCANNED = 0, 1


def _scan(pairs: bool):
    def run(batches):
        here, shard = None, Shard()
        for b in batches:
            out: list[tuple] = []
            for at, part, role, side, half, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (at, part) != here:
                    here, shard = (at, part), Shard()
                if role == _ROLE_HELD:
                    shard.add(half, side, word, n)
                    continue
                found = list(shard.near(word))
                if pairs:
                    out += [(word, 1, w, m) for w, m in found]
                elif found:
                    m, w = min((-m, w) for w, m in found)
                    out.append((word, len(found), w, -m))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.record_batch(columns, names=["word", "n_near", "near", "near_n"])

    return run


def _routes(size: Column, word: Column, of: Column, shards: int) -> list[Column]:
    """struct(shard, side, half) of a word's two halves, taken as a word of ``of`` code points has them."""
    first, second = F.floor(of / 2).cast("int"), F.ceil(of / 2).cast("int")
    halves = F.substring(word, F.lit(1), first), F.substring(word, size - second + 1, second)
    return [F.struct(F.pmod(F.xxhash64(of, F.lit(side), half), F.lit(shards)).alias("shard"), F.lit(side).alias("side"), half.alias("half")) for side, half in enumerate(halves)]


def near(table: DataFrame, scratch: Scratch, pairs: bool = False, segments: int = SEGMENTS) -> DataFrame:
    """word, n_near, near, near_n for written (word, n): with ``pairs`` each near pair from both its ends, else for each shard the count and best of a word's near words."""
    spark = table.sparkSession
    ship(spark)
    total = table.count()
    shards = max(partitions(spark), -(-2 * total // segments))
    size, word = F.char_length("word"), F.col("word")
    held = table.select("word", "n", F.explode(F.array(*_routes(size, word, size, shards))).alias("r")).select("word", "n", "r.*")
    three = [r["shard"] for k in (-1, 0, 1) for r in _routes(size, word, size + k, shards)]
    asked = table.select("word", F.explode(F.array_distinct(F.array(*three))).alias("shard"))
    # Shards that a common half makes too large are split: at most one for each ``segments`` halves.
    large = scratch.write(held.groupBy("shard").count().filter(F.col("count") > 2 * segments).select("shard", F.ceil(F.col("count") / segments).cast("int").alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.lit(_ROLE_HELD).alias("role"), "side", "half", "word", "n")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("side", "int"), ("half", "string"))]
    asked = asked.join(large, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(_ROLE_SCANNED).alias("role"), *nothing, "word", F.lit(None).cast("long").alias("n"))
    rows = held.unionByName(asked).repartition(shards, "shard", "part").sortWithinPartitions("shard", "part", "role")
    return rows.mapInArrow(trimmed(_scan(pairs)), "word string, n_near long, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of (word, form) links that make no cycle."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        above = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = at.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved = scratch.write(moved, f"roots-{turn}")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY, factor: int = FACTOR, segments: int = SEGMENTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    table = scratch.write(words(docs, key, text, least_chars, least_count, every), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = scratch.write(near(table, scratch, segments=segments).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")), "near")
    fits = F.col("best.near_n") >= factor * F.col("n")
    rows = table.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n")
    )
    rows = scratch.write(rows, "forms")
    ends = roots(rows.filter("form is not null"), scratch)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
