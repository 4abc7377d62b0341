"""Full-text operators: gated token index, postings, phrase and boolean matching, BM25.

The index has one row per searchable event (its tokens and length); postings have one row per term and event.
A query reads the postings of its own terms only: stored postings are laid out in buckets by a hash of the term, and within a bucket
in files by block of texts, so a query opens a few folders and a common term is many files. Buckets and files follow the
number of postings; blocks carry what bounds their scores (:mod:`topk`). Corpus statistics come from the whole index, before any filter of the query.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.analysers import PORTABLE, Analyser
from ..plans.query import Near, Node, Phrase, Plan
from ..schema import NOT_SEARCHABLE
from ..scratch import Scratch

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
FILE_TOKENS = 2_000_000
MOST_BUCKETS = 1024
BLOCK_BITS = 12  # a block is of 4,096 texts in order, those of about one length
LENGTHS = 64
TASK_TOKENS = 250_000  # of a bucket's tokens, what one task turns into blocks and writes as one file


def searchable(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("kind").isin(*NOT_SEARCHABLE))


def index(events: DataFrame, keys: tuple[str, ...] = ("session_id", "idx"), text: str = "text", analyser: Analyser = PORTABLE) -> DataFrame:
    """``keys``, toks, dl of every searchable event; an analyser that puts several tokens at one place gives the others as ``more``."""
    gated = searchable(events) if "kind" in events.columns else events
    cut = gated.select(*keys, once(analyser.column(F.coalesce(F.col(text), F.lit("")))).alias("cut"))
    if analyser.plain:
        return cut.select(*keys, F.col("cut").alias("toks"), F.size("cut").cast("long").alias("dl"))
    return cut.select(*keys, "cut.toks", "cut.more", F.size("cut.toks").cast("long").alias("dl"))


def once(value: Column) -> Column:
    """The same value, computed once per row: a filter above would else be pushed below and its lambdas compute it for every element."""
    return F.explode(F.array(value))


def _each(idx: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, dl, pos, term of every token."""
    each = idx.select(*keys, "dl", F.posexplode("toks").alias("pos", "term"))
    if "more" not in idx.columns:
        return each
    return each.unionByName(idx.select(*keys, "dl", F.explode("more").alias("m")).select(*keys, "dl", "m.pos", "m.term"))


def postings(idx: DataFrame, keys: tuple[str, ...] = ("session_id", "idx"), places: bool = True) -> DataFrame:
    """``keys``, dl, term, positions (from 0; without ``places`` none), tf: each text's terms are gathered within its row, so nothing is shuffled."""
    spot = lambda term, pos: F.struct(term.alias("term"), pos.cast("int").alias("pos"))
    spots = F.transform("toks", spot)
    if "more" in idx.columns:
        spots = F.concat(spots, F.transform("more", lambda m: spot(m["term"], m["pos"])))
    rows = idx.select(*keys, "dl", once(F.sort_array(spots)).alias("spots"))
    start = lambda x, i: F.when((i == 0) | (x["term"] != F.get("spots", i - 1)["term"]), i)
    rows = rows.select(*keys, "dl", "spots", once(F.filter(F.transform("spots", start), lambda i: i.isNotNull())).alias("starts"))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("spots"))
    found = lambda s, k: F.struct(
        F.get("spots", s)["term"].alias("term"),
        (F.transform(F.sequence(s, end(k) - 1), lambda j: F.get("spots", j)["pos"]) if places else F.lit(None).cast("array<int>")).alias("positions"),
        (end(k) - s).alias("tf"),
    )
    return rows.select(*keys, "dl", F.inline(F.transform("starts", found)))


def layout(n_tokens: int) -> tuple[int, int]:
    """(buckets of terms, files of a bucket) of a stored index of so many tokens."""
    files = max(1, n_tokens // FILE_TOKENS)
    buckets = min(MOST_BUCKETS, max(8, files))
    return buckets, max(1, files // buckets)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def shared_out(each: DataFrame, held: list[int], by: tuple[str, ...]) -> DataFrame:
    """Rows with ``term``, with their bucket and file, dealt as they are to be written: a bucket is as many tasks, and files, as its tokens (``held``) are times TASK_TOKENS, by a
    hash of ``by``; so no task's share grows with the index or depends on how common a term is."""
    files = [max(1, -(-n // TASK_TOKENS)) for n in held]
    first = [sum(files[:b]) for b in range(len(files))]
    of = lambda counts: F.get(F.lit(counts), F.col("bucket"))
    each = each.withColumn("bucket", bucket(F.col("term"), len(held)))
    each = each.withColumn("file", (of(first) + F.pmod(F.xxhash64(*by), of(files))).cast("int"))
    return each.drop("bucket").repartitionById(sum(files), "file").withColumn("bucket", bucket(F.col("term"), len(held)))  # told again by the term, which is less than sending it


def folded(counts: list[int]) -> list[int]:
    """The tokens of each bucket of a stored index, from those of MOST_BUCKETS (:func:`shares`); the number of buckets is a power of two, so that each is a sum of these."""
    n = 1 << layout(sum(counts))[0].bit_length() - 1
    return [sum(counts[b::n]) for b in range(n)]


def numbered(events: DataFrame, analyser: Analyser = PORTABLE) -> DataFrame:
    """The index of a commit's events in order of their keys, each with its ``block``: texts of one length (of about one, from 32 tokens on: a fourth of a power of two) in a run of texts that follow each other.

    A block's bound adds up what its lists hold at best; as its texts are of one length, what adds up may well be in one text.
    """
    ordered = searchable(events).select("session_id", "idx", "text").repartitionByRange("session_id", "idx").sortWithinPartitions("session_id", "idx")
    dl, half = F.col("dl"), LENGTHS // 2
    length = F.when(dl < half, dl).otherwise(F.least(half + F.floor(4 * F.log2(dl / half)), F.lit(LENGTHS - 1))).cast("long")
    return index(ordered, analyser=analyser).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS) * LENGTHS + length)


def pairs(tokens: DataFrame) -> DataFrame:
    """The same texts with their pairs of neighbouring tokens as tokens: what a phrase of two words asks for."""
    two = F.transform(F.slice("toks", F.lit(1), F.greatest(F.size("toks") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("toks", i + 1)))
    return tokens.withColumn("toks", two)


def occurrences(tokens: DataFrame, sign: int) -> DataFrame:
    """term, pair, df (``sign``) of each text's tokens and pairs."""
    each = [(tokens, False), (pairs(tokens), True)]
    one, two = (t.select(F.explode(F.array_distinct("toks")).alias("term"), F.lit(pair).alias("pair"), F.lit(sign).cast("long").alias("df")) for t, pair in each)
    return one.unionByName(two)


def frequencies(each: DataFrame) -> DataFrame:
    """term, pair, df: sums of rows that are counts of texts, by one shuffle, sorted as they are to be written."""
    return each.groupBy("term", "pair").agg(F.sum("df").alias("df")).filter("df != 0").sortWithinPartitions("term")


def shares(tokens: DataFrame, buckets: int) -> list[int]:
    """How many tokens each bucket has: a row for each of at most MOST_BUCKETS comes to the driver."""
    held = dict(_each(tokens, ()).groupBy(bucket(F.col("term"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect())
    return [held.get(b, 0) for b in range(buckets)]


def blocks(tokens: DataFrame, held: list[int], places: bool = True) -> DataFrame:
    """Postings in blocks: for each term and block of texts its posts in order of their keys, and what bounds their scores: the most occurrences and the least length.

    Dealt as they are to be written, by term and block (:func:`shared_out`).
    """
    each = postings(tokens, ("session_id", "idx", "block"), places)
    per = shared_out(each.drop("tf" if places else "positions"), held, ("term", "block"))
    per = per.withColumn("tf", F.size("positions")) if places else per.withColumn("positions", F.lit(None).cast("array<int>"))
    post = F.struct("session_id", "idx", "dl", "tf", "positions")
    found = per.groupBy("bucket", "file", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(post)).alias("all"))
    posts = F.transform("all", lambda x: F.struct(*[x[k].alias(k) for k in ("session_id", "idx", "dl", "tf")]))
    spots = F.transform("all", lambda x: x["positions"]) if places else F.lit(None).cast("array<array<int>>")
    first = F.get("all", 0)
    low = F.struct(first["session_id"].alias("session_id"), first["idx"].alias("idx"))
    return found.select("term", "block", "n", "max_tf", "min_dl", low.alias("low"), posts.alias("posts"), spots.alias("positions"), "bucket").sortWithinPartitions("bucket", "term", "block")


def posts_of(blocked: DataFrame) -> DataFrame:
    """The postings in blocks: term, session_id, idx, dl, tf, positions, and the commit."""
    each = blocked.select("term", "commit", F.explode(F.arrays_zip("posts", "positions")).alias("x"))
    return each.select("term", "commit", "x.posts.session_id", "x.posts.idx", "x.posts.dl", "x.posts.tf", "x.positions")


def folders(plan: Plan, buckets: int, held: list[int]) -> list[str]:
    """The folders of a commit's postings that a plan's tokens are in (all of them for a prefix)."""
    keys = Positions(plan).asked
    if any(prefix for _, prefix in keys) or not keys:
        return [f"bucket={b}" for b in held]
    return of_terms([t for words, _ in keys for t in words], buckets, held)


def of_terms(terms: list[str], buckets: int, held: list[int]) -> list[str]:
    wanted = {crc32(t.encode()) % buckets for t in terms}
    return [f"bucket={b}" for b in held if b in wanted]


def document_frequency(idx: DataFrame) -> DataFrame:
    """term, df: in how many texts of an index each term is."""
    return idx.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def statistics(idx: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, avgdl."""
    return idx.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")).withColumn("avgdl", F.col("n_tokens") / F.greatest(F.col("n_docs"), F.lit(1)))


class Positions:
    """Where a plan's tokens stand, as a column of places for each: what matching reads in place of a text's tokens."""

    def __init__(self, plan: Plan):
        self.asked = list(dict.fromkeys(self.key(p, k) for p in plan.phrases for k in range(len(p.terms))))

    @staticmethod
    def key(p: Phrase, k: int) -> tuple[tuple[str, ...], bool]:
        """(the tokens any of which will do at a phrase's place ``k``, whether they are prefixes)."""
        return (p.terms[k], *(p.also[k] if p.also else ())), p.prefix and k == len(p.terms) - 1

    def column(self, p: Phrase, k: int) -> Column:
        return F.col(f"at{self.asked.index(self.key(p, k))}")

    def wanted(self, key: tuple[tuple[str, ...], bool]) -> Column:
        words, prefix = key
        return reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in words]) if prefix else F.col("term").isin(*words)

    def places(self, p: Phrase) -> Column:
        if not p.terms:
            return F.array().cast("array<int>")
        cols = [self.column(p, k) for k in range(len(p.terms))]
        tests = [lambda i, c=c, k=k: F.array_contains(c, i + k) for k, c in enumerate(cols) if k]
        if p.first:
            tests.append(lambda i: i == 0)
        return F.filter(cols[0], lambda i: reduce(lambda a, b: a & b, [t(i) for t in tests])) if tests else cols[0]


def phrase_places(p: Phrase, toks: str | Column | Positions = "toks") -> Column:
    """Start places of a phrase in a token array."""
    if isinstance(toks, Positions):
        return toks.places(p)
    toks = F.col(toks) if isinstance(toks, str) else toks
    n = len(p.terms)
    if not n:
        return F.array().cast("array<int>")

    def at(i: Column) -> Column:
        tests = []
        for k, t in enumerate(p.terms):
            w = F.get(toks, i + k)
            tests.append(w.startswith(t) if p.prefix and k == n - 1 else w == t)
        return reduce(lambda a, b: a & b, tests)

    if n == 1 and not p.prefix and not p.first:
        first = F.when(F.array_contains(toks, p.terms[0]), F.transform(toks, lambda w, i: i)).otherwise(F.array().cast("array<int>"))
        return F.filter(first, at)
    places = F.array(F.lit(0)) if p.first else F.transform(toks, lambda w, i: i)
    return F.filter(places, lambda i: F.coalesce(at(i), F.lit(False)))


def near(n: Near, toks: str | Column | Positions = "toks") -> Column:
    """Whether all phrases occur with at most ``distance`` tokens between each one's end and the start of the last."""
    if len(n.phrases) < 2:
        return F.size(phrase_places(n.phrases[0], toks)) > 0 if n.phrases else F.lit(False)
    starts = [phrase_places(p, toks) for p in n.phrases]

    def clump(last: Column) -> Column:
        """Each phrase has a place whose end lies at most ``distance`` tokens before ``last``, the last phrase's start."""
        def within(k: int):
            return lambda x: (x <= last) & (last - x <= n.distance + k)

        tests = [F.exists(places, within(len(p.terms))) for p, places in zip(n.phrases, starts, strict=True)]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a | b, [F.exists(s, clump) for s in starts])


def matches(expr: object, toks: str | Column | Positions = "toks") -> Column:
    """A query expression as a condition on a token array."""
    if expr is None:
        return F.lit(False)
    if isinstance(expr, Phrase):
        return F.size(phrase_places(expr, toks)) > 0
    if isinstance(expr, Near):
        return near(expr, toks)
    assert isinstance(expr, Node)
    parts = [matches(p, toks) for p in expr.parts]
    if expr.op == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if expr.op == "and" else (lambda a, b: a | b), parts)


def leaf_conditions(expr: object, toks: str | Column | Positions = "toks", outer: Column | None = None) -> list[Column | None]:
    """For each phrase of an expression, in order, when its hits count: every AND and NOT around it must hold in the text."""
    if isinstance(expr, Phrase):
        return [outer]
    if isinstance(expr, Near):
        here = matches(expr, toks) if outer is None else outer & matches(expr, toks)
        return [here] * len(expr.phrases)
    if not isinstance(expr, Node):
        return []
    if expr.op != "or":
        outer = matches(expr, toks) if outer is None else outer & matches(expr, toks)
    return [c for p in expr.parts for c in leaf_conditions(p, toks, outer)]


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(idx: DataFrame, plan: Plan, keys: tuple[str, ...] = ("session_id", "idx"), totals: tuple[int, float] | None = None, toks: str | Positions = "toks") -> DataFrame:
    """``keys`` and bm25 (less is better) of every match; frequencies are over all of ``idx``.

    ``totals`` (documents, mean length) stand in for the index's own where ``idx`` holds only the events with some of the plan's terms.
    The phrases' frequencies are a one-row subquery over the same rows; of a plain query over a whole index those rows are written first, so that
    texts are cut once.
    """
    if plan.expr is None:
        return idx.select(*keys, F.lit(0.0).alias("bm25")).limit(0)
    n = len(plan.phrases)
    plain = isinstance(plan.expr, Node) and plan.expr.op == "or" and all(isinstance(p, Phrase) for p in plan.expr.parts)
    # A repeated phrase scores twice, as each phrase of the plan is summed.
    counts = F.array(*[F.size(phrase_places(p, toks)) for p in plan.phrases])
    when = [None if c is None else c for c in leaf_conditions(plan.expr, toks)]
    hit = F.exists(F.col("f"), lambda x: x > 0) if plain else matches(plan.expr, toks)
    # One value per row, so that no frequency is computed again where it is used.
    row = idx.select(*keys, "dl", *([] if plain else [c for c in idx.columns if c not in (*keys, "dl")]), once(counts).alias("f"))
    if plain and totals is None:  # texts are cut and walked once: what the statistics and the scores read is written
        row = Scratch(row.sparkSession, "bm25").write(row, "rows")
    one = [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("f")[i] > 0).alias(f"n{i}") for i in range(n)]]
    stats = row.agg(F.struct(*one).alias("s")).select("s").scalar()
    row = row.filter(hit).withColumn("s", stats)
    n_docs, avgdl = (F.lit(totals[0]), F.lit(totals[1])) if totals else (F.col("s.n"), F.coalesce("s.avgdl", F.lit(0.0)))
    hits = [F.col("f")[i] if c is None else F.when(c, F.col("f")[i]).otherwise(F.lit(0)) for i, c in enumerate(when)]
    score = sum((idf(n_docs, F.col(f"s.n{i}")) * term_score(f, F.col("dl"), avgdl) for i, f in enumerate(hits)), F.lit(0.0))
    return row.select(*keys, (-score).alias("bm25"))


def candidates_from_postings(posts: DataFrame, plan: Plan, keys: tuple[str, ...] = ("session_id", "idx")) -> tuple[DataFrame, Positions]:
    """``keys``, dl and the places of the plan's tokens in each event that holds any of them, from postings alone; and how to read them."""
    at = Positions(plan)
    if not at.asked:
        return posts.select(*keys, "dl").limit(0), at
    # Dealt by the first key, which later steps group by too; by number, so that few bytes of many texts are not put in one task.
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = posts.filter(reduce(lambda a, b: a | b, [at.wanted(k) for k in at.asked])).select(*keys, "dl", "term", "positions").repartition(n, keys[0])
    exact = [len(words) == 1 and not prefix for words, prefix in at.asked]
    gathered = [F.flatten(F.collect_list(F.when(at.wanted(k), F.col("positions")))) for k in at.asked]
    return some.groupBy(*keys, "dl").agg(*[(g if e else F.array_sort(F.array_distinct(g))).alias(f"at{i}") for i, (g, e) in enumerate(zip(gathered, exact, strict=True))]), at
