"""Near-duplicate classes by DartMinHash signatures and banded joins.

A document is a weighted set: its shingles of ``SHINGLE`` words (lower-cased runs of word characters),
each weighted by how often it occurs. Darts fall on the plane of an element's weight and rank as a Poisson process
that the element's hash alone decides, region by region of the weight axis ([0,1), [1,2), [2,4), ...). A document
takes the darts within its own weights and below a rank bound set so that about ``k (ln k + 4)`` fall, hashes
each to one of ``k`` coordinates and keeps the earliest per coordinate; a document with an
empty coordinate doubles its bound. Two documents agree in a coordinate with a chance equal to their weighted Jaccard
likeness, whatever their sizes, and the work is the number of elements plus the number of darts.

``BANDS`` bands of ``ROWS`` coordinates make buckets. Copies of one text are one node. In each bucket, every node is first held
against the bucket's lead only (the node that shares most over all its buckets; a star, not all pairs), its best lead by agreeing coordinates is verified on the shingles,
and links become classes. Only nodes that share a bucket and are still in different classes are looked at again:
against a further lead per bucket while such pairs are many and each turn halves them, then every such pair, on signatures and on the
least ``SKETCH`` element hashes (which tell the exact likeness of shorter texts), in blocks: the nodes
outside the bucket's largest class, ``FEW`` at a time, against all, ``SIDE`` at a time. So a pair that shares a bucket is either in one class or
was compared. A pair at likeness 0.8 shares no bucket with a chance of 3e-6. Blocks of a bucket with many classes would grow with the square
of its size, so one with more than ``BIG`` open nodes is dealt to ``TABLES`` finer buckets a node first, by ``FINER`` further coordinates each, and these
go through the same turns and blocks; a pair at 0.8 shares none of them with a chance of 1e-5.

A link is a weighted Jaccard likeness of at least ``THRESHOLD``; pairs whose signatures agree in fewer than
``LEAST_AGREE`` of the coordinates are not read again (0.8 or more agrees in fewer with a chance below 1e-5).

Cases: null text is empty; texts without words are alike only when equal; a text of fewer than ``SHINGLE`` words has one
shingle of all its words; rows that share an id are one document; a null id is named by its text's hash (negative);
an empty table gives no rows; further columns play no part. Ids may be of any type: where they are not whole numbers, nodes are
their hashes, and a class is named by one of its ids (``null:`` and the text's hash if that is null).
"""

from __future__ import annotations

import random
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegralType

from .common import U64, Scratch, mix, ship, trimmed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
LEAST_AGREE = 0.62
BLOCK = 400_000
MOST_TEXTS = 300
MANY = 2
FEW, SIDE = 512, 2048
SKETCH = 256
SKETCH_SLACK = 0.11
BIG = 20_000
TABLES, FINER = 63, 8
SEEN = 1_000_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_GAPS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(256, dtype=U64) + U64(99))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, U64)
    one[1:] = U64(_BASE)
    up = np.multiply.accumulate(one)
    one[1:] = U64(pow(_BASE, -1, 1 << 64))
    return up, np.multiply.accumulate(one)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, shingle's hash of 44 bits, count): the distinct shingles of up to 2^20 texts, in order."""
    clean = [f" {_GAPS.sub(' ', (t or '').lower()).strip()}" for t in texts]
    raw = [c.encode() if len(c) > 1 else b"" for c in clean]
    data = np.frombuffer(b"".join(raw), np.uint8)
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z.astype(U64), z
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    space = np.flatnonzero(data == 32)  # one before each word
    end = np.append(space[1:], len(data))
    up, down = _powers(1 << int(len(data)).bit_length())
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=U64)])
    word = mix((total[end] - total[space + 1]) * down[space + 1])
    first = np.searchsorted(space, edges)  # words of text i: first[i] .. first[i + 1]
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = np.zeros(len(at), U64)
    padded = np.concatenate([word, np.zeros(size, U64)])
    for j in range(size):
        h = h * U64(_BASE) + np.where(j < count[text], padded[at + j], U64(j + 1))
    keyed, times = np.unique((text.astype(U64) << U64(44)) | (mix(h) >> U64(20)), return_counts=True)
    return (keyed >> U64(44)).astype(np.int64), keyed << U64(20), times


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash of ``n`` weighted sets given as (set, element, weight > 0) rows: an [n, k] array of dart names; 0 for empty sets."""
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(text, weight, minlength=n)
    bound = np.divide(k * (np.log(k) + 4), total, out=np.zeros(n), where=total > 0)
    left = total > 0
    while left.any():
        some = left[text]
        name, coord, rank, owner = _darts(text[some], element[some], weight[some], bound, k)
        key = owner * k + coord
        order = np.argsort(key + rank / bound[owner])  # by coordinate, then by rank
        key = key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        got = order[first]
        out[owner[got], coord[got]] = np.maximum((name[got] >> U64(32)).astype(np.uint32), 1)
        filled = np.bincount(key[first] // k, minlength=n)
        left = left & (filled < k)
        bound = bound * 2
    return out


def _darts(text, element, weight, bound, k):
    """Darts (name, coordinate, rank, set) below each set's rank bound and within each element's weight."""
    names, coords, ranks, owners = [], [], [], []
    low, width, level = 0.0, 1.0, 0
    while True:
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        e, t, w, r = element[some], text[some], weight[some], np.zeros(len(some))
        i = 0
        while len(e):
            h = mix(e ^ mix(np.full(1, level << 32 | i, U64)))
            r = r - np.log(((h >> U64(12)).astype(np.float64) + 1) / (1 << 52)) / width
            live = r < bound[t]
            e, t, w, r, h = e[live], t[live], w[live], r[live], h[live]
            name = mix(h ^ U64(0x5851F42D4C957F2D))
            inside = w >= low + width
            if not inside.all():
                inside |= low + width * ((mix(name) >> U64(12)).astype(np.float64) / (1 << 52)) < w
            names.append(name[inside])
            coords.append(((name[inside] & U64(0xFFFFFFFF)) % U64(k)).astype(np.int64))
            ranks.append(r[inside])
            owners.append(t[inside])
            i += 1
        low, width, level = low + width, (width if level == 0 else width * 2), level + 1
    return np.concatenate(names), np.concatenate(coords), np.concatenate(ranks), np.concatenate(owners)


def sketches(text: np.ndarray, element: np.ndarray, times: np.ndarray, n: int, k: int = SKETCH) -> tuple[list[np.ndarray], np.ndarray]:
    """The ``k`` least 32-bit hashes of each set's elements, counted with their repeats, and how many there are in all."""
    total = np.bincount(text, times, minlength=n).astype(np.int64)
    owner, each = np.repeat(text, times), np.repeat(element, times)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    key = np.sort(owner.astype(U64) << U64(32) | mix(each + nth.astype(U64) * U64(_BASE)) >> U64(32))
    first = np.cumsum(total) - total
    low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : a + min(int(t), k)] for a, t in zip(first.tolist(), total.tolist(), strict=True)], total


def alike(mine: np.ndarray, n: int, others: list[np.ndarray], totals: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """Whether the others can be as like as THRESHOLD: exact where both sketches are whole, else an estimate less SKETCH_SLACK (4.5 deviations at 0.8)."""
    size = np.array([len(o) for o in others])
    edge = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(others) if len(others) else np.zeros(0, np.uint32)
    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    both = np.add.reduceat(np.append(hit, False).astype(np.int64), np.minimum(edge[:-1], len(flat))) * (size > 0)
    ok = both / np.maximum(n + totals - both, 1) >= THRESHOLD - 1e-9
    for i in np.flatnonzero((totals > k) | (n > k)):  # of the k least of the union, those in both
        union = np.union1d(mine, others[i])[:k]
        shared = np.isin(union, mine) & np.isin(union, others[i])
        ok[i] = shared.mean() >= THRESHOLD - SKETCH_SLACK
    return ok


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets of sorted distinct elements with weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _blocks(sizes):
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (size + n > BLOCK or i - start >= MOST_TEXTS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def _sign(batches):
    """Texts -> signatures, bands' buckets and sketches; a text that this task has signed already goes without."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        node, th1, th2 = b.column(0), b.column(1), b.column(2)
        new = np.zeros(len(b), bool)
        for i, pair in enumerate(zip(th1.to_pylist(), th2.to_pylist(), strict=True)):
            new[i] = pair not in seen
            seen.add(pair)
        if len(seen) > SEEN:
            seen.clear()
        places = np.flatnonzero(new)
        texts = b.column(3).take(pa.array(places))
        cols = [[None] * len(b) for _ in range(4)]
        for x, y in _blocks(pc.binary_length(texts).to_pylist()):
            t, e, w = shingles(texts.slice(x, y - x).to_pylist())
            sig = signatures(t, e, w.astype(np.float64), y - x)
            sketch, total = sketches(t, e, w, y - x)
            # A band's bucket; a set without elements has none.
            band = np.full((y - x, BANDS), U64(0xC0FFEE)) + np.arange(BANDS, dtype=U64)
            for r in range(ROWS):
                band = mix(band ^ sig[:, r::ROWS].astype(U64) * U64(_BASE))
            has = sig.any(axis=1).tolist()
            buckets = band.view(np.int64).tolist()
            for k, i in enumerate(places[x:y].tolist()):
                cols[0][i], cols[1][i], cols[2][i], cols[3][i] = sig[k].tobytes(), buckets[k] if has[k] else [], sketch[k].tobytes(), int(total[k])
        made = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64()), strict=True)]
        yield pa.record_batch([node, th1, th2, *made], names=["node", "th1", "th2", "sig", "bands", "sketch", "total"])


@F.pandas_udf(DoubleType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _verify(batches):
    """Pairs with their texts (u, v, tu, tv) -> the pairs that are alike enough."""
    for batch in batches:
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for x in range(0, len(batch), 200):
            part = batch.slice(x, 200)
            p, q = u[x : x + 200], v[x : x + 200]
            texts = dict(zip([*p, *q], [*part.column(2).to_pylist(), *part.column(3).to_pylist()], strict=True))
            at = {k: i for i, k in enumerate(texts)}
            t, e, w = shingles(list(texts.values()))
            cut = np.searchsorted(t, np.arange(len(texts) + 1))
            of = lambda k: (e[cut[at[k]] : cut[at[k] + 1]], w[cut[at[k]] : cut[at[k] + 1]])
            yield _pairs([(a, b) for a, b in zip(p, q, strict=True) if likeness(of(a), of(b)) >= THRESHOLD])


def _compare(batches):
    """Sorted rows of blocks -> pairs (u, v) of different classes that agree enough, each in the first band they share."""

    def block(rows):
        few = [r for r in rows if r[0]]
        if not few or len(few) == len(rows) == 1:
            return
        sigs = [np.frombuffer(b"".join(r[4] for r in some), np.uint32).reshape(len(some), -1) for some in (few, rows)]
        band = rows[0][1]
        roots = np.array([r[3] for r in rows])
        nodes = np.array([r[2] for r in rows])
        sketch, total = [np.frombuffer(r[5], np.uint32) for r in rows], np.array([r[6] for r in rows])
        for r, sig in zip(few, sigs[0], strict=True):
            near = (roots != r[3]) & (nodes != r[2])
            same = sigs[1][near] == sig
            ok = same.mean(axis=1) >= LEAST_AGREE
            ok[ok] = same[ok].reshape(int(ok.sum()), BANDS, ROWS).all(axis=2).argmax(axis=1) == band  # each pair in the first band it shares
            at = np.flatnonzero(near)[ok]
            if len(at):
                for other in nodes[at[alike(np.frombuffer(r[5], np.uint32), r[6], [sketch[i] for i in at], total[at])]].tolist():
                    yield max(r[2], other), min(r[2], other)

    rows, last = [], None
    for b in batches:
        out = []
        keys = list(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True))
        for key, *rest in zip(keys, *[b.column(i).to_pylist() for i in range(4, 10)], strict=True):
            if key != last and rows:
                out += block(rows)
                rows = []
            last = key
            rows.append((rest[0], key[0], *rest[1:]))
        yield _pairs(out)
    yield _pairs(list(block(rows)) if rows else [])


def _pairs(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 2
    return pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=["u", "v"])


def _cross(at: DataFrame, parts: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (u, v) of a bucket's nodes (b, h, node, root) in different classes whose signatures agree enough."""
    top = parts.groupBy("b", "h").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.sum("c").alias("n"), F.max("c").alias("most"))
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    rows = at.join(top, ["b", "h"]).withColumn("few", F.col("root") != F.col("top")).join(marks, "node")
    some, side = blocks(F.col("n") - F.col("most"), FEW), blocks(F.col("n"), SIDE)
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    # As one of the few: its block of the few, with every block of the rest; as one of the rest: its block, with every block of the few.
    asks = rows.filter("few").withColumn("i", own(some, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("asks", F.lit(True))
    told = rows.withColumn("j", own(side, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), some - 1))).withColumn("asks", F.lit(False))
    cols = ["b", "h", "i", "j", "asks", "node", "root", "sig", "sketch", "total"]
    both = asks.select(cols).unionByName(told.select(cols))
    return both.repartition("b", "h", "i", "j").sortWithinPartitions("b", "h", "i", "j").mapInArrow(trimmed(_compare), "u long, v long")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, root): the least node that links (u, v) reach, for every node in a link."""
    spark = edges.sparkSession
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct()
    both = scratch.write(both, f"{tag}-e0")
    roots, turn = None, 0
    while not both.isEmpty():
        turn += 1
        # Each node points to its least neighbour if that is less; chains are then halved until they end at roots.
        p = scratch.write(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), f"{tag}-p{turn}-0")
        jump = 0
        while True:
            up = p.select(F.col("u").alias("q"), F.col("p").alias("pp")).filter("q != pp")
            nxt = p.join(up, F.col("p") == F.col("q"), "left").select("u", F.coalesce("pp", "p").alias("p"), (F.col("pp").isNotNull() & (F.col("pp") != F.col("p"))).alias("moved"))
            jump += 1
            nxt = scratch.write(nxt, f"{tag}-p{turn}-{jump}")
            moved = not nxt.filter("moved").isEmpty()
            p = nxt.drop("moved")
            if not moved:
                break
        roots = p.select(F.col("u").alias("node"), F.col("p").alias("root")) if roots is None else roots.join(p, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = scratch.write(roots, f"{tag}-r{turn}")
        a, b = p.select("u", F.col("p").alias("pu")), p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        both = both.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u != v").distinct()
        both = scratch.write(both, f"{tag}-e{turn}")
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def _finer(at: DataFrame, reps: DataFrame) -> DataFrame:
    """(b, h, node): each node of large buckets in TABLES smaller ones, by FINER more coordinates."""
    r = random.Random(0)
    deals = []
    for t in range(TABLES):
        some = r.sample(range(BANDS * ROWS), FINER)
        deals.append(F.xxhash64("b", "h", F.lit(t), *[F.substring("sig", 4 * c + 1, 4) for c in some]))
    return at.select("b", "h", "node").join(reps.select("node", "sig"), "node").select("b", F.explode(F.array(*deals)).alias("h"), "node").distinct()


def _whole(docs: DataFrame, key: str) -> bool:
    return isinstance(docs.schema[key].dataType, IntegralType)


def _node(docs: DataFrame, key: str, t: Column) -> Column:
    """A number for each row's document: the id, or its hash; a null id's is its text's hash, and negative."""
    own = docs[key].cast("long") if _whole(docs, key) else F.abs(F.shiftright(F.xxhash64(docs[key].cast("string"), F.lit(7)), 1))
    return F.coalesce(F.when(docs[key].isNotNull(), own), -F.abs(F.shiftright(F.xxhash64(t), 1)) - 1)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", tag: str = "minhash") -> DataFrame:
    """One row per row: ``key``, class_id (the least id of its class), copy_of (the least id with the same text), links.

    ``links`` counts the verified links between its text and different ones; a class is held together by them, and pairs within a class that others
    link already are not all read.
    """
    spark = docs.sparkSession
    found = _found(docs, key, text, tag)
    if _whole(docs, key):
        return found.select(F.col("node").alias(key), "class_id", "copy_of", "links")
    t = F.coalesce(docs[text], F.lit(""))
    ids = docs.select(_node(docs, key, t).alias("n"), F.coalesce(docs[key].cast("string"), F.concat(F.lit("null:"), F.xxhash64(t).cast("string"))).alias("id"))
    ids = Scratch(spark, tag).write(ids.groupBy("n").agg(F.min("id").alias("id")), "ids")
    of = lambda name: ids.select(F.col("n").alias(name), F.col("id").alias(f"{name}_id"))
    named = found.join(of("node"), "node").join(of("class_id"), "class_id").join(of("copy_of"), "copy_of")
    own = F.when(F.col("node") >= 0, F.col("node_id")).cast(docs.schema[key].dataType)
    return named.select(own.alias(key), F.col("class_id_id").alias("class_id"), F.col("copy_of_id").alias("copy_of"), "links")


def _found(docs: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """(node, class_id, copy_of, links) of every row, as numbers."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, tag)
    t = F.coalesce(docs[text], F.lit(""))
    th1, th2 = F.xxhash64(t), F.xxhash64(F.lit(5), t)
    named = docs.select(_node(docs, key, t).alias("node"), th1.alias("th1"), th2.alias("th2"), t.alias("t"))
    signed = scratch.write(named.mapInArrow(trimmed(_sign), "node long, th1 long, th2 long, sig binary, bands array<long>, sketch binary, total long"), "signed")

    # Copies of one text are one node; each task signed a text once, and any of the signatures will do.
    made = [F.first(c, ignorenulls=True).alias(c) for c in ("sig", "bands", "sketch", "total")]
    reps = scratch.write(signed.groupBy("th1", "th2").agg(F.min("node").alias("node"), *made), "reps")
    members = scratch.write(signed.select("node", "th1", "th2").join(reps.select("th1", "th2", F.col("node").alias("rep")), ["th1", "th2"]).select("node", "rep"), "members")
    scratch.drop("signed")
    buckets = reps.select("node", F.posexplode("bands").alias("b", "h"))
    # Buckets of a single node hold no pair. A bucket's lead is the node that shares most in all its buckets: the text that others are edits of.
    shared = buckets.groupBy("b", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = scratch.write(buckets.join(shared, ["b", "h"]).select("b", "h", "node", "n"), "shared")
    held = held.join(held.groupBy("node").agg(F.sum("n").alias("degree")), "node")
    lead = held.groupBy("b", "h").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("lead"))
    held = scratch.write(held.join(lead, ["b", "h"]).select("b", "h", "node", "lead"), "held")
    sigs = reps.select("node", "sig")
    sides = lambda pairs: pairs.join(sigs.withColumnsRenamed({"node": "u", "sig": "su"}), "u").join(sigs.withColumnsRenamed({"node": "v", "sig": "sv"}), "v")

    stars = held.filter("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    rated = sides(stars).select("u", "v", _agree("su", "sv").alias("agree")).filter(F.col("agree") >= LEAST_AGREE)
    best = rated.groupBy("u").agg(F.max_by("v", F.struct("agree", -F.col("v"))).alias("v"))
    links = _links(scratch.write(best, "best"), named, scratch, "star")
    labels, verified = _label(reps, components(links, scratch, "c0"), scratch, "l0"), [links]

    turn, before, finer = 0, 0, False
    while True:
        turn += 1
        at = held.join(labels, "node").select("b", "h", "node", "root")
        parts = at.groupBy("b", "h", "root").agg(F.count(F.lit(1)).alias("c"))
        mixed = parts.groupBy("b", "h").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").withColumn("open", (F.col("n") * F.col("n") - F.col("sq")) / 2)
        mixed = scratch.write(mixed, f"mixed{turn}")
        size = mixed.agg(F.sum("open").alias("open"), F.sum("n").alias("n")).first()
        if not size["open"]:
            break
        at = scratch.write(at.join(mixed.select("b", "h"), ["b", "h"]), f"at{turn}")
        every = size["open"] <= MANY * size["n"] or before and size["open"] > before / 2
        before = size["open"]
        big = None
        if every:
            if not finer and not mixed.filter(F.col("n") > BIG).isEmpty():
                big = scratch.write(_finer(at.join(mixed.filter(F.col("n") > BIG).select("b", "h"), ["b", "h"]), reps), f"finer{turn}")
                mixed = mixed.filter(F.col("n") <= BIG)
                at = at.join(mixed.select("b", "h"), ["b", "h"])
            pairs = _cross(at, parts.join(mixed.select("b", "h"), ["b", "h"]), reps.select("node", "sig", "sketch", "total")).distinct()
        else:
            # A further lead for each bucket, by a hash that differs from turn to turn.
            lead = at.groupBy("b", "h").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("lead"))
            pairs = at.join(lead, ["b", "h"]).filter("root != lead.root").select(F.col("node").alias("u"), F.col("lead.node").alias("v")).distinct()
            pairs = sides(pairs).select("u", "v", _agree("su", "sv").alias("agree")).filter(F.col("agree") >= LEAST_AGREE).drop("agree")
        links = _links(scratch.write(pairs, f"pairs{turn}"), named, scratch, f"turn{turn}")
        verified.append(links)
        joined = links.join(labels.withColumnsRenamed({"node": "u", "root": "ru"}), "u").join(labels.withColumnsRenamed({"node": "v", "root": "rv"}), "v")
        merged = components(joined.select(F.col("ru").alias("u"), F.col("rv").alias("v")), scratch, f"c{turn}")
        labels = scratch.write(labels.join(merged.withColumnsRenamed({"node": "n", "root": "r"}), F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root")), f"l{turn}")
        if every and big is None:
            break
        if big is not None:
            held, before, finer = big, 0, True
    ends = reduce(DataFrame.unionByName, verified).distinct()
    ends = ends.select(F.col("u").alias("rep")).unionByName(ends.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(labels.withColumnsRenamed({"node": "rep", "root": "class_id"}), "rep")
    # One id with several texts is one document: its classes are one.
    split = out.groupBy("node").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).filter("u != v").select("u", "v")
    if not split.isEmpty():
        twin = components(split, scratch, "twin").withColumnsRenamed({"node": "n", "root": "r"})
        out = out.join(twin, F.col("class_id") == F.col("n"), "left").withColumn("class_id", F.coalesce("r", "class_id"))
    return out.join(ends, "rep", "left").select("node", "class_id", F.col("rep").alias("copy_of"), F.coalesce("links", F.lit(0)).alias("links"))


def _label(reps: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.write(reps.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), name)


def _links(pairs: DataFrame, named: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (u, v) whose texts are as alike as THRESHOLD asks."""
    need = scratch.write(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), f"{tag}-need")
    texts = scratch.write(named.join(need, F.col("node") == F.col("id")).select("node", "th1", "t").dropDuplicates(["node", "th1"]).drop("th1"), f"{tag}-texts")
    both = pairs.join(texts.withColumnsRenamed({"node": "u", "t": "tu"}), "u").join(texts.withColumnsRenamed({"node": "v", "t": "tv"}), "v")
    out = scratch.write(both.select("u", "v", "tu", "tv").mapInArrow(trimmed(_verify), "u long, v long").distinct(), f"{tag}-links")
    scratch.drop(f"{tag}-texts")
    return out


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document (the least id; one row of it) of each class."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = _found(docs, key, text, "minhash").groupBy(F.col("node").alias("__id")).agg(F.min("class_id").alias("c"), F.count(F.lit(1)).alias("n"))
    found = scratch.write(found.filter("__id = c").select("__id", "n"), "kept")
    named = docs.withColumn("__node", _node(docs, key, F.coalesce(docs[text], F.lit(""))))
    kept = named.join(found, F.col("__node") == F.col("__id"), "left_semi")
    again = found.filter("n > 1")
    if again.isEmpty():
        return kept.drop("__node")
    # By the node and not the key: rows without an id are one document only where their texts are equal.
    one = kept.join(again, F.col("__node") == F.col("__id"), "left_semi").dropDuplicates(["__node"])
    rest = kept.join(again, F.col("__node") == F.col("__id"), "left_anti")
    return rest.unionByName(one).drop("__node")
