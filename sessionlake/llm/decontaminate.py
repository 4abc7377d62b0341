"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

If an item's segment of ``n`` characters matches a place in a document within ``e`` edits, the two
share at least ``n + 1 - q - q*e`` q-grams (the q-gram lemma), and their diagonals
(document position less segment position) lie within ``e`` of each other. So q-grams shared by a
document and a segment are counted in bands of ``2e`` diagonals that overlap by half; a band below the
bound can't hold a match and is dropped; in the others an alignment confined to the
band's diagonals decides. Texts are compared lower-cased with each run of characters that are
neither letters nor digits as one space, so line breaks and punctuation don't hide a copy.

An item is cut in segments of ``SEGMENT`` characters that start every ``STRIDE`` (the last one ends with the item), so that
a document that holds any ``SEGMENT + STRIDE - 1`` characters of an item holds a whole segment. ``edits`` is the share of a segment's length that
may be edited. An item of fewer than ``MIN_CHARS`` normalised characters says too little for edits: it is one segment that matches only as it
stands, between spaces or the text's ends; items too short for a q-gram are looked up by the hash of all their characters.

The items' q-gram index is sent to every task in blocks of at most ``BLOCK_BYTES`` of item text: one pass over the documents
for each block, written before the next block is sent and destroyed after its pass, so no more than one block is held anywhere.

Cases: null and empty texts, and items without a letter or digit, match nothing; equal items each give their own rows;
repeated documents each give theirs; ``clean`` drops a matching document without an id as well, and of documents that
share an id only those that match. One row for each matched region of a document and an item: matches of an item's segments whose spans
touch or overlap are one region (very long texts are read whole, an empty table of either kind gives no rows, further columns of any name are not read), with its character span in the normalised text and the most edits of its segments.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import U64, Scratch, only, row_blocks, ship, trimmed, utf8, window_hashes

Q = 10
SEGMENT = 100
STRIDE = 50
MIN_CHARS = 40
EDITS = 0.08
BLOCK_BYTES = 4_000_000
FILTER_BITS = 22
_GAPS = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def spaced(text: str | None) -> str:
    """The normalised text between two spaces; empty if nothing is left of it."""
    clean = normalise(text)
    return f" {clean} " if clean else ""


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Segments of items and the places of their q-grams, sorted by hash."""

    def __init__(self, items: list[tuple[object, str | None]], q: int = Q, segment: int = SEGMENT, stride: int = STRIDE, edits: float = EDITS):
        self.q, self.items, self.segments, self.owner, budget = q, [i for i, _ in items], [], [], []
        self.whole: list[bool] = []  # segments that are a short item between spaces
        self.tiny: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}  # characters -> hash -> (item, characters)
        for k, (_, text) in enumerate(items):
            clean = normalise(text)
            if not clean:
                continue
            if len(clean) < MIN_CHARS:
                whole = _chars(f" {clean} ")
                if len(whole) < q:
                    self.tiny.setdefault(len(whole), {}).setdefault(int(window_hashes(whole, len(whole))[0]), []).append((k, whole))
                else:
                    self.segments.append(whole)
                    self.owner.append(k)
                    self.whole.append(True)
                    budget.append(0)
                continue
            starts = [0] if len(clean) <= segment else [*range(0, len(clean) - segment, stride), len(clean) - segment]
            for s in starts:
                part = _chars(clean[s : s + segment])
                self.segments.append(part)
                self.owner.append(k)
                self.whole.append(False)
                budget.append(int(edits * len(part)))
        self.budget = np.array(budget, np.int64)
        self.need = np.array([max(1, len(s) + 1 - q - q * e) for s, e in zip(self.segments, self.budget, strict=True)], np.int64)
        hashed = [window_hashes(s, q) for s in self.segments]
        h = np.concatenate(hashed) if hashed else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.seg = np.repeat(np.arange(len(hashed), dtype=np.int32), [len(x) for x in hashed])[order] if hashed else np.zeros(0, np.int32)
        self.pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hashed])[order] if hashed else np.zeros(0, np.int32)
        self.least = int(self.need.min()) if len(self.need) else None
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def matches(self, text: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of every region of one document's characters (between spaces), given their q-gram hashes."""
        return [r for item, found in self._segment_matches(text, h).items() for r in _regions(item, found)]

    def short(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same for items too short for a q-gram."""
        out = []
        for n, table in self.tiny.items():
            known = np.fromiter(table, U64, len(table))
            for at in np.flatnonzero(np.isin(h := window_hashes(text, n), known)).tolist():
                out += [(item, at, at + n - 2, 0) for item, whole in table[int(h[at])] if np.array_equal(text[at : at + n], whole)]
        return out

    def _segment_matches(self, text: np.ndarray, h: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        out: dict[int, list[tuple[int, int, int]]] = {}
        near = np.flatnonzero(self.seen[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(near):
            return out
        lo, hi = np.searchsorted(self.h, h[near], "left"), np.searchsorted(self.h, h[near], "right")
        n = hi - lo
        if not n.sum():
            return out
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        where, seg, pos = np.repeat(near, n), self.seg[at].astype(np.int64), self.pos[at].astype(np.int64)
        diagonal, e = where - pos, self.budget[seg]
        width = np.maximum(e, 1)
        # Bands of 2 * width diagonals that start at every multiple of width: each diagonal lies in two. One number names segment, band and place:
        # places are below a segment's length, bands within the text's length of either side.
        low = -(int(pos.max()) + 2)
        span = len(text) - low + 2
        band = np.floor_divide(diagonal, width) - low
        lane = seg * span + band
        deep = int(pos.max()) + 1
        # A segment's q-gram counts once in a band, however often the document repeats it.
        once = np.unique(np.concatenate([lane * deep + pos, (lane - 1) * deep + pos]))
        lanes, shared = np.unique(once // deep, return_counts=True)
        lanes = lanes[shared >= self.need[lanes // span]]
        found = np.stack([lanes // span, lanes % span + low], axis=1)
        if not len(found):
            return out
        order = np.lexsort((diagonal, seg))
        seg, diagonal = seg[order], diagonal[order]
        begin = np.searchsorted(seg, np.arange(len(self.segments) + 1)) if len(found) > 50 else None
        for s, b in found.tolist():
            e, w, part = int(self.budget[s]), max(int(self.budget[s]), 1), self.segments[s]
            x, z = (begin[s], begin[s + 1]) if begin is not None else (np.searchsorted(seg, s), np.searchsorted(seg, s + 1))
            own = diagonal[x:z]
            mine = own[np.searchsorted(own, b * w) : np.searchsorted(own, (b + 2) * w)]
            d = int(np.bincount(mine - mine[0]).argmax() + mine[0])
            if d >= 0 and d + len(part) <= len(text) and np.array_equal(text[d : d + len(part)], part):
                match = (d, d + len(part), 0)  # the alignment without edits
            elif e:
                cost, start, end = banded(part, text, b * w - e, (b + 2) * w + e, e)
                match = (start, end, cost) if cost <= e else None
            else:  # other diagonals of the band may hold it as it stands
                match = next(((d, d + len(part), 0) for d in np.unique(mine).tolist() if d >= 0 and np.array_equal(text[d : d + len(part)], part)), None)
            if match:
                start, end, cost = match
                # In the normalised text, which lacks the first space.
                out.setdefault(self.owner[s], []).append((start, end - 2, cost) if self.whole[s] else (max(0, start - 1), end - 1, cost))
        return out


def _regions(item: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that touch or overlap, as one."""
    out: list[list[int]] = []
    for start, end, edits in sorted(set(found)):
        if out and start <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], end), max(out[-1][2], edits)]
        else:
            out.append([start, end, edits])
    return [(item, *r) for r in out]


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Least edits of the whole pattern against any part of the text on diagonals low..high; its span.

    Row ``i`` holds the costs of pattern[:i] on each diagonal d = (text position - i). Cost ``most + 1`` stands for more.
    """
    n, width = len(pattern), high - low + 1
    far = most + 1
    d = np.arange(low, high + 1)
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    for i in range(1, n + 1):
        j = d + i  # the text's end position on each diagonal
        ok = (j >= 1) & (j <= len(text))
        same = np.zeros(width, bool)
        same[ok] = text[j[ok] - 1] == pattern[i - 1]
        new, begun = cost + ~same, start.copy()
        new[~ok] = far
        up = np.append(cost[1:], far) + 1  # pattern symbol without text: from the diagonal above
        better = up < new
        new[better], begun[better] = up[better], np.append(start[1:], 0)[better]
        if i == n or new.min() < far:
            # text symbol without pattern: along the row, from the lesser diagonal
            run = new - np.arange(width)
            least = np.minimum.accumulate(run)
            src = np.maximum.accumulate(np.where(run == least, np.arange(width), 0))
            new, begun = least + np.arange(width), begun[src]
        new[(j < 0) | (j > len(text))] = far
        cost, start = np.minimum(new, far), begun
        if cost.min() >= far:
            return far, 0, 0
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(d[k] + n)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """Rows (key, item, start, end, edits) of every region of a document that matches an item."""
    spark = docs.sparkSession
    ship(spark)
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {doc_kind}, `{item}` {item_kind}, start long, end long, edits long"
    rows, parts, scratch = only(docs, key, text), [], None
    blocks = _blocks(only(items, item, item_text))
    block = next(blocks, None)
    while block is not None:
        later = next(blocks, None)
        held = spark.sparkContext.broadcast(Index(block, edits=edits))  # at most BLOCK_BYTES of item text
        part = rows.mapInArrow(trimmed(_scan(held, key, item, docs.schema[key].dataType, items.schema[item].dataType)), schema)
        if later is not None or parts:  # several blocks: each goes before the next is sent
            scratch = scratch or Scratch(spark, "decontaminate")
            part = scratch.write(part, f"block{len(parts)}")
            held.destroy()
        parts.append(part)
        block = later
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _blocks(items: DataFrame):
    block, size = [], 0
    for row in items.toLocalIterator():  # a partition at a time
        n = len((row[1] or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _scan(held, key, item, key_type, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(key_type), to_arrow_type(item_type)]

    def run(batches):
        index: Index = held.value
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            texts = b.column(1)
            data, at = utf8(texts)
            for start, end in row_blocks(at, 1_000_000):
                clean = [spaced(t) for t in texts.slice(start, end - start).to_pylist()]
                chars = _chars("".join(clean))
                h = window_hashes(chars, index.q)
                edge = np.concatenate([[0], np.cumsum([len(c) for c in clean])])
                # A document with fewer known q-grams than any segment needs can't match.
                hit = np.concatenate([[0], np.cumsum(index.seen[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])])
                for k in range(end - start):
                    a, z = min(edge[k], len(h)), min(max(edge[k + 1] - index.q + 1, edge[k]), len(h))
                    own = chars[edge[k] : edge[k + 1]]
                    if index.least is not None and hit[z] - hit[a] >= index.least:
                        found += [(ids[start + k], index.items[m[0]], *m[1:]) for m in index.matches(own, h[a:z])]
                    if index.tiny:
                        found += [(ids[start + k], index.items[m[0]], *m[1:]) for m in index.short(own)]
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, [*kinds, pa.int64(), pa.int64(), pa.int64()], strict=True)], names=[key, item, "start", "end", "edits"])

    return run


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that match any item; a row is known by its id, or none, together with its text's hash."""
    hashed = F.xxhash64(docs[text])
    marked = docs.select(F.struct(docs[key].alias("id"), hashed.alias("h")).alias("__mark"), docs[text].alias("__text"))
    dirty = find(marked, items, "__mark", "__text", **how).select(F.col("__mark.id").alias("__dirty"), F.col("__mark.h").alias("__h")).distinct()
    return docs.join(dirty, docs[key].eqNullSafe(dirty["__dirty"]) & (hashed == dirty["__h"]), "left_anti")
