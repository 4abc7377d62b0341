"""Byte-level BPE by a segment tree over byte positions.

A piece starts as one token per byte. Leaf ``i`` of its segment tree holds the key
``rank << SHIFT | i`` of the pair that token ``i`` makes with its live right neighbour
(or NONE); an inner node holds the lesser of its children, so the root is the leftmost pair
of least rank. A merge unlinks the right token and updates three leaves: the merged
position, its left neighbour and the removed one; each update walks log2(n) nodes.

Short pieces go through :func:`encode_many`, which keeps many trees of one height as rows of
an array and merges once in each row per step; long pieces through :func:`encode_long`,
the same tree in plain lists. Each distinct piece is encoded once per worker: the caches
are bounded and only spare work.

Cases: null or empty text has no ids; text that is not in the vocabulary falls back to its
single bytes, which every rank file holds (else ValueError). Decoding joins token bytes. Of pairs of equal rank the leftmost merges first; repeated rows, null and equal
ids each give their own row; very long pieces go through one tree each; an empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only, send_file, sent_file, ship, trimmed

NONE = np.int64(1 << 62)
SHIFT = 32
SHORT = 64
CACHE = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes by a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the single bytes")
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << SHIFT | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids, -1 where they don't merge."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, np.int64)
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        cap = 1 << max(0, (n - 1).bit_length())
        none, get = int(NONE), self.pairs.get
        tree = [none] * (2 * cap)
        for i in range(n - 1):
            if (r := get(ids[i] << SHIFT | ids[i + 1])) is not None:
                tree[cap + i] = r << SHIFT | i
        for i in range(cap - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            j = after[i]
            r = get(ids[i] << SHIFT | ids[j]) if j < n else None
            set_leaf(i, none if r is None else r << SHIFT | i)

        def set_leaf(i: int, key: int) -> None:
            i += cap
            tree[i] = key
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        while n > 1 and tree[1] != none:
            i = tree[1] & ((1 << SHIFT) - 1)
            j = after[i]
            ids[i] = tree[1] >> SHIFT
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            set_leaf(j, none)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    def encode_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of 1 to SHORT bytes; trees of one height advance together."""
        lengths = np.array([len(p) for p in pieces])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        low = 1
        while low <= SHORT:
            cap = low
            of = np.flatnonzero((lengths <= cap) & (lengths > cap // 2))
            low *= 2
            for part in range(0, len(of), 20_000):
                some = of[part : part + 20_000]
                if len(some):
                    self._trees(pieces, some, lengths[some], cap, out)
        return out

    def _trees(self, pieces: list[bytes], of: np.ndarray, lengths: np.ndarray, cap: int, out: list) -> None:
        rows = len(of)
        padded = b"".join(pieces[i].ljust(cap, b"\0") for i in of.tolist())
        inside = np.arange(cap)[None, :] < lengths[:, None]
        ids = np.where(inside, self.byte_ids[np.frombuffer(padded, np.uint8).reshape(rows, cap)], -1)
        after = np.broadcast_to(np.arange(1, cap + 1), (rows, cap)).copy()
        before = np.broadcast_to(np.arange(-1, cap - 1), (rows, cap)).copy()
        tree = np.full((rows, 2 * cap), NONE, np.int64)

        def keys(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[r, i]
            ok = j < lengths[r]
            rank = np.full(len(r), -1, np.int64)
            rank[ok] = self.rank_of(ids[r[ok], i[ok]], ids[r[ok], j[ok]])
            return np.where(rank >= 0, rank << SHIFT | i, NONE)

        def put(r: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
            node = i + cap
            tree[r, node] = key
            while node[0] > 1 if len(node) else False:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        if cap > 1:
            r, i = np.nonzero(inside[:, 1:])
            tree[r, cap + i] = keys(r, i)
            for node in range(cap - 1, 0, -1):
                tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
            live = np.flatnonzero(tree[:, 1] != NONE)
            while len(live):
                root = tree[live, 1]
                i = root & ((1 << SHIFT) - 1)
                j = after[live, i]
                ids[live, i] = root >> SHIFT
                ids[live, j] = -1
                beyond = after[live, j]
                after[live, i] = beyond
                more = beyond < lengths[live]
                before[live[more], beyond[more]] = i[more]
                put(live, j, np.full(len(live), NONE))
                put(live, i, keys(live, i))
                left = before[live, i]
                some = left >= 0
                put(live[some], left[some], keys(live[some], left[some]))
                live = live[tree[live, 1] != NONE]
        for row, i in enumerate(of.tolist()):
            out[i] = ids[row][ids[row] >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list({p for pieces in split for p in pieces if p not in cache})
        raw = [p.encode() for p in new]
        short = [i for i, p in enumerate(raw) if len(p) <= SHORT]
        for i, ids in zip(short, self.encode_many([raw[i] for i in short]), strict=True):
            cache[new[i]] = ids.astype("<u4").tobytes()
        for i, p in enumerate(raw):
            if len(p) > SHORT:
                cache[new[i]] = np.array(self.encode_long(p), "<u4").tobytes()
        get = cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def _blocks(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts.to_pylist():
        t = t or ""
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _results(docs: DataFrame, path: str, pattern: str, key: str, text: str, columns: dict) -> DataFrame:
    """``key`` and ``columns``: name -> (SQL type, Arrow type, function of (ids as bytes, decoded bytes))."""
    ship(docs.sparkSession)
    sent = send_file(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *columns]

    def run(batches):
        c = codec(sent_file(sent), pattern)
        for b in batches:
            for k, (ids, back) in zip(_keys(b), _round(c, b.column(1)), strict=True):
                made = [pa.array([f(x, y) for x, y in zip(ids, back, strict=True)], t) for _, t, f in columns.values()]
                yield pa.record_batch([k, *made], names=names)

    schema = ", ".join([f"`{key}` {kind}", *[f"{n} {t}" for n, (t, _, _) in columns.items()]])
    return only(docs, key, text).mapInArrow(trimmed(run), schema)


def _digests() -> dict:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "n_tokens": ("long", pa.int64(), lambda ids, back: len(ids) // 4),
        "ids_sha256": ("string", pa.string(), lambda ids, back: sha(ids)),
        "decoded_sha256": ("string", pa.string(), lambda ids, back: sha(back)),
        "n_bytes": ("long", pa.int64(), lambda ids, back: len(back)),
    }


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``key`` and the named columns of every row: ids (array of int), decoded (the bytes they decode to), and the digests."""
    columns = {
        "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, back: np.frombuffer(ids, "<u4").astype(np.int32)),
        "decoded": ("binary", pa.binary(), lambda ids, back: back),
    }
    return _results(docs, path, pattern, key, text, {n: (columns | _digests())[n] for n in names})


def digest_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256, n_bytes: :func:`encode_documents`, digested where it is made."""
    return _results(docs, path, pattern, key, text, _digests())


def _round(c: Codec, texts: pa.Array) -> Iterator[tuple[list[bytes], list[bytes]]]:
    for block in _blocks(texts):
        ids = c.encode(block)
        yield ids, [c.decode(x) for x in ids]


def _keys(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    start = 0
    for block in _blocks(batch.column(1)):
        yield batch.column(0).slice(start, len(block))
        start += len(block)
