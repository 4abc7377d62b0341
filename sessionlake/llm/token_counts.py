"""Token counts, with huge texts encoded in overlapping chunks that are spliced where both agree.

A text of up to ``STEP`` code points is encoded whole. A longer one is cut every ``STEP`` code points; a chunk runs on for ``OVERLAP`` beyond the next cut,
so chunks are rows of their own, dealt to all tasks. For each cut the two chunks report where the pieces of the tokenizer's pattern start in the overlap, and how
many tokens lie before; they are spliced at the first common start, and a text's tokens are the last chunk's plus, for each cut, those of the
left chunk less those of the right one before the splice. A cut without a common start gets ``WIDEN`` times the overlap in a further round, and goes, so that its
chunks become one, once the overlap would reach the next cut; the rounds are thus few, and touch only the texts in question.

Why a common start is stable: the byte-level pattern reads from left to right, covers every character and looks at most two characters ahead of a piece (a run of
blanks: one past its end), so what follows a start depends on the text behind it alone. Pieces that end within ``margin`` of a chunk's end, which is the
longest added token and the look-ahead, are not offered: the cut may have changed them. By induction over the cuts each chunk is right from its splice on.
This holds for tokenizers whose parts are those of ``PARTS``; any other (and every sentencepiece model) encodes whole texts.

Cases: null or empty text has no tokens; a null id, equal ids and repeated rows are counted row by row; very long texts without any start (one run of letters)
end as one chunk; an empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, only, partitions, send_file, sent_file, ship, trimmed

STEP = 16_384
OVERLAP = 256
WIDEN = 4
LOOK_AHEAD = 4
BLOCK = 1_000_000

#: The parts of a tokenizer file for which a common start of pieces is stable.
PARTS = {"normalizer": None, "truncation": None, "padding": None, "post_processor": None}
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


class Tokens:
    """Counts the tokens of texts, and finds where the pieces of a text start."""

    def __init__(self, path: str):
        self.margin = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        added, model, splitter = parts["added_tokens"], parts["model"], parts["pre_tokenizer"] or {}
        plain = all(parts.get(k) == v for k, v in PARTS.items()) and all(splitter.get(k) == v for k, v in SPLITTER.items()) and all(t[k] == v for t in added for k, v in PLAIN_TOKEN.items())
        if plain and (model["type"], model.get("dropout")) == ("BPE", None):
            self.margin = max((len(t["content"]) for t in added), default=0) + LOOK_AHEAD
        self.counts = lambda texts: [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Of each text: where its pieces start, how many tokens lie before each, and the number of all tokens."""
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            piece = np.array(e.word_ids, np.int64)
            first = np.flatnonzero(np.diff(piece, prepend=-1)) if len(piece) else piece
            yield np.array([a for a, _ in e.offsets], np.int64)[first], first, len(piece)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def cuts_of(length: int, known: list[tuple[int, int]] | None, step: int, overlap: int) -> list[tuple[int, int]]:
    """(place, overlap) of a text's cuts: at first every ``step``; a cut goes whose overlap reaches the next one or the text's end."""
    cuts = [(at, overlap) for at in range(step, length, step)] if known is None else known
    return [(at, w) for (at, w), after in zip(cuts, [*[a for a, _ in cuts[1:]], length], strict=True) if at + w <= after]


def count(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (more than ``limit``), n_chunks of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent, margin = send_file(spark, tokenizer), Tokens(tokenizer).margin
    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs, key, text).toDF("k", "t").select("k", F.coalesce("t", F.lit("")).alias("t"))
    rows = rows.withColumn("n_bytes", F.octet_length("t").cast("long"))

    def whole(batches):
        counts = tokens(sent_file(sent)).counts
        for b in batches:
            texts = b.column(2).to_pylist()
            n = [x for i, j in _blocks(texts) for x in counts(texts[i:j])]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([1] * len(n), pa.int64())], names=["k", "n_bytes", "n_tokens", "n_chunks"])

    shape = f"k {kind}, n_bytes long, n_tokens long, n_chunks long"
    if margin is None:
        found = rows.select("k", "n_bytes", "t").mapInArrow(trimmed(whole), shape)
    else:
        if overlap <= margin:
            raise ValueError(f"an overlap of {overlap} leaves nothing beyond the margin of {margin}")
        scratch = Scratch(spark, "token-counts")
        long = F.char_length("t") > step
        found = rows.filter(~long).select("k", "n_bytes", "t").mapInArrow(trimmed(whole), shape)
        huge = scratch.write(rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "k", "n_bytes", "t"), "huge")
        found = found.unionByName(huge.select("row", "k", "n_bytes").join(_spliced(huge, scratch, sent, margin, step, overlap), "row").drop("row"))
    return found.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


_CUTS = "array<struct<at:long,w:long>>"
_PLACES = pa.list_(pa.struct([("q", pa.int64()), ("n", pa.int64())]))


def _spliced(huge: DataFrame, scratch: Scratch, sent: str, margin: int, step: int, overlap: int) -> DataFrame:
    """row, n_tokens, n_chunks of each huge text; rounds of cutting, encoding and splicing, until all cuts agree."""

    def cut(batches):
        """row, i, at (the chunk's start), w (its overlap with the one before), stop (the next cut, null: none), text."""
        for b in batches:
            for row, t, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cuts = cuts_of(len(t), None if known is None else [(c["at"], c["w"]) for c in known], step, overlap)
                edges = [(0, 0), *cuts]
                for i, (at, w) in enumerate(edges):
                    stop, further = edges[i + 1] if i + 1 < len(edges) else (None, 0)
                    part = t[at:] if stop is None else t[at : stop + further]
                    values = ([row], pa.int64()), ([i], pa.int64()), ([at], pa.int64()), ([w], pa.int64()), ([stop], pa.int64()), ([part], pa.string())
                    yield pa.record_batch([pa.array(v, k) for v, k in values], names=["row", "i", "at", "w", "stop", "t"])

    def encode(batches):
        """A chunk's tokens, the piece starts in its overlap with the chunk before (left) and with the next (right)."""
        starts = tokens(sent_file(sent)).starts
        for b in batches:
            texts, at, w, stop = b.column(5).to_pylist(), *[b.column(c).to_pylist() for c in (2, 3, 4)]
            total, left, right = [], [], []
            for i, j in _blocks(texts):
                for x, (q, n, all_of_it) in enumerate(starts(texts[i:j]), i):
                    q = q + at[x]
                    some = lambda a, z, q=q, n=n: [{"q": int(u), "n": int(v)} for u, v in zip(q[a:z], n[a:z], strict=True)]
                    total.append(all_of_it)
                    left.append(some(0, np.searchsorted(q, at[x] + w[x])))
                    right.append([] if stop[x] is None else some(np.searchsorted(q, stop[x]), np.searchsorted(q, at[x] + len(texts[x]) - margin, side="right")))
            columns = [*[b.column(c) for c in range(5)], pa.array(total, pa.int64()), pa.array(left, _PLACES), pa.array(right, _PLACES)]
            yield pa.record_batch(columns, names=["row", "i", "at", "w", "stop", "total", "left", "right"])

    places = "array<struct<q:long,n:long>>"
    n, done, ask, turn = partitions(huge.sparkSession), [], huge.select("row", "t", F.lit(None).cast(_CUTS).alias("cuts")), 0
    while True:
        chunks = ask.mapInArrow(trimmed(cut), "row long, i long, at long, w long, stop long, t string").repartition(n, "row", "i")
        parts = scratch.write(chunks.mapInArrow(trimmed(encode), f"row long, i long, at long, w long, stop long, total long, left {places}, right {places}"), f"parts-{turn}")
        after = parts.select("row", (F.col("i") - 1).alias("i"), F.col("at").alias("next_at"), F.col("w").alias("next_w"), F.col("left").alias("next_left"))
        both = parts.join(after, ["row", "i"], "left")
        q = F.array_min(F.array_intersect(F.transform("right", lambda x: x["q"]), F.transform("next_left", lambda x: x["q"])))
        before = lambda places: F.get(F.filter(places, lambda x: x["q"] == F.col("splice")), 0)["n"]
        both = both.withColumn("splice", q).withColumn("n", F.when(F.col("next_at").isNull(), F.col("total")).otherwise(before("right") - before("next_left")))
        lost = F.col("next_at").isNotNull() & F.col("splice").isNull()
        width = F.when(lost, F.col("next_w") * WIDEN).otherwise(F.col("next_w"))
        cuts = F.array_sort(F.collect_list(F.when(F.col("next_at").isNotNull(), F.struct(F.col("next_at").alias("at"), width.alias("w")))))
        texts = scratch.write(both.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(lost).alias("lost"), cuts.alias("cuts")), f"texts-{turn}")
        done.append(texts.filter("lost = 0").select("row", "n_tokens", "n_chunks"))
        if texts.filter("lost > 0").isEmpty():
            break
        ask = huge.select("row", "t").join(texts.filter("lost > 0").select("row", "cuts"), "row")
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
