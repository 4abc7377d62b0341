"""Language identification by n-gram filters whose slots hold bitmasks of languages.

Bit plane ``l`` of the slot array is the Bloom filter of language ``l``'s n-grams, so the
AND of the slots that an n-gram hashes to names all languages that hold it, in one lookup
for all languages. A text's hits are counted by language (popcounts of the planes), the
share that the plane's false-positive rate explains is taken out, and the language with
the highest corrected share of the text's n-grams wins.

Training: whole texts of labelled rows, at most about ``per_lang`` for each language (an
even sample by a hash of id and text; a parameter). An n-gram belongs to a language if it makes up
``MIN_SHARE`` of that language's n-grams (so at most 1 / MIN_SHARE n-grams each, whatever
the corpus) and ``MIN_RATIO`` of its share in the language where it is most frequent.

Cases: null text or text without a letter is ``und`` with score 0; text whose n-grams no
language holds gets the language with most training rows and score 0; equal shares go to
the language with more training rows, then the lesser name; with no labelled rows every
text is ``und``. Texts are read whole, however long; an empty table gives no rows; a table's own columns of the names that are
added are replaced, unless other ``names`` are asked for. Rows keep their order of magnitude: one row out for each row in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import U64, mix, ship, trimmed

ORDERS = (3, 5)
MIN_SHARE = 1e-5
MIN_RATIO = 0.1
SLOT_BITS = 21
HASHES = 3
BLOCK = 300_000
_GAPS = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str | None) -> str:
    """Lower-cased runs of letters between single spaces; empty without letters."""
    words = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of ``order`` bytes (up to 8: packed without loss first)."""
    n = max(0, len(data) - order + 1)
    packed = np.zeros(n, U64)
    for j in range(order):
        packed |= data[j : j + n].astype(U64) << U64(8 * j)
    return mix(packed ^ U64(order << 56))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _blocks(texts: list[str | None]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Model:
    langs: list[str]  # by bit
    slots: np.ndarray  # bitmasks
    rates: np.ndarray  # false positives by language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of n-grams of each text."""
        names, scores, sizes = [], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in _blocks(texts):
            clean = [normalise(t) for t in texts[a:b]]
            if not self.langs:
                names += ["und"] * (b - a)
                continue
            share, sizes[a:b] = self._shares(clean)
            best = np.argmax(share, axis=1)
            has = np.array([bool(c) for c in clean])
            scores[a:b] = np.where(has, share[np.arange(b - a), best], 0.0)
            names += [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.clip(scores, 0.0, 1.0), sizes

    def _shares(self, clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, at = _joined(clean)
        hits, total = np.zeros((len(clean), len(self.langs))), np.zeros(len(clean))
        mask = U64(len(self.slots) - 1)
        for order in ORDERS:
            h = _grams(data, order)
            found = self.slots[(h & mask).astype(np.int64)]
            for k in range(1, HASHES):
                found &= self.slots[((h >> U64(SLOT_BITS * k)) & mask).astype(np.int64)]
            first, last = np.minimum(at[:-1], len(h)), np.minimum(np.maximum(at[1:] - order + 1, at[:-1]), len(h))
            total += last - first
            for k in range(len(self.langs)):
                plane = np.concatenate([[0], np.cumsum((found >> found.dtype.type(k)) & found.dtype.type(1), dtype=np.int64)])
                hits[:, k] += plane[last] - plane[first]
        share = hits / np.maximum(total, 1)[:, None]
        return np.maximum(0.0, (share - self.rates) / (1 - self.rates)), total


def train(labelled: DataFrame, per_lang: int = 4000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows' non-null ``lang`` values (64 at most)."""
    ship(labelled.sparkSession)
    rows = labelled.select(labelled[key].alias("k"), labelled[text].alias("t"), labelled[lang].alias("l")).filter("l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if len(langs) > 64:
        raise ValueError(f"{len(langs)} languages; a slot's bitmask holds 64")
    kind = np.dtype(next(f"u{w}" for w in (1, 2, 4, 8) if 8 * w >= len(langs)))
    slots = np.zeros(1 << SLOT_BITS, kind)
    if not langs:
        return Model([], slots, np.zeros(0))
    rate = F.lit(None).cast("double")
    for x in langs:
        rate = F.when(F.col("l") == x, F.lit(min(1.0, per_lang / counts[x]))).otherwise(rate)
    drawn = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 20)) < rate * (1 << 20)
    bit = {x: i for i, x in enumerate(langs)}

    def count(batches):
        for b in batches:
            texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, end in _blocks(texts):
                for x in set(names[start:end]):
                    data, at = _joined([normalise(t) for t, y in zip(texts[start:end], names[start:end], strict=True) if y == x])
                    for order in ORDERS:
                        h = _grams(data, order)
                        crosses = np.zeros(len(h) + order, bool)
                        for back in range(1, order):
                            crosses[np.maximum(at[1:-1] - back, 0)] = True
                        gram, n = np.unique(h[~crosses[: len(h)]], return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(gram), bit[x], np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["l", "gram", "n"])

    grams = rows.filter(drawn).select("t", "l").mapInArrow(trimmed(count), "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("l").agg(F.sum("n").alias("total"))
    share = grams.join(F.broadcast(totals), "l").filter((F.col("n") >= 2) & (F.col("n") >= MIN_SHARE * F.col("total")))  # totals: a row for each language
    kept = share.select("l", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas()  # at most 1 / MIN_SHARE rows for each language
    if len(kept):
        most = kept.groupby("gram")["share"].transform("max")
        kept = kept[kept["share"] >= MIN_RATIO * most]
        h, mask = kept["gram"].to_numpy().view(U64), U64(len(slots) - 1)
        for k in range(HASHES):
            np.bitwise_or.at(slots, ((h >> U64(SLOT_BITS * k)) & mask).astype(np.int64), (kind.type(1) << kept["l"].to_numpy().astype(kind)))
    fill = np.array([((slots >> kind.type(i)) & kind.type(1)).mean() for i in range(len(langs))])
    return Model(langs, slots, np.minimum(fill**HASHES, 0.999))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_grams")) -> DataFrame:
    """``docs`` with the language, its score and the text's number of n-grams added under ``names`` (columns of those names are replaced)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots: 2**SLOT_BITS masks

    @F.pandas_udf("lang string, score double, grams long")
    def judge(texts: pd.Series) -> pd.DataFrame:
        langs, scores, sizes = held.value.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores, "grams": sizes})

    base = docs.drop(*names)
    found = base.select(F.struct(*[base[c] for c in base.columns]).alias("row"), judge(base[text]).alias("judged"))
    return found.select(*[F.col(f"row.`{c}`") for c in base.columns], *[F.col(f"judged.{k}").alias(n) for k, n in zip(("lang", "score", "grams"), names, strict=True)])


def held_out(key: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
