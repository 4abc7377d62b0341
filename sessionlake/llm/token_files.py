"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are encoded in ascending id order; their ids (each document ends with ``end``) follow each other in
sequences of ``length`` ids. A file holds record batches of ``BATCH`` sequences with two columns, ``ids`` (fixed-size list of
uint16, or uint32 for larger vocabularies) and ``mask`` (fixed-size list of booleans; false after the last id of a file), so any
sequence is an offset in a memory-mapped file, without a copy. Beside it an index file
gives each document's offset and number of ids. One task writes one range of ids to files of its own name; the manifest lists the files
of the tasks that finished, with the number of ids before each, so a retried task leaves nothing that is read.

Encoding is by the tokenizers library. A tokenizer whose parts are those of ``PARTS`` splits at white space, so each distinct run between
spaces is encoded once per worker and its ids kept in a bounded cache; strings of its added tokens in a text become those tokens, as the
library has it, and the text between them is encoded by runs. Any other tokenizer encodes whole texts. The tokenizer's file is sent with the job.

Cases: null text is empty (one id, ``end``); a null document id comes first; equal ids follow by their text's hash; empty tables
give an empty manifest and no documents; long documents run over as many sequences and batches as they need.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, partitions, send_file, sent_file, ship

LENGTH = 2048
BATCH = 64
CACHE = 800_000
TOGETHER = 500
MARKS = frozenset((b".", b",", b"!", b"?", b";", b":"))
BLOCK = 2_000_000


#: The parts of a tokenizer file for which runs between spaces can be encoded one by one.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
PLAIN_TOKEN = {"special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


class Encoder:
    """Ids of texts as arrays; ids of runs between spaces are kept.

    Runs are looked up with A-Z lower-cased, as the tokenizer does first; a run that ends with one mark after an ASCII letter or digit is the
    run without it and the mark, as the tokenizer's pattern never joins them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        added, model = parts["added_tokens"], parts["model"]
        self.by_runs = (
            all(parts.get(k) == v for k, v in PARTS.items())
            and all(t[k] == v for t in added for k, v in PLAIN_TOKEN.items())
            and (model["type"], model.get("dropout"), model.get("end_of_word_suffix")) == ("BPE", None, "</w>")
        )
        # Added tokens are parted from the text below; a run that looks like one only once it is lower-cased is text.
        self.tokenizer.encode_special_tokens = self.by_runs
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache: dict[bytes, bytes] = {b"": b""}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_runs:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.added)]
        if not marked:
            return self._between(texts)
        # Text, added token, text, ...: the library parts a text there first.
        pieces = {i: self.marks.split(texts[i]) for i in marked}
        out = self._between([*[t if i not in pieces else "" for i, t in enumerate(texts)], *[p for parts in pieces.values() for p in parts[::2]]])
        at = len(texts)
        for i, parts in pieces.items():
            ids = out[at : at + len(parts[::2])]
            at += len(ids)
            tokens = [np.array([self.added[m]], self.kind).tobytes() for m in parts[1::2]]
            out[i] = b"".join(x for pair in itertools.zip_longest(ids, tokens, fillvalue=b"") for x in pair)
        return out[: len(texts)]

    def _between(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().lower().replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {b"": b""}
        cache = self.cache
        new = dict.fromkeys(x for s in split for x in s if x not in cache)
        parts = [(x, x[:-1], x[-1:]) for x in new if x[-1:] in MARKS and x[-2:-1].isalnum()]
        whole = [x for x in new if not (x[-1:] in MARKS and x[-2:-1].isalnum())]
        whole += dict.fromkeys(y for p in parts for y in p[1:] if y not in cache and y not in new)
        cache.update(zip(whole, self._encode([x.decode() for x in whole]), strict=True))
        late = []
        for x, core, mark in parts:
            if core in cache and mark in cache:
                cache[x] = cache[core] + cache[mark]
            else:  # the core ends with a mark of its own
                late.append((x, core, mark))
        for x, core, mark in sorted(late, key=lambda p: len(p[0])):
            cache[x] = cache[core] + cache[mark]
        return [b"".join(map(cache.__getitem__, s)) for s in split]

    def _encode(self, runs: list[str]) -> list[bytes]:
        """Ids of each run. Runs of letters are one word each, so many are encoded as one text and parted at the ends of words."""
        out: list[bytes] = [b""] * len(runs)
        words = [i for i, r in enumerate(runs) if r.isalpha()]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        rest = [i for i, r in enumerate(runs) if not r.isalpha()]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(runs[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(group):
                rest += group
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            for i, a, z in zip(group, [0, *end.tolist()], end.tolist()):
                out[i] = raw[a * size : z * size]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([runs[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """Packs ids into one file of fixed-size sequences and one index file."""

    def __init__(self, where: fs.FileSystem, path: str, kind: np.dtype, length: int, key: pa.DataType):
        ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.kind, self.length = kind, length
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", key), ("offset", pa.int64()), ("n", pa.int64())])
        self.sinks = [where.open_output_stream(path), where.open_output_stream(path + ".index")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held, self.size, self.total, self.docs = [], 0, 0, 0

    def add(self, keys: pa.Array, ids: list[bytes]) -> None:
        n = np.array([len(x) // self.kind.itemsize for x in ids], np.int64)
        offsets = self.total + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([keys, pa.array(offsets), pa.array(n)], schema=self.index_schema))
        self.held += ids
        self.size += int(n.sum())
        self.total += int(n.sum())
        self.docs += len(n)
        if self.size >= BATCH * self.length:
            self._flush(self.size // (BATCH * self.length) * BATCH * self.length)

    def _flush(self, n: int) -> None:
        joined = np.frombuffer(b"".join(self.held), self.kind)
        for x in range(0, n, BATCH * self.length):
            part = joined[x : x + BATCH * self.length]
            full = -(-len(part) // self.length) * self.length
            ids, mask = np.zeros(full, self.kind), np.zeros(full, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
            self.data.write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.size = [joined[n:].tobytes()], len(joined) - min(n, len(joined))

    def close(self) -> None:
        if self.size:
            self._flush(self.size)
        for x in (self.data, self.index, *self.sinks):
            x.close()


class Reader:
    """Random access to a file's sequences and documents."""

    def __init__(self, where: fs.FileSystem, path: str):
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.index = pa.ipc.open_file(pa.memory_map(path + ".index") if local else where.open_input_file(path + ".index"))
        self.length = self.file.schema.field("ids").type.list_size
        self._last = (-1, None)

    def batch(self, i: int) -> np.ndarray:
        """The ids of batch ``i``, a view of the file where that is mapped."""
        if self._last[0] != i:
            self._last = (i, self.file.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.file.get_batch(i // BATCH)
        return b.column(0)[i % BATCH].values.to_numpy(), b.column(1)[i % BATCH].values.to_numpy(zero_copy_only=False)

    def document(self, offset: int, n: int) -> np.ndarray:
        per, parts = BATCH * self.length, []
        while n > 0:
            b, at = divmod(offset, per)
            part = self.batch(b)[at : at + n]
            parts.append(part)
            offset, n = offset + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def documents(self):
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


_FILES = "part int, path string, docs long, tokens long"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Writes the files into ``folder`` (a URI that all executors reach) and returns the manifest (part, path, docs, tokens)."""
    spark = docs.sparkSession
    ship(spark)
    sent = send_file(spark, tokenizer)

    def run(batches):
        batches = iter(batches)
        head = next((b for b in batches if len(b)), None)
        if head is None:
            return
        enc = encoder(sent_file(sent))
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        path = f"{base}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
        out = Writer(where, path, enc.kind, length, head.schema.field(0).type)
        stop = np.array([end], enc.kind).tobytes()
        for b in itertools.chain([head], batches):
            texts = b.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate([*texts, None]):
                size += len(t or "")
                if i == len(texts) or size > BLOCK:
                    stopped = min(i + 1, len(texts))
                    if stopped > start:
                        out.add(b.column(0).slice(start, stopped - start), [x + stop for x in enc.encode(texts[start:stopped])])
                    start, size = stopped, 0
        out.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([out.docs], pa.int64()), pa.array([out.total], pa.int64())], names=["part", "path", "docs", "tokens"])

    some = docs.select(docs[key].alias("k"), docs[text].alias("t")).withColumn("th", F.xxhash64("t"))
    ranged = some.repartitionByRange(partitions(spark), "k", "th").sortWithinPartitions("k", "th").select("k", "t")
    return Scratch(spark, "tokens").write(ranged.mapInArrow(run, _FILES), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str, key_type: str = "long", key: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``key``, start, n_tokens, ids_crc32."""
    ship(spark)
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each file
        files.append((r["path"], start))
        start += r["tokens"]

    def run(batches):
        where, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = Reader(where, path)
                for part in reader.documents():
                    offsets, n = part.column(1).to_pylist(), part.column(2).to_pylist()
                    crc = [zlib.crc32(reader.document(o, k).astype("<u4").tobytes()) for o, k in zip(offsets, n, strict=True)]
                    yield pa.record_batch([part.column(0), pa.array([base + o for o in offsets], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return table.mapInArrow(run, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Writes the documents to the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = Scratch(spark, "tokens").path("files")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    return read(spark, write(docs, folder, tokenizer, end, key, text, length), folder, docs.schema[key].dataType.simpleString(), key)
