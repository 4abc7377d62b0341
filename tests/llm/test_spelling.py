"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sessionlake.llm import queries, spelling
from sessionlake.llm.common import Scratch


def counted(rows, least_chars=5, least_count=3, every=97):
    out = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_chars and n >= least_count}


def is_near(a, b):
    """By trying every edit's shape."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(words):
    """All pairs of words that share a neighbourhood key: the word or a deletion of it."""
    by = {}
    for w in words:
        for key in {w, *[w[:i] + w[i + 1 :] for i in range(len(w))]}:
            by.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(40)] + ["common" + x for x in ("", "s", "ly", "er")]
    out = []
    for i in range(n):
        words = [r.choice(stems[: 1 + int(r.random() ** 3 * len(stems))]) for _ in range(r.randrange(60))]
        for j in range(len(words)):
            if r.random() < 0.2 and len(words[j]) > 1:
                k = r.randrange(len(words[j]))
                words[j] = words[j][:k] + r.choice(["", "a", "b", "X", "é"]) + words[j][k + 1 :]
        out.append((r.choice([i, i, 3, None]), r.choice([" ", "-", "1"]).join(words)))
    return [*out, (None, None), (5, ""), (6, "z" * 3000 + " " + "z" * 2999), (6, "z" * 3000 + " " + "z" * 2999), (6, "z" * 3000 + " " + "z" * 2999)]


@pytest.mark.parametrize("segments", [50, 50_000])
def test_variants_equal_brute_force(spark, segments):
    rows = corpus(segments, 300)
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    words = counted(rows)
    got = rows_of(spelling.variants(df, segments=segments))
    assert len(words) > 90 and got == want(words)
    assert sum(v[3] for v in got.values()) > 300


def test_a_common_half_is_split_and_looked_up_by_deletions(spark):
    r = random.Random(2)
    words = list({"prefix" + "".join(r.choice("abc") for _ in range(6)) for _ in range(300)} | {"".join(r.choice("abc") for _ in range(6)) + "suffix" for _ in range(300)})
    words = {w: 3 + r.randrange(40) for w in words}
    table = Scratch(spark, "t").write(spark.createDataFrame(list(words.items()), "word string, n long"), "w")
    got = spelling.near(table, Scratch(spark, "t"), pairs=True, segments=20).collect()
    pairs = [(x["word"], x["near"]) for x in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if is_near(a, b)}
    assert all(x["near_n"] == words[x["near"]] for x in got)


def test_one_edit_on_all_short_words():
    from itertools import product

    every = ["".join(p) for n in range(5) for p in product("ab", repeat=n)]
    assert all(spelling.one_edit(a, b) == is_near(a, b) for a in every for b in every)


def test_long_chains_of_forms_end_at_their_root(spark):
    word = "abcdefghij"
    chain = [word[:i] + "z" * (10 - i) for i in range(11)]
    df = spark.createDataFrame([(c, 2 ** (i + 1)) for i, c in enumerate(chain)], "word string, n long")
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(links, Scratch(spark, "t")).collect()}
    assert got == dict.fromkeys(chain[:-1], chain[-1]) and df.count() == 11


def test_query_and_empty_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = counted([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(queries.op12_spelling_halves(spark, folder)) == want(words)
    assert spelling.variants(docs.limit(0)).count() == 0
