"""Sharding, URL filters, BPE, token files, language ID and decontamination on awkward rows."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow.fs as fs
import pytest
import regex
from pyspark.sql import functions as F

from sessionlake.llm import bpe, decontaminate, langid, sharding, token_files, urls

AWKWARD = ["", None, "a", "word " * 4000, "é日本😀\u0300 x", "\n\n  \t\r\n", "<|endoftext|> it's 12345 'll", "ab" * 3000, "same text", "same text", "ſtraße İI Σς"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3 - 5, t, "k", 1) for i, t in enumerate(AWKWARD)], "doc_id long, text string, ids string, start int")


# Sharding


def test_shards_fit_and_only_oversized_buckets_split(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(400), "hot" if i % 3 else f"s{i}") for i in range(600)] + [(1000 + i, "z" * 900, "hot") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keys in (("doc_id",), ("source",), ("source", "doc_id")):
        out = sharding.assign(df, 5000, keys).collect()
        assert len(out) == len(rows)
        size, parents = {}, {}
        for x in out:
            size[x["shard"]] = size.get(x["shard"], 0) + x["n_bytes"]
        assert max(size.values()) <= 5000
        for s in size:  # prefixes: no shard's bits begin another's, and every split was needed
            for k in range(len(s)):
                assert s[:k] not in size
                parents.setdefault(s[:k], 0)
        for x in out:
            for p in [x["shard"][:k] for k in range(len(x["shard"]))]:
                parents[p] += x["n_bytes"]
        assert all(b > 5000 for b in parents.values())


def test_copies_of_a_row_fill_pages_and_a_large_row_stands_alone(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 25 + [(2, "y" * 5000), (None, None)], "doc_id long, text string")
    out = sharding.assign(df, 1000).collect()
    size = {}
    for x in out:
        size[x["shard"]] = size.get(x["shard"], 0) + x["n_bytes"]
    assert len(out) == 27 and [x["doc_id"] for x in out if x["oversized"]] == [2]
    assert all(v <= 1000 for k, v in size.items() if k != next(x["shard"] for x in out if x["doc_id"] == 2))
    assert sharding.assign(df.limit(0), 1000).count() == 0


def test_many_splits_and_pages_equal_sql(spark):
    import duckdb

    from sessionlake.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "copy " * 300)] * 90 + [(-2, "")] * 50 + [(-3, "z" * 20_000)] * 3, "doc_id long, text string").repartition(5)
    some = docs.unionByName(extra)
    con = duckdb.connect()
    documents = some.toPandas()  # noqa: F841  read by the statement
    for limit in (8192, 65536):
        got = sorted(map(tuple, sharding.assign(some, limit).collect()), key=str)
        want = con.sql(f"SELECT doc_id, n_bytes, shard, local_depth, global_depth, oversized FROM ({queries.op1_sql(limit)})").fetchall()
        assert got == sorted(map(tuple, want), key=str) and len({r[2] for r in got}) > 30


def test_sharded_write_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    sharding.write(df, f"{tmp_path}/out", 300)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


# URL filters


def test_parts_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net", "example.net", "", None, None),
        ("x://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        ("h://x.org/fr/?a=://b/c", "x.org", "/fr/", "org/fr/", "allow"),
        ("h://É.net#x", "É.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("://", "", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], None, "z") for i, c in enumerate(cases)], "page_id long, url string, html string, words string")
    for x in urls.judge(df).collect():
        _, h, p, rule, verdict = cases[x["page_id"]]
        assert (x["host"], x["path"], x["rule"]) == (h, p, rule)
        assert x["verdict"] == verdict if rule else x["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def cheapest(s, run):
    """All splits, by their costs."""
    best = []
    for cuts in product([0, 1], repeat=len(run) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(run[start : i + 1])
                start = i + 1
        best.append((sum(s.cost(p) for p in parts), parts))
    return min(best)


def test_segments_are_the_cheapest(spark):
    r = random.Random(2)
    counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 4))): r.randrange(1, 30) for _ in range(12)}
    s = urls.Segmenter(counts)
    for _ in range(40):
        run = "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
        assert "".join(s.split(run)) == run and abs(sum(map(s.cost, s.split(run))) - cheapest(s, run)[0]) < 1e-9
    word = "donaudampfschifffahrtsgesellschaft"
    assert urls.Segmenter({word: 3}).split(word) == (word,) and urls.Segmenter({}).split("x" * 3000) == ("x" * 3000,)
    assert urls.Segmenter({"casino": 2, "win": 1}).words("casinowin", "/a1/22") == ["casino", "win", "a", "#", "#"]


def test_verdicts_against_brute_force(spark):
    """The whole query again in plain Python: parts, rules, word counts, splits and scores."""
    r = random.Random(4)
    words = ["cheap", "pills", "news", "casino", "win", "the", "day", "zq"]
    hosts = ["".join(r.choice(words) for _ in range(r.randrange(1, 3))) + r.choice(["", ".org", ".com", ".example.net", "-x.de"]) for _ in range(40)]
    rows = [(i, f"http://{h}{r.choice(['', '/en/', '/fr/a', '/casino/7', '?q'])}", "<p>" + " ".join(r.choice(words[:7]) for _ in range(30)) + "</p>") for i, h in enumerate(hosts)]
    rows += [(100, None, None), (101, "no", "<b>")]
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    counts = Counter(w for _, _, t in rows for w in regex.findall(r"\p{L}+", regex.sub("<[^>]*>", " ", (t or "").lower())))
    s = urls.Segmenter(dict(counts))

    def tokens(h, p):
        return [w for part in (h.rpartition(".")[0] or h, p) for run in regex.findall(r"\p{L}+|\p{N}+", part.lower()) for w in (cheapest(s, run)[1] if run.isalpha() else ["#"])]

    parts = {}
    for i, u, _ in rows:
        _, found, rest = (u or "").partition("://")
        h = regex.split("[/?#]", rest)[0].lower() if found else ""
        parts[i] = (h, regex.split("[?#]", rest[len(h) :])[0] if found else "")
    background = Counter(w for h, _ in parts.values() for w in tokens(h, ""))
    fitting = {i: [(len(a + b), a + b, v) for v, a, b in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)] for i, (h, p) in parts.items()}
    examples = {v: Counter(w for i, (h, p) in parts.items() if fitting[i] and max(fitting[i])[2] == v for w in tokens(h, p)) for v in ("block", "allow")}
    known = examples["block"].keys() | examples["allow"].keys() | background.keys()
    mass = {w: urls.MASS * (background[w] + 1) / (sum(background.values()) + len(known)) for w in known}
    for i, (h, p) in parts.items():
        fits = fitting[i]
        odds = 0.0
        for w in tokens(h, p):
            if w in known:
                odds += math.log((examples["block"][w] + mass[w]) / (examples["block"].total() + urls.MASS)) - math.log((examples["allow"][w] + mass[w]) / (examples["allow"].total() + urls.MASS))
        assert got[i] == (h, p, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if odds > 0 else "allow"), (i, odds)
    assert {v for _, _, r, v in got.values() if r is None} == {"block", "allow"}


def test_a_table_of_labels_trains_the_model(spark):
    pages = spark.createDataFrame([(1, "http://redhat.org/x", "red hat blue cap"), (2, "http://bluecap.org", "red hat")], "page_id long, url string, html string")
    labels = spark.createDataFrame([("http://red.org/hat", "block"), ("http://cap.org/blue", "allow")] * 30, "url string, verdict string")
    judged = urls.judge(pages, labelled=labels)
    assert {x["page_id"]: (x["verdict"], x["words"]) for x in judged.collect()} == {1: ("block", "red hat x"), 2: ("allow", "blue cap")}
    assert [tuple(x) for x in urls.agreement(judged).collect()] == [(None, 2, 1)]


def test_the_rules_verdicts_carry_over_to_other_hosts(spark):
    """Rows that a rule decides train the model; hosts and paths of the same words are judged alike, repeated rows one by one."""
    rows = [(i, f"http://{h}.example.{z}/{p}/{i}", "<p>the news of the day, poker and slots</p>") for i, (h, z, p) in enumerate([("poker", "net", "a"), ("slots", "net", "b"), ("thenews", "org", "fr"), ("theday", "org", "fr")] * 20)]
    asked = [(900, "http://pokerslots.example.com/x", None), (901, "http://newsday.example.com/x", None), (902, "http://newsday.example.com/x", None), (903, "http://unheard.example.com/", None)]
    df = spark.createDataFrame(rows + asked, "page_id long, url string, html string")
    got = {x["page_id"]: (x["verdict"], x["rule"], x["words"]) for x in urls.judge(df).collect()}
    assert got[900] == ("block", None, "poker slots example x") and got[901] == got[902] == ("allow", None, "news day example x")
    assert len(got) == len(rows) + len(asked)


def test_quality_is_of_hosts_not_trained_on(spark):
    rows = [(i, f"http://h{i}.{h}.example.{z}/{p}/", "poker news") for i, (h, z, p) in enumerate([("poker", "net", "x"), ("news", "org", "fr")] * 100)]
    got = {x["verdict"]: (x["n"], x["right"]) for x in urls.quality(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.keys() == {"block", "allow"} and all(20 < n < 80 and right == n for n, right in got.values())


# BPE


def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = reference(bpe.load_ranks(path))
    for x in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect():
        t = AWKWARD[(x["doc_id"] + 5) // 3] or ""
        assert x["ids"] == want.encode_ordinary(t) and bytes(x["decoded"]) == t.encode()
    assert bpe.digest_documents(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_both_trees_merge_leftmost_least_pairs():
    r = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 330:
        a, b = r.choice(list(ranks)[97:100] + list(ranks)[256:]), r.choice(list(ranks)[97:100] + list(ranks)[256:])
        ranks.setdefault(a + b, len(ranks))
    c = bpe.Codec(ranks, r"(?s).+")
    for _ in range(200):
        piece = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 65)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[p] for p in parts]
        assert c.encode_long(piece) == want and c.encode_many([piece])[0].tolist() == want


# Token files


def test_token_files_equal_the_library(spark, docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(((i * 3 - 5), t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in enumerate(AWKWARD))
    want, start = [], 0
    for i, ids in rows:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.round_trip(docs, path, 2, length=8)
    assert sorted(map(tuple, got.collect())) == want
    manifest = token_files.write(docs, f"file://{tmp_path}/f", path, 2, length=8)
    flat = []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        reader = token_files.Reader(fs.LocalFileSystem(), r["path"])
        n = -(-r["tokens"] // 8)
        for i in range(n):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 8 and mask.sum() == min(8, r["tokens"] - 8 * i)
            flat += ids[mask].tolist()
    assert flat == [x for _, ids in rows for x in ids]
    assert token_files.round_trip(docs.limit(0), path, 2).count() == 0


def test_added_tokens_and_other_tokenizers_as_the_library_has_them():
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    t, enc = Tokenizer.from_file(path), token_files.Encoder(path)
    assert enc.by_runs and np.frombuffer(enc.encode(["a <|endoftext|> b"])[0], enc.kind).tolist() == [320, 49407, 321]
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "A", "é", "e\u0301", "it's", "don't.", "12", "!?", "日本", "\u3000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(500)]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    other = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_runs and [np.frombuffer(x, other.kind).tolist() for x in other.encode(texts)] == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


# Language ID


def language_rows(n, seed=5):
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "and", "tion"], "de": ["ung", "sch", "ein", "ß"], "fr": ["eau", "é", "oi", "ç"]}
    return [(i, " ".join("".join(r.choice(parts[x]) for _ in range(3)) for _ in range(40)), x) for i in range(n) for x in [r.choice(list(parts))]]


def test_language_of_held_out_documents(spark):
    rows = language_rows(400) + [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "ZZZZ", "fr")]
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    flags = {x["doc_id"]: x["h"] for x in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in flags)
    model = langid.train(df.filter(~langid.held_out()))
    out = {x["doc_id"]: x for x in langid.predict(df.select("doc_id", "text", "lang", "lang_pred"), model).collect()}
    held = [x for x in rows[:400] if flags[x[0]]]
    assert held and all(out[i]["lang_pred"] == x for i, _, x in held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["lang_score"] == 0 for i in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] in ("en", "de", "fr") and all(0 <= x["lang_score"] <= 1 for x in out.values())
    none = langid.train(df.filter("lang is null"))
    assert {x["lang_pred"] for x in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_filters_hold_every_kept_ngram():
    model = langid.Model(["a", "b"], np.zeros(1 << langid.SLOT_BITS, np.uint8), np.zeros(2))
    data, _ = langid._joined([langid.normalise("Hallo Welt")])
    for order in langid.ORDERS:
        h = langid._grams(data, order)
        for k in range(langid.HASHES):
            model.slots[((h >> np.uint64(langid.SLOT_BITS * k)) & np.uint64(len(model.slots) - 1)).astype(np.int64)] |= 2
    names, scores, sizes = model.predict(["hallo, WELT!", "quite another text", ""])
    assert names[0] == "b" and scores[0] == 1.0 and scores[1] < 0.2 and sizes.tolist() == [10 + 8, 20 - 2 + 20 - 4, 0]


def test_language_query_against_exact_sets(spark, tmp_path):
    """The whole query with plain sets of n-grams in place of filters: the same languages, scores within the filters' errors."""
    from sessionlake.llm import queries

    rows = language_rows(240, 17) + [(500, None, "en"), (501, "?!", "de"), (502, "the ung eau " * 3, None), (503, "xyzzy " * 5, "fr"), (504, "the " * 60_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = lambda t: [t.encode()[i : i + k] for k in langid.ORDERS for i in range(len(t.encode()) - k + 1)]
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    counts = {}
    for i, t, x in rows:
        if x is not None and not out[i]:
            counts.setdefault(x, Counter()).update(grams(langid.normalise(t)))
    share = {x: {g: n / c.total() for g, n in c.items() if n >= 2 and n >= langid.MIN_SHARE * c.total()} for x, c in counts.items()}
    most = {}
    for c in share.values():
        for g, v in c.items():
            most[g] = max(most.get(g, 0), v)
    sets = {x: {g for g, v in c.items() if v >= langid.MIN_RATIO * most[g]} for x, c in share.items()}
    docs = dict((x[0], x[1]) for x in rows)
    for r in queries.op8_language_bitmask(spark, str(tmp_path)).collect():
        mine = grams(langid.normalise(docs[r["doc_id"]]))
        scores = {x: sum(g in s for g in mine) / len(mine) for x, s in sets.items()} if mine else {}
        assert r["held_out"] == out[r["doc_id"]]
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert abs(scores[r["lang_pred"]] - max(scores.values())) < 0.02 and abs(r["score"] - scores[r["lang_pred"]]) < 0.03


def test_very_long_texts(spark):
    r = random.Random(31)
    prose = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(60_000))
    passage = "a benchmark question of its own that no prose of random letters would ever hold by chance, asked at length"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose + " " + passage), (2, prose)], "doc_id long, text string")
    assert [x["doc_id"] for x in decontaminate.find(docs, bench).collect()] == [1]
    url = "http://" + "x" * 50_000 + ".org/" + "casino" * 5_000
    got = urls.judge(spark.createDataFrame([(1, url, "<p>casino</p>")], "page_id long, url string, html string")).first()
    assert len(got["host"]) == 50_004 and got["words"].endswith("casino casino")


# Decontamination


def test_banded_alignment_against_full_table():
    r = random.Random(3)

    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, c in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != c)))
            row = new
        return min(row)

    for _ in range(200):
        p = np.array([r.randrange(3) for _ in range(r.randrange(1, 12))], np.uint32)
        t = np.array([r.randrange(3) for _ in range(r.randrange(20))], np.uint32)
        e = brute(p.tolist(), t.tolist())
        cost, a, z = decontaminate.banded(p, t, -len(p) - 1, len(t) + 1, len(p))
        assert cost == e and (e == len(p) or brute(p.tolist(), t[a:z].tolist()) == e)


def test_planted_passages_are_found_and_others_are_left(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, prose(40)) for i in range(20)] + [(50, "short"), (51, None), (52, "")]
    rows, want = [], set()
    for i in range(60):
        text = prose(80)
        if i % 3 == 0:
            k = r.randrange(20)
            passage = items[k][1]
            if i % 2:
                passage = list(passage.upper().replace(" ", "\n"))
                for _ in range(len(passage) // 30):
                    passage[r.randrange(len(passage))] = r.choice(["", "q", "xy"])
                passage = "".join(passage)
            text = f"{text}. {passage}! {prose(10)}"
            want.add((i, k))
        rows.append((i, text, "d"))
    rows += [(100, None, ""), (101, "", ""), (102, "short", ""), (103, "shorter or ashort", "")]
    want.add((102, 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, bench).collect()}
    assert got == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted({x[0] for x in rows} - {x[0] for x in want})
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    bench = spark.createDataFrame([(i, f"item number {i} " + "lorem ipsum dolor sit amet " * 4 + str(i) * 30) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"xx item number {i} " + "lorem ipsum dolor sit amet " * 4 + str(i) * 30) for i in range(6)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, bench).select("doc_id", "item_id").collect()}
    assert {(i, i) for i in range(6)} <= got
    assert docs.filter(F.col("doc_id") == 0).count() == 1


def test_short_items_match_as_they_stand_and_all_regions_are_given(spark):
    passage = ", ".join(f"clause {k * k * 7919} of {k * 104729}" for k in range(6))
    bench = spark.createDataFrame([(1, "Is it so?"), (2, "no"), (3, "What is the capital city of X?"), (4, "日本語"), (5, "!?"), (6, passage)], "item_id long, text string")
    docs = [(1, "Well, is it SO! Is it so"), (2, "noon snow"), (3, "no no"), (4, "what is the capital city of x"), (5, "what is the capital city of xy"), (6, "is itso"), (7, "日本語"), (8, "日本語だ"), (9, "!?")]
    long = decontaminate.normalise(passage)
    docs += [(10, f"a {long} b {'word ' * 50}{long} c"), (11, long[:60])]
    got = sorted(tuple(r) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    at = 2 + len(long) + 3 + 250
    assert got == [(1, 1, 5, 13, 0), (1, 1, 14, 22, 0), (3, 2, 0, 2, 0), (3, 2, 3, 5, 0), (4, 3, 0, 29, 0), (7, 4, 0, 3, 0), (10, 6, 2, 2 + len(long), 0), (10, 6, at, at + len(long), 0)]


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, c in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != c)))
        row = new
    return min(row)


def test_the_query_against_brute_force(spark, tmp_path):
    """Every segment of every item against every document by the full table of edits."""
    from sessionlake.llm import queries

    r = random.Random(21)
    prose = lambda n: " ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 7))) for _ in range(n))
    items = [(i, prose(r.choice([1, 2, 5, 12, 40]))) for i in range(14)] + [(20, None)]
    docs = []
    for i in range(40):
        text = prose(25)
        if i % 2:
            _, passage = items[r.randrange(14)]
            start = r.randrange(max(1, len(passage) - 60)) if r.random() < 0.5 else 0
            part = list(passage[start:])
            for _ in range(r.randrange(0, 1 + len(part) // 10)):
                if part:
                    part[r.randrange(len(part))] = r.choice(["", "x", "yz", " "])
            text += " " + "".join(part) + r.choice([" ", ", ", "e"]) + prose(4)
        docs.append((i, text))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for k, text in items:
        clean = decontaminate.normalise(text)
        n, size = len(clean), decontaminate.SEGMENT
        for i, doc in docs:
            t = decontaminate.normalise(doc)
            if not clean:
                continue
            if n < decontaminate.MIN_CHARS:
                hit = f" {clean} " in f" {t} "
            else:
                starts = [0] if n <= size else [*range(0, n - size, decontaminate.STRIDE), n - size]
                hit = any(least_edits(clean[s : s + size], t) <= int(decontaminate.EDITS * min(n, size)) for s in starts)
            if hit:
                want.add((i, k))
    assert {(x["doc_id"], x["item_id"]) for x in queries.op10_qgram_decontamination(spark, str(tmp_path)).collect()} == want and len(want) > 10


def test_matching_documents_without_an_id_are_dropped_and_others_of_an_id_stay(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards mix vivid potions of jade and quartz"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(None, f"before {passage} after"), (None, "a text of its own"), (None, None), (4, f"so {passage}"), (4, "another text of this id"), (5, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(x) for x in decontaminate.clean(docs, bench).collect()), key=str)
    assert kept == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)
