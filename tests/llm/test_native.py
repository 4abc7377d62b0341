"""I-Match fingerprints and licence scans: edge cases, a brute-force scan, and DuckDB twins over awkward rows."""

import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import fingerprint, licenses, queries
from sessionlake.llm.common import Scratch

TEXTS = [
    (4, "Licensed under the Apache License, Version 2.0 (cc by, CC-BY; cc  by)"),
    (2, "The GNU General Public License, version 3. All Rights Reserved all rights reserved."),
    (2, "general public cc by"),
    (9, None),
    (11, ""),
    (11, ""),
    (12, "!!! ??? ..."),
    (None, "Permission is hereby granted free of any charge to any person obtaining a copy of this software and the associated documentation files"),
    (15, "É日本 ünï cc by éé 😀 all rights reserved"),
    (16, "word " * 3000 + "cc by"),
    (17, "alpha beta gamma delta " * 5),
    (18, "alpha beta gamma delta epsilon"),
    (19, "to any " * 15),
    (20, "GNU General Public License version 2 is not " + " ".join(reversed(licenses.TEXTS[1][1].split()))),
    (21, "x y z " + licenses.TEXTS[1][1].replace("sublicense", "lend").replace("merge", "") + " tail " + licenses.TEXTS[1][1]),
    (22, "Redistribution and use in source and binary forms " * 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, e int, term string")


def duck(sql):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    return con.sql(sql).df()


def rows(frame):
    clean = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v if isinstance(v, str) else int(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


def test_scan_equals_sql(spark, docs):
    assert rows(licenses.scan(docs).drop("spans").toPandas()) == rows(duck(licenses.oracle_sql()))


def test_phrases_against_brute_force(docs):
    got = list((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    want = []
    for i, t in TEXTS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        places, labels = [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            some = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += some
            labels |= {label} if some else set()
        want.append((i or 0, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_notices_with_changed_words_are_found(docs):
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[None]["labels"] == "mit" and found[None]["n_base"] == 0
    assert "apache-2.0" in found[4]["labels"]
    assert found[11]["labels"] == "" and found[11]["score"] == 0


def test_repeated_scattered_and_reversed_words_are_no_licence(docs):
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[19]["labels"] == "" and found[19]["score"] < 0.1
    assert found[20]["labels"] == "gpl,gpl-2.0"  # not version 3, nor the reversed text
    assert found[21]["labels"] == "mit" and found[22]["labels"] == ""
    n = len(licenses._words(licenses.TEXTS[1][1]))
    whole = [s for s in found[21]["spans"] if s["end"] - s["start"] >= n - 2]
    assert whole and all(s["end"] - s["start"] <= n * (1 + 2 * licenses.DRIFT) + 1 for s in whole)


def test_chains_against_brute_force(spark):
    r = random.Random(5)

    def longest(pairs):
        best = {}
        for p, a in sorted(pairs):
            best[p, a] = 1 + max((v for (q, b), v in best.items() if q < p and b < a), default=0)
        return max(best.values(), default=0)

    rows = [[(r.randrange(8), r.randrange(8)) for _ in range(r.randrange(12))] for _ in range(200)]
    rows = [sorted(set(x)) for x in rows]
    df = spark.createDataFrame([(i, [(p, -a) for p, a in sorted(x, key=lambda h: (h[0], -h[1]))]) for i, x in enumerate(rows)], "i int, hits array<struct<place:int,neg:bigint>>")
    got = {x["i"]: x["n"] for x in df.select("i", licenses.chain(F.col("hits")).alias("n")).collect()}
    assert got == {i: longest(x) for i, x in enumerate(rows)}


def test_fingerprints_equal_sql(spark, docs):
    got = fingerprint.compare(docs)
    assert rows(got.toPandas()) == rows(duck(fingerprint.oracle_sql()))


def test_followers_cross_ranges_in_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    ids = [3, 900, 5, 5, 70_000, 70_001, -4, 8, 10**15, None, None, None]
    df = spark.createDataFrame([(i, f"text {k} of {i}") for k, i in enumerate(ids)], "doc_id long, text string")
    order = sorted(((-(10**18) if i is None else i), hashlib.md5(t.encode()).hexdigest(), t) for k, i in enumerate(ids) for t in [f"text {k} of {i}"])
    want = {t: order[(k + 1) % len(order)][2] for k, (_, _, t) in enumerate(order)}
    got = {r["t"]: r["edited"] for r in fingerprint.edited(df, Scratch(spark, "t")).filter("guest = 0").collect()}
    assert got == {t: t[: len(t) - len(t) // 4] + want[t][: len(t) // 4] for t in want}
    same = spark.createDataFrame([("s", "copy")] * 30 + [("r", "other")], "doc_id string, text string")
    assert sorted(r["n_chars"] for r in fingerprint.compare(same).collect()) == [4] * 30 + [5]


def test_likeness_follows_the_share_of_lexicon_terms(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.sample(words, 60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lex = fingerprint.lexicon(docs, band=(math.log(1.01), math.log(100)))
    changed = [(i, k, " ".join(t.split()[k:] + [f"w{(i * 7 + j) % 400}" for j in range(k)])) for i, t in rows for k in (0, 6, 20, 45)]
    fp = fingerprint.fingerprints(spark.createDataFrame(changed, "i long, k int, t string"), lex, ["i", "k"], "t")
    own = fp.filter("k = 0").select("i", F.col("lanes").alias("l0"), F.col("fingerprint").alias("f0"))
    near = fingerprint.likeness({"lanes": F.col("l0"), "fingerprint": F.col("f0")}, {"lanes": F.col("lanes"), "fingerprint": F.col("fingerprint")})
    got = {r["k"]: r["m"] for r in own.join(fp, "i").groupBy("k").agg(F.avg(near).alias("m")).collect()}
    assert got[0] == 1 and got[0] > got[6] + 0.1 and got[6] > got[20] + 0.1 and got[20] > got[45] + 0.1 and got[45] < 0.3


def test_empty_tables(spark, docs):
    assert licenses.scan(docs.limit(0)).count() == 0
    assert fingerprint.compare(docs.limit(0)).count() == 0
    assert fingerprint.compare(docs.filter("doc_id = 4")).first()["near_next"] == 1.0


def test_native_plans_hold_no_python(docs):
    for df in (licenses.scan(docs), fingerprint.compare(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_every_query_has_a_callable():
    assert set(queries.oracle_sql()) <= set(queries.queries())
