import random
from collections import Counter

import numpy as np

from sessionlake.llm import minhash as M


def multiset(text):
    words = M._WORD.findall((text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_likeness(a, b):
    x, y = multiset(a), multiset(b)
    both, either = sum((x & y).values()), sum((x | y).values())
    return both / either if either else 0.0


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") or rows[i][0] == rows[j][0]
            if same or brute_likeness(rows[i][1], rows[j][1]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: least[find(i)] for i, r in enumerate(rows)}


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "zz" + str(r.randrange(10**6))
    return " ".join(words)


def test_likeness_and_signatures_agree_with_brute_force():
    r = random.Random(1)
    base = prose(r, 300)
    texts = [base, edited(r, base, 3), edited(r, base, 12), base + " " + base, prose(r, 50), "a b", "", None]
    t, e, w = M.shingles(texts)
    sets = [(e[t == i], w[t == i]) for i in range(len(texts))]
    sig = M.signatures(t, e, w.astype(float), len(texts), 4096)
    assert not sig[6].any() and not sig[7].any() and sig[5].all()
    for i in range(6):
        assert dict(zip(*[x.tolist() for x in sets[i]], strict=True)).values() and sets[i][1].sum() == sum(multiset(texts[i]).values())
        for j in range(6):
            exact = brute_likeness(texts[i], texts[j])
            assert abs(M.likeness(sets[i], sets[j]) - exact) < 1e-9
            assert abs((sig[i] == sig[j]).mean() - exact) < 0.04


def test_classes_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for _ in range(12):
        base = prose(r, 120)
        rows += [base, base, edited(r, base, 1), edited(r, base, 2), edited(r, base, 6)]
    chain = prose(r, 200)
    for _ in range(25):  # neighbours are alike, ends are not
        rows.append(chain)
        chain = edited(r, chain, 2)
    rows += [None, "", "!!", "a b c", "A b  c", "x " * 40, "x " * 44, "x " * 90]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, u long")
    got = {x["doc_id"]: x["class_id"] for x in M.classes(df).collect()}
    assert got == brute_classes(rows)
    kept = M.clean(df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(got.values()))


def test_many_mixed_pairs_take_leads_first(spark, monkeypatch):
    monkeypatch.setattr(M, "MANY", 0)
    r = random.Random(3)
    base = prose(r, 100)
    rows = list(enumerate([edited(r, base, r.randrange(1, 5)) for _ in range(40)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in M.classes(df).collect()} == brute_classes(rows)


def test_large_buckets_are_dealt_to_finer_ones(spark, monkeypatch):
    monkeypatch.setattr(M, "BIG", 6)
    r = random.Random(13)
    base = prose(r, 60)
    # One frame of words with ends of their own, in pairs that are alike: many classes in few buckets.
    rows = []
    for _ in range(14):
        one = base + " " + prose(r, 22)
        rows += [one, edited(r, one, 1)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in M.classes(df).collect()} == brute_classes(rows)


def test_ids_of_other_types_and_link_counts(spark):
    r = random.Random(14)
    a, b = prose(r, 80), prose(r, 80)
    rows = [("x", a), ("y", a), ("z", edited(r, a, 1)), ("w", b), (None, edited(r, b, 1)), ("q", "alone")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {x["doc_id"]: x for x in M.classes(df).collect()}
    assert got.keys() == {"x", "y", "z", "w", None, "q"}
    assert got["x"]["class_id"] == got["y"]["class_id"] == got["z"]["class_id"] in ("x", "y", "z") and got["w"]["class_id"] == got[None]["class_id"]
    assert {k: v["links"] for k, v in got.items()} == {"x": 1, "y": 1, "z": 1, "w": 1, None: 1, "q": 0}
    assert M.clean(df).count() == 3
    some = spark.createDataFrame([(1.5, a), (2.5, a)], "doc_id double, text string")
    assert len({x["class_id"] for x in M.classes(some).collect()}) == 1


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = prose(random.Random(4), 50)
    df = spark.createDataFrame([(5, t), (5, t), (5, "other words"), (9, t), (None, "lonely text")], "doc_id long, text string")
    rows = sorted((x["doc_id"], x["class_id"]) for x in M.classes(df).collect())
    assert rows[1:] == [(5, 5), (5, 5), (5, 5), (9, 5)] and rows[0][0] == rows[0][1] < 0
    assert sorted(x["doc_id"] or 0 for x in M.clean(df).collect()) == [0, 5]
    assert M.classes(df.limit(0)).count() == 0


def test_texts_without_an_id_are_each_kept_once(spark):
    r = random.Random(12)
    a, b = prose(r, 50), prose(r, 50)
    df = spark.createDataFrame([(None, a), (None, a), (None, b), (None, b), (7, "other words"), (7, "other words")], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["text"]) for x in M.clean(df).collect()) == sorted([(0, a), (0, b), (7, "other words")])


def test_darts_keep_consistency_under_doubling():
    e = np.arange(1, 4, dtype=np.uint64) << np.uint64(40)
    one = M.signatures(np.zeros(3, np.int64), e, np.array([1.0, 2.0, 0.5]), 1)
    two = M.signatures(np.repeat([0, 1], 3), np.concatenate([e, e]), np.array([1.0, 2.0, 0.5] * 2), 2)
    assert (one[0] == two[0]).all() and (two[0] == two[1]).all() and one.all()


def test_sketches_decide_short_texts_exactly_and_keep_near_long_ones():
    r = random.Random(9)
    for n in (60, 900):
        base = prose(r, n)
        texts = [base, *[edited(r, base, k) for k in range(0, n // 10, max(1, n // 60))], ""]
        t, e, w = M.shingles(texts)
        sketch, total = M.sketches(t, e, w, len(texts))
        assert total.tolist() == [sum(multiset(x).values()) for x in texts]
        got = M.alike(sketch[0], int(total[0]), sketch, total)
        want = [brute_likeness(base, x) >= 0.8 for x in texts]
        assert got.tolist() == want if n < 200 else all(g or not x for g, x in zip(got, want, strict=True)) and not got[-1]


def test_very_long_texts_are_whole(spark):
    r = random.Random(15)
    base = prose(r, 40_000)
    rows = [(1, base), (2, edited(r, base, 300)), (3, base[: len(base) // 2]), (4, base + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in M.classes(df).collect()} == brute_classes(rows) == {1: 1, 2: 1, 3: 3, 4: 1}
