"""Segmentation against all paths and all sequences of places, and analysers of one's own."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import analysers, lexicon, segment
from sessionlake.functions.lexicon import BEFORE, BEGIN, END, SINGLE, Lexicon
from sessionlake.operators import fulltext


def splits(run):
    for cuts in product([0, 1], repeat=len(run) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        yield list(zip(edges, edges[1:], strict=False))


def test_path_is_the_most_probable_of_all():
    r = random.Random(4)
    chars = "天地人水火"
    for _ in range(60):
        words = {"".join(r.choice(chars) for _ in range(r.randrange(1, 4))): r.randrange(1, 50) for _ in range(12)}
        lex = Lexicon(words)
        run = "".join(r.choice(chars + "木") for _ in range(r.randrange(1, 9)))
        cost = lambda path: sum(math.log(lex.total) - math.log(words.get(run[a:z], 1)) for a, z in path)  # noqa: E731, B023
        allowed = [p for p in splits(run) if all(z == a + 1 or run[a:z] in words for a, z in p)]
        assert abs(cost(lex.path(run)) - min(map(cost, allowed))) < 1e-9 and lex.path(run) in allowed


def test_discovery_is_the_most_probable_sequence_of_places():
    r = random.Random(5)
    chars = "天地人水火木"
    lex = Lexicon({"".join(r.choice(chars) for _ in range(r.randrange(1, 5))): r.randrange(1, 9) for _ in range(30)})
    for _ in range(40):
        run = "".join(r.choice(chars + "金") for _ in range(r.randrange(1, 7)))
        best, chosen = -math.inf, None
        for places in product(range(4), repeat=len(run)):
            if places[0] not in (BEGIN, SINGLE) or places[-1] not in (END, SINGLE) or any(a not in BEFORE[b] for a, b in zip(places, places[1:], strict=False)):
                continue
            score = lex.start[places[0]] + sum(lex.seen[p].get(c, lex.unseen[p]) for p, c in zip(places, run, strict=True)) + sum(lex.move[b][a] for a, b in zip(places, places[1:], strict=False))
            if score > best:
                best, chosen = score, places
        ends = [i + 1 for i, p in enumerate(chosen) if p in (END, SINGLE)]
        assert [z for _, z in lex.discover(run)] == ends


def test_counts_decide_where_words_overlap():
    words = {"研究": 50, "研究生": 20, "生命": 60, "命": 10, "起源": 30, "的": 100}
    assert [z for _, z in Lexicon(words).path("研究生命的起源")] == [2, 4, 5, 7]
    assert [t.text for t in segment.Segmenter(words).tokens("研究生命", query=True)] == ["研究", "生命"]
    assert lexicon.parsed(["研究 50 v", "", "生命", "x 1.5"]) == {"研究": 50, "生命": 1, "x": 1}
    many = Lexicon(words).cut("研究生命的起源" * 3000)
    assert len(many) == 4 * 3000 and Lexicon().cut("研究") == [(0, 1), (1, 2)]


def test_characters_that_no_word_covers_are_cut_together():
    lex = Lexicon({w: 5 for w in ["水泵", "火泵", "木泵", "油泵", "气泵", "检查", "复查"]})
    assert lex.cut("检查电泵") == [(0, 2), (2, 4)]  # the last character ends words


def test_a_word_list_is_a_file_in_tasks(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("研究 50\n研究生 20\n生命 60\n", encoding="utf-8")
    cut = analysers.analyser(f"segmenting:{path}")
    df = spark.createDataFrame([(0, "研究生命"), (1, "生命")], "doc_id long, text string").repartition(2)
    rows = {r["doc_id"]: r["toks"] for r in fulltext.index(df, ("doc_id",), analyser=cut).collect()}
    assert rows == {0: ["研究", "生命"], 1: ["生命"]} and cut.words("研究生命") == [("研究",), ("生命",)]


def test_an_analyser_of_ones_own(spark, tmp_path):
    from sessionlake.archive import Archive

    from .test_commits import passes, rows_of

    class Commas(analysers.Analyser):
        def __init__(self, mark):
            self.mark = mark

        def column(self, text):
            return F.split(F.lower(text), self.mark)

        def words(self, text):
            return [(w,) for w in text.lower().split(self.mark)]

    analysers.register("marks", Commas)
    with pytest.raises(ValueError):
        analysers.register("marks", Commas)
    a = Archive(spark, str(tmp_path / "a"), tokenizer="marks:;")
    a.write(*rows_of(spark, ["codex:a"], "one two;three four;"))
    assert [r["id"] for r in a.search("three four", as_of_ms=1).collect()] == ["codex:a"] and a.search("one", as_of_ms=1).count() == 0
    assert a.manifest()["tokenizer"] == "marks:;" and all(passes(a).values())
