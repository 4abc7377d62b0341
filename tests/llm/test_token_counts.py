"""Token counts against the library's own encoding of whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionlake.llm import queries, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


def want(texts, limit):
    t = Tokenizer.from_file(FILE)
    return [(len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > limit) for x in texts]


def awkward(seed):
    r = random.Random(seed)
    out = [None, "", "x", " " * 5000, "a" * 4000, "\n \n" * 900, "日本語" * 700, "<|endoftext|>" * 300, "é́😀" * 800]
    parts = ["hello", " world", "  ", "\n", "\t", "'ll", "'", "<|endoftext|>", "<|endof", "123", "!?", "é", "😀", "日本", "a" * 200, " " * 150, "don't", " ", "　 x"]
    return out + ["".join(r.choice(parts) for _ in range(r.randrange(50, 1500))) for _ in range(40)]


@pytest.mark.parametrize(("step", "overlap"), [(300, 40), (1000, 64), (97, 20)])
def test_spliced_counts_equal_whole_texts(spark, step, overlap):
    texts = awkward(step)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, k string, row int").repartition(3)
    got = {r["doc_id"]: r for r in token_counts.count(df, FILE, 100, step=step, overlap=overlap).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) for i in range(len(texts))] == want(texts, 100)
    assert got[3]["n_chunks"] == got[4]["n_chunks"] == 1  # one piece: overlaps widened until the chunks were one
    assert max(r["n_chunks"] for r in got.values()) > 3


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 200), (1, "word " * 200), (None, "word " * 200), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count(df, FILE, 5, step=100, overlap=40).collect())
    assert got == [(0, 0), (0, 201), (1, 201), (1, 201)]
    assert token_counts.count(df.limit(0), FILE, 5).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(df, FILE, 5, overlap=10)


def test_cuts_go_when_their_overlap_reaches_the_next():
    assert token_counts.cuts_of(1000, None, 300, 50) == [(300, 50), (600, 50), (900, 50)]
    assert token_counts.cuts_of(940, None, 300, 50) == [(300, 50), (600, 50)]
    assert token_counts.cuts_of(1000, [(300, 400), (600, 50)], 300, 50) == [(600, 50)]


def test_other_tokenizers_encode_whole_texts(spark):
    import sentencepiece

    texts = ["", "Some words, twice. " * 60, "日本", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(df, public_tokenizers.path("piece_bpe_32k.model"), 5, step=50, overlap=40).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(df, public_tokenizers.path("word_bpe_49k.json"), 5, step=50, overlap=40).collect()}
    assert got == {i: len(word.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_query_equals_the_library_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, folder).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], want([r["text"] for r in docs], 1024), strict=True))
