import random

import pytest
from hypothesis import given, settings, strategies as st

from scanloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary())


def ids_of(reference, text):
    return reference.encode(text, add_special_tokens=False).ids


HARD = ["", " ", "\n\n  x", "don't I'LL", "a" * 500, "ab" * 200, "   leading", "tail   ", "héllo wörld", "漢字かな", "🔑👩‍👩‍👧", "<|endoftext|>", "\x00\x01", "  x", "0x5f3759df", "x" * 3 + "\t" * 7, "ＡＢＣ", "é" * 50, "ſtrange ﬁne"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(reference, encoder, text):
    assert encoder.encode([text])[0] == ids_of(reference, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, encoder, text):
    assert encoder.encode([text])[0] == ids_of(reference, text)


def test_words_that_fail_the_check_are_merged_exactly(reference):
    """Random letters make greedy proposals fail often; the check must find each failure and only failures."""
    v, rng = bpe.vocabulary(), random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 14))) for _ in range(3000)]
    wrong = sum(v.greedy(w.encode()) != v.exact(w.encode()) for w in words)
    assert wrong > 300
    assert v.encode_words(words) == [ids_of(reference, w) for w in words]


def test_documents(spark, reference):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "one two"), (4, "x"), (5, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as other")
    out = bpe.encode_documents(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r["doc_id"], len(r["ids"])) for r in out.collect())
    assert got == sorted((i, len(ids_of(reference, t or ""))) for i, t in rows)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_few_kept_words(reference):
    e = bpe.Encoder(bpe.vocabulary(), kept=3)
    for text in ("a b c d e f", "a b c d e f g", "h i j"):
        assert e.encode([text, text]) == [ids_of(reference, text)] * 2
