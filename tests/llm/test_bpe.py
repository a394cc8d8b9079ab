import random

import pytest

from quire.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoders():
    with open(bpe.VOCABULARY, "rb") as file:
        words = bpe.parse_ranks(file.read())
    ours = bpe.Encoder(words)
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})
    return ours, public


def test_equals_public_library_on_random_text(encoders):
    ours, public = encoders
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("abcaab tthe iing ng erAé中ß\n\t\x00!!??--==' 's 0129🙂") for _ in range(rng.randint(0, 80)))
        assert ours.encode(text) == public.encode_ordinary(text)


def test_long_pieces_and_round_trip(encoders):
    ours, public = encoders
    for text in ("a" * 20_000, "ab" * 5_000, " " * 9_000, "=-" * 4_000, "漢字" * 3_000):
        ids = ours.encode(text)
        assert public.decode(ids) == text
        assert ids == public.encode_ordinary(text)


def test_special_strings_are_ordinary_text(encoders):
    ours, public = encoders
    assert ours.encode("a<|endoftext|>b") == public.encode_ordinary("a<|endoftext|>b")


def test_table(spark, encoders):
    ours, _ = encoders
    rows = [(1, "hello world", "x"), (2, "", None), (3, None, "y"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect() if r.ids is not None)
    assert got == [(1, ours.encode("hello world"))] * 2 + [(2, [])]
    assert {r.doc_id: r.n_tokens for r in bpe.count_corpus(df).collect()} == {1: 2, 2: 0, 3: None}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
