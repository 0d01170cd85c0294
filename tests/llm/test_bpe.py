import random

import public_tokenizers
import pytest
import tiktoken

from cytoquilt.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.read_ranks(PATH)
    return bpe.TreeBPE(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library(pair):
    own, lib = pair
    rng = random.Random(5)
    texts = ["", " ", "\n\n  \t x", "a" * 5000, "ab" * 3000, "é" * 777, "ñcarrción" * 400, "=-" * 999, "1234567890" * 90, " " * 3001 + "x", "don't we'll I'd", "日本語テキスト🙂🙂🙂"]
    texts += ["".join(rng.choice("abcéñ ß\n\t.,'19🙂") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("abet") for _ in range(rng.randrange(30, 3000))) for _ in range(40)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_table(spark):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (3, ""), (None, "x"), (4, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == {i: t or "" for i, t in rows}
    assert bpe.encode(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
