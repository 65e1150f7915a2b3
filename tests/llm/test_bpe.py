import hashlib
import random

import pytest

from quillspark.llm import bpe
from quillspark.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ALPHABETS = ["abcdefgh", "thinger", "aA's 'll", "äößéİǅ", "0123456789", "!?.,%$-", "日本語한국", "e\u0301\u0308\u200d", "ab \n\t\u00a0\x1c\u2028", "<|startofx>end"]


def samples():
    rng = random.Random(3)
    yield from ["", " ", "\n\n", "'s", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "<|endoftext|>" * 90, "th" * 999 + "é" * 777, "\u0301a \u0301b", "İ" * 1500]
    for k in range(250):
        letters = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        yield "".join(rng.choices(letters, k=rng.choice([5, 60, 700, 3000])))
    yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))


def test_same_as_library(library):
    for leaf in (24, bpe.LEAF):
        own = bpe.TreeBpe(PATH, leaf)
        for text in samples():
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == ids, text[:80]
            decoded = library.decode(ids, skip_special_tokens=False)
            assert own.decode(ids) == decoded
            assert own.digests(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_a_file_that_keeps_white_space():
    """Byte-level BPE has white space in its tokens, so texts are not split there."""
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.TreeBpe(path, 24)
    assert not own.by_space and bpe.TreeBpe(PATH).by_space
    for text in [*samples(), "Hello, world! \n\n  x  " * 40]:
        text = text.encode("utf-8", "replace").decode()
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False), text[:80]


def test_columns_and_digests(spark, library):
    rows = [(1, None, "x"), (1, "the the", "y"), (None, "", "z"), (4, "word " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.decode_column(bpe.encode_column(df, PATH), PATH).orderBy("doc_id", "text").collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert sorted(r.n_tokens for r in bpe.encode_digests(df, PATH).collect()) == [0, 0, 2, 3000]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
