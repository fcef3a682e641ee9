import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from gridweft.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    alphabet = ["a", "e", "th", "the", " ", "  ", "\n", " \n", "'", "'s", "'re", "r", "é", "ß", "日本", "١", "7", "42", "!", "…", "\x1c", "\xa0", "　", "🙂", "é", "\t"]
    return "".join(rng.choices(alphabet, k=n))


@pytest.mark.parametrize("leaf,piece", [(4, 3), (16, 8), (64, 1024)])
def test_tree_encodes_as_the_library(library, leaf, piece):
    c, rng = bpe.Codec(PATH, P.PATTERN, leaf, piece), random.Random(leaf)
    texts = [random_text(rng, rng.randint(0, 60)) for _ in range(1500)]
    texts += ["".join(rng.choices("aehinortst", k=400)) for _ in range(30)] + ["ab" * 500, "0" * 700, " " * 300 + "x", "a" * 999, "<|endoftext|>"]
    for t in texts:
        ids = c.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert c.decode(ids) == t.encode()


def test_very_long_match_is_not_quadratic(library):
    c = bpe.Codec(PATH, P.PATTERN)
    t = "".join(random.Random(0).choices("abcdefghij", k=300_000))
    ids = c.encode(t)
    assert c.decode(ids) == t.encode()
    assert ids[:500] == library.encode_ordinary(t[:3000])[:500]


def test_rows(spark):
    texts = [None, "", "Hello world", "Hello world", " ", "naïve " * 30_000]
    df = spark.createDataFrame([(i if i != 4 else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, n string")
    got = bpe.encode(df, PATH, P.PATTERN).collect()
    c = bpe.Codec(PATH, P.PATTERN)
    want = []
    for i, t in enumerate(texts):
        ids = c.encode(t or "")
        want.append((i if i != 4 else None, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode(df.where("false"), PATH, P.PATTERN, with_ids=True).count() == 0
