import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridweft.llm import token_output

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoder_matches_the_library(library):
    e, rng = token_output.Encoder(PATH), random.Random(1)
    assert e.known
    alphabet = ["a", "th", "Er", "É", "ß", "ñ", "İ", "Σ", "ς", "é", " ", "\n", "  ", "\x1c", "\x85", "\xa0", "'", "'s", "'LL", "7", "42", "²", "!", "...", "|", "#$", "ª", "µ", "×", "日本", "🙂", "</w>", "<|endoftext|>", "-", "٣", "ﬁ", "́"]
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library(t), repr(t)
    for t in ("a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", " <|endoftext|>\n x"):
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library(t), repr(t)
    assert 49407 in library("a <|endoftext|> b")


def test_special_tokens_as_text():
    e, t = token_output.Encoder(PATH, special_as_text=True), Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for x in ("a <|endoftext|> b", "<|startoftext|>"):
        assert np.frombuffer(e.encode(x), e.dtype).tolist() == t.encode(x, add_special_tokens=False).ids


def test_files_hold_the_ids_in_order(spark, library):
    texts = [None, "", "One two <|endoftext|>", "one two", "word " * 3000, "x", "y z"]
    rows = [(i * 7 % 5 - 2 if i != 5 else None, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, ids int").repartition(3)
    where, shards = token_output.write(df, PATH, length=16)
    got = [tuple(r) for r in token_output.read(spark, where, shards).collect()]
    want = []
    for i, t in rows_of(rows):
        ids = [*library(t), 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    assert sorted([(g[0], g[2], g[3]) for g in got], key=str) == sorted([w[:3] for w in want], key=str)
    got.sort(key=lambda r: r[1])
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    shard = token_output.Shard(f"{where}/shard-{shards[-1][0]:06d}.arrow")
    n = sum(shard.docs.column("n_tokens").to_pylist())
    seqs = [shard.sequence(i) for i in range(-(-n // 16))]
    assert sum(int(m.sum()) for _, m in seqs) == n and all(len(s) == len(m) == 16 for s, m in seqs)
    flat = np.concatenate([s[m] for s, m in seqs])
    assert flat.tolist() == [x for _, _, parts in shard.runs() for p in parts for x in p.tolist()]


def rows_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_empty_table(spark):
    where, shards = token_output.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert shards == [] and token_output.read(spark, where, shards).count() == 0
