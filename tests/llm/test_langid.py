import random

import numpy as np
import pytest

from gridweft.llm import langid, queries


def brute_phrases(sample, text):
    """Greedy longest phrases that occur in sample, over the whole text."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("dense, block, rounds", [(langid.DENSE, 512, 4), (0, 64, 4), (langid.DENSE, 7, 1), (0, 5, 0)])
def test_walk_matches_greedy_parsing(dense, block, rounds, monkeypatch):
    monkeypatch.setattr(langid, "ROUNDS", rounds)
    rng = random.Random(3)
    mixed = lambda n, a: "".join(rng.choices(a, k=n))
    samples = {"xx": mixed(400, "abcab "), "yy": mixed(300, "abde "), "zz": ""}
    a = langid.Automata(samples, dense, block)
    assert (a.table is None) == (not dense)
    texts = [mixed(rng.randint(0, 1300), "abcde f1.ñ") for _ in range(60)] + ["", "...", "ABC", "a" * 3000, "abcab " * 300, (samples["xx"] * 4)[7:]]
    counts, letters, lengths = a.phrases(texts)

    def norm(t):
        out = []
        for c in t.lower():
            c = c if c.isalpha() else " "
            if not (c == " " and out and out[-1] == " "):
                out.append(c)
        return "".join(out)

    for k, t in enumerate(texts):
        assert letters[k] == sum(c.isalpha() for c in t) and (not t or lengths[k] == len(norm(t)))
        for j, x in enumerate(a.langs):
            if t:
                assert counts[k, j] == brute_phrases(norm(samples[x]), norm(t)), (t, x)


def test_edges(spark):
    rows = [(1, None), (None, "the and of"), (2, ""), (3, "1234 ..."), (4, "und der die " * 20_000), (4, "und der die"), (5, "the and of")]
    df = spark.createDataFrame([(i, t, 0.5, "k", None) for i, t in rows], "doc_id long, text string, score double, c0 string, lang_pred string")
    got = langid.predict(df, {"en": "the cat and the dog of the house", "de": "der hund und die katze"}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)]
    assert [x[0] for x in by[4]] == ["de", "de"] and by[5] == by[None] and by[5][0][0] == "en"
    assert all(0 <= s <= 1 for v in by.values() for _, s in v)
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.predict(df.where("false"), {"en": "x"}).count() == 0
    assert langid.samples(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_held_out_accuracy(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
