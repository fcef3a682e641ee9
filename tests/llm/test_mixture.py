from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from gridweft.llm import bpe, mixture, queries


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    codes = [a.ravel() for a in np.meshgrid(range(4), range(3), range(2), indexing="ij")]
    n = rng.integers(1, 1000, 24).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    w = mixture.rake(n, codes, targets)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, w), t, atol=1e-8)
    # odds ratios of the table stay: the fit is the one closest to the table
    at = lambda x, i, j, k: x[i * 6 + j * 2 + k]
    odds = lambda x: at(x, 0, 0, 0) * at(x, 1, 1, 0) / at(x, 0, 1, 0) / at(x, 1, 0, 0)
    assert np.isclose(odds(w), odds(n))
    for keep in (0.1, 0.5, 0.95, 1.0):
        p = mixture.probabilities(n, w, keep)
        assert p.max() <= 1 and np.isclose((n * p).sum() / n.sum(), keep)


def docs(spark, n=6000):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        src = ["hot", "b", "c", None][min(3, int(rng.exponential(0.7)))]
        rows.append((i, ["plain words here " * int(rng.integers(1, 30)), "a | b | c", "The License text"][int(rng.integers(3))], ["en", "de"][int(rng.integers(2))], src, 1, 2.0))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int, tokens double")


def test_sample_follows_targets(spark):
    rows, df = docs(spark, 12000)
    out = mixture.mix(df, targets={"source": {"hot": 0.25, "b": 0.25, "c": 0.25, "(null)": 0.25}, "lang": {"en": 0.5}}, keep=0.02).collect()
    assert len(out) == len(rows)
    total = sum(r.tokens for r in out)
    expected = sum(r.tokens * r.probability for r in out)
    assert abs(expected / total - 0.02) < 1e-6
    kept = [r for r in out if r.sampled]
    for v in ("hot", "b", "c", "(null)"):
        assert abs(sum(r.tokens * r.probability for r in out if r.source == v) / expected - 0.25) < 0.01
        assert abs(sum(r.tokens for r in kept if r.source == v) / sum(r.tokens for r in kept) - 0.25) < 0.15
    assert abs(sum(w for w in {(r.source, r.lang, r.topic): r.weight for r in out}.values()) - 1) < 1e-9
    again = mixture.mix(df.repartition(5), targets={"source": {"hot": 0.25, "b": 0.25, "c": 0.25, "(null)": 0.25}, "lang": {"en": 0.5}}, keep=0.02).where("sampled").select("doc_id").collect()
    assert {r[0] for r in again} == {r.doc_id for r in kept}


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", None, "s"), (1, "", None, "s"), (2, "long " * 100_000, "en", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, topic string")
    out = mixture.mix(df, keep=1.0).collect()
    assert len(out) == 4 and all(r.sampled for r in out)
    assert mixture.mix(df, keep_columns=True, keep=1.0).where("sampled").select("row.*").columns == df.columns
    assert {r.topic for r in mixture.mix(df, topic_col="topic").collect()} == {"k"}
    assert mixture.mix(df.where("false")).count() == 0


def test_rare_categories_keep_their_names(spark, monkeypatch):
    monkeypatch.setitem(mixture.LIMITS, "source", 2)
    _, df = docs(spark, 500)
    assert {r.source for r in mixture.mix(df).collect()} <= {"hot", "b", "c", "(null)", mixture.OTHER}


def test_the_query_against_brute_force_fitting(spark):
    """Cells of the query's own table, raked here by plain loops to the same targets."""
    rows = queries.op10_mixture(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    encoding = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encoding
    assert all(r.tokens == max(1, len(encoding.encode_ordinary(texts[r.doc_id] or ""))) for r in rows)
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.tokens
    total = sum(cells.values())
    targets = []
    for d in range(3):
        natural = Counter()
        for c, n in cells.items():
            natural[c[d]] += n
        flat = {k: n**mixture.POWER for k, n in natural.items()}
        targets.append({k: v / sum(flat.values()) for k, v in flat.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(300):
        for d in range(3):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[d]] += x
            w = {c: x * targets[d][c[d]] / have[c[d]] for c, x in w.items()}
    for r in rows:
        assert r.weight == pytest.approx(w[r.source, r.lang, r.topic], abs=1e-6)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(mixture.KEEP * total, rel=1e-6)
    scale = {round(r.probability * cells[r.source, r.lang, r.topic] / total / r.weight, 6) for r in rows if r.probability < 1}
    assert len(scale) <= 1  # below one, the chance is the weight over the natural share, times one scale
    assert all(r.sampled for r in rows if r.probability == 1)
    assert abs(np.mean([r.sampled for r in rows]) - np.mean([r.probability for r in rows])) < 0.04


def test_topics_are_learned_from_words(spark):
    rng = np.random.default_rng(3)
    fields = [[f"{x}{i}" for i in range(60)] for x in ("sea", "law", "bread")]
    rows = [(i, " ".join(rng.choice(fields[i % 3], 80)), "en", "s") for i in range(300)] + [(900, None, "en", "s"), (901, " ", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.topic for r in mixture.mix(df).collect()}
    assert got[900] == got[901] == mixture.NONE
    of = defaultdict(set)
    for i in range(300):
        of[got[i]].add(i % 3)
    assert all(len(v) == 1 for v in of.values()) and len(of) >= 3
    again = mixture.mix(df.repartition(7)).collect()
    assert {r.doc_id: r.topic for r in again} == got
    kept = mixture.mix(df, keep_columns=True)
    assert {r.row.doc_id for r in kept.where("sampled").collect()} == {r.doc_id for r in again if r.sampled}
