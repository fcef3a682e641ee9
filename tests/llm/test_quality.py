import math

import numpy as np
import pyarrow.parquet as pq

from gridweft.llm import quality, queries


def test_pairs_rank_and_threshold():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.8).astype(int)
    x = rng.normal(size=(2000, 5))
    x[:, 2] += 3 * y
    r = quality.fit(x, y, pairs=20_000)
    s = r.score(x)
    assert abs(np.mean(s >= 0.5) - y.mean()) < 0.01
    assert np.mean((s >= 0.5) == y) > 0.9 and np.all((s >= 0) & (s <= 1))
    flat = quality.fit(x, np.ones(2000))
    assert np.all(flat.score(x) == 0.5)


def test_edges(spark):
    rows = [(1, None), (None, "some text here"), (2, ""), (3, "same same"), (3, "same same"), (4, "long text " * 30_000), (5, " \n\t")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, score int, x string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (None, 1, 0), (3, None, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, x int")
    got = quality.score(df, quality.learn(df, labels)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 5)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    none = quality.learn(df, labels.where("false"))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.where("false"), none).count() == 0


def test_held_out_accuracy(spark):
    out = queries.op5_quality(spark, "/root/testdata/sf0.1").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.predicted for r in rows])
    assert np.mean(y == p) > 0.95
    assert np.mean(p[y == 0] == 0) > 0.85


def brute_features(text):
    """The FEATURES in plain loops."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, w = len(text), len(words)
    share = lambda found: sum(map(found, text)) / n
    ascii_ = lambda c: ord(c) < 128
    of = lambda found: sum(map(found, words)) / w
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    lines = [y.strip() for y in text.split("\n") if y.strip()]
    marks = ".,;:'\"()-?"
    counts = {x: words.count(x) for x in set(words)}
    return [
        math.log1p(n), math.log1p(w), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / w), of(lambda x: len(x) > 12), of(lambda x: len(x) < 3),
        share(lambda c: not ascii_(c) or c.islower() or c.isupper()), share(lambda c: ascii_(c) and c.isupper()), share(lambda c: ascii_(c) and c.isdigit()), share(lambda c: ascii_(c) and c.isspace()), share(lambda c: c in marks),
        text.count(".") / w, share(lambda c: ascii_(c) and ord(c) > 32 and not c.isalnum() and not c.isspace() and c not in marks + "|!"), share(lambda c: c == "|"), share(lambda c: c == "!"), share(lambda c: not ascii_(c)),
        len(counts) / w, max(counts.values()) / w, of(lambda x: x.isupper() and len(x) > 1), of(lambda x: not x[-1].isalnum() and x[-1] not in ".,;:?)'\""),
        math.log1p(len(lines)), math.log1p(n / len(lines)), (len(lines) - len(set(lines))) / len(lines), 1 - sum(map(len, set(lines))) / sum(map(len, lines)),
        len(set(zip(words, words[1:])) if w > 1 else {1}) / max(1, w - 1), of(lambda x: x[0].isupper()), of(str.isalpha), share(lambda c: c in "aeiouyAEIOUY"), len(text.encode()) / n, math.log1p(max(sizes)),
    ]


def test_features_of_a_table_against_plain_loops():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for t in [*texts, None, "", "a", "x | y! 123 ÀÉ\n\nX."]:
        assert np.allclose(quality.features(t), brute_features(t), atol=1e-6), t


def test_weights_are_near_the_least_pairwise_loss():
    """Newton's method on all pairs of the same table finds no much smaller logistic loss."""
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.6).astype(int)
    x = rng.normal(size=(300, 4)) + np.outer(y, [1.0, 0.5, 0.0, -0.7])
    r = quality.fit(x, y, pairs=40_000)
    z = (x - x.mean(0)) / x.std(0)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-4 * w @ w
    w = np.zeros(4)
    for _ in range(20):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-4 * np.eye(4), (d * p[:, None]).mean(0) - 1e-4 * w)
    assert loss(r.weights) < 1.01 * loss(w) < loss(np.zeros(4))


def test_ranking_of_held_out_documents(spark):
    """The share of pairs of both labels in the right order, counted pair by pair."""
    out = queries.op5_quality(spark, "/root/testdata/sf0.1").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_weights_threshold_and_scale_are_those_of_all_pairs():
    """Newton's method on the listed pairs finds the same weights to 1e-6, where the labels are mixed and where they are apart."""
    for apart in (1.0, 6.0):
        rng = np.random.default_rng(8)
        y = (rng.random(260) < 0.7).astype(int)
        x = rng.normal(size=(260, 4)) * [1, 5, 0.1, 1] + np.outer(y, [apart, 0.5, 0.0, -0.7])
        r = quality.fit(x, y)
        z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
        d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
        w = r.weights.copy()
        for _ in range(5):
            p = 1 / (1 + np.exp(d @ w))
            w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-4 * np.eye(4), (d * p[:, None]).mean(0) - 1e-4 * w)
        assert np.abs(r.weights - w).max() < 1e-6
        raw = np.sort(z @ r.weights)
        k = int((y == 0).sum())
        assert abs(r.threshold - (raw[k - 1] + raw[k]) / 2) < 1e-9 and abs(r.scale - raw.std() / 2) < 1e-7


def test_tied_scores_at_the_threshold():
    x = np.array([[0.0]] * 6 + [[1.0]] * 6)
    for y in ([0] * 4 + [1] * 8, [0] * 6 + [1] * 6, [0] * 8 + [1] * 4, [0] * 11 + [1]):
        r = quality.fit(x, np.array(y))
        raw, k = np.sort(r.raw(x)), y.count(0)
        assert abs(r.threshold - (raw[k - 1] + raw[k]) / 2) < 1e-12


def test_every_labelled_document_counts(spark):
    """Of more labelled documents than were once read each changes the ranker, and the number of tasks doesn't."""
    rng = np.random.default_rng(5)
    words = np.array("a bb ccc dddd eeeee. | Ff! ggggggggggggggg 77".split())
    texts = [" ".join(words[rng.integers(0, len(words), 3 + i % 7)]) for i in range(14_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = docs.selectExpr("doc_id", "if(text like '%|%' and doc_id % 5 > 0, 0, 1) quality")
    y = {r.doc_id: r.quality for r in labels.where("pmod(crc32(cast(doc_id as string)), 3) <> 1").collect()}
    ids = sorted(y)
    assert len(ids) > 9000
    x, y = np.array([quality.features(texts[i]) for i in ids]), np.array([y[i] for i in ids])
    want, got = quality.fit(x, y), quality.learn(docs, labels)
    assert np.allclose(got.mean, x.mean(0), rtol=1e-9, atol=1e-9) and np.allclose(got.std[x.std(0) > 1e-9], x.std(0)[x.std(0) > 1e-9], rtol=1e-9)
    assert np.array_equal(got.weights, want.weights) and (got.threshold, got.scale) == (want.threshold, want.scale)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x[:3000], y[:3000])], "y long, x array<double>").repartition(6)
    some = quality.solve(quality.spread(rows, tasks=2), x.shape[1], 1e-4)  # merged twice
    assert np.array_equal(some.weights, quality.fit(x[:3000], y[:3000]).weights)
