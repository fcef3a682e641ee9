import numpy as np
import pytest

from gridweft.llm import embed_dedup


def vectors(common, n=6000, copies=400, d=64, seed=6):
    """Vectors with a common direction of that length, and pairs around the least cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / 8 + common * np.eye(d)[0]
    x = x[:, rng.permutation(d)]
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    base, off = unit(x[:copies]), rng.normal(size=(copies, d))
    off = unit(off - base * np.einsum("ij,ij->i", off, base)[:, None])
    c = np.linspace(0.925, 0.96, copies)[:, None]
    x[n - copies :] = base * c + off * np.sqrt(1 - c * c)
    x = x.astype(np.float32)
    y = unit(x.astype(float))
    near = y @ y.T >= 0.93
    np.fill_diagonal(near, False)
    return x, near


@pytest.mark.parametrize("common, block, look, several", [(0.0, 64, 3, True), (1.0, 64, 3, True), (2.6, 64, 1, False), (0.0, 512, 15, False)])
def test_links_against_brute_force(spark, common, block, look, several):
    """Isotropic and one-sided labels, in several passes, in one that holds the label, and by blocks."""
    x, near = vectors(common)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    spread = 1 - float((y.mean(0) ** 2).sum())
    assert (embed_dedup.passes(len(x), spread, block=block, look=look)[1] > 1) == several
    got = {r.vec_id: r.n_links for r in embed_dedup.near_dedup(df, block=block, look=look).collect()}
    found = sum(got.values()) / near.sum()
    assert near.sum() > 300 and all(got[i] <= n for i, n in enumerate(near.sum(1).tolist()))
    assert found >= 0.999 if several else found == 1


def test_a_dense_label_is_counted_not_listed(spark):
    """Thousands of vectors that are all alike: the windows give counts and a forest."""
    rng = np.random.default_rng(1)
    x = (1 + rng.normal(size=(3000, 16)) * 0.01).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_dedup(df, block=256).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)}
