import random
from itertools import combinations

import numpy as np
import pytest

from gridweft.llm import similar


def shingles(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {find(i) for i in range(len(texts))}


def kept(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id for r in similar.similar_groups(df, **kw).collect() if r.kept}


def words(rng, n):
    return ["".join(rng.choices("aeioustnrl", k=6)) for _ in range(n)]


def test_overlaps_match_sets():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 3000, rng.integers(1, 300))) for _ in range(n)] for n in (40, 30))
    assert similar.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


@pytest.mark.parametrize("bucket, block", [(64, 1000), (8, 50)])
def test_copies_of_a_template_are_linked_in_crowded_buckets(spark, bucket, block, monkeypatch):
    """Each copy is like the template, few copies are like each other, and the template isn't the first row."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    template = words(rng, 304)
    texts = []
    for _ in range(300):
        copy = list(template)
        for i in rng.sample(range(10, 290, 5), 5):
            copy[i] = words(rng, 1)[0]
        texts.append(" ".join(copy))
    texts.insert(200, " ".join(template))
    texts += [" ".join(words(rng, 100)) for _ in range(20)]
    want = brute(texts)
    assert len(want) == 21 and len(brute(texts[:200])) > 1
    assert kept(spark, texts, bucket=bucket) == want
