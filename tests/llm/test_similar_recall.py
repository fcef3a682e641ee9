import random

from test_similar import kept, words


def test_every_pair_just_above_the_similarity_is_found(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        base = words(rng, 204)
        copy = list(base)
        for i in (20, 60, 120, 160):  # 180 of 220 shingles are common: 0.818
            copy[i] = words(rng, 1)[0]
        texts += [" ".join(base), " ".join(copy)]
    assert kept(spark, texts) == set(range(0, 400, 2))
