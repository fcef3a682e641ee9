import random

from test_similar import brute, kept, words


def test_texts_under_one_junk_line_are_compared_with_each_other(spark):
    """A line repeated 300 times makes fingerprints alike; the texts below it are what differs."""
    rng = random.Random(4)
    junk = " ".join(words(rng, 10)) + " "
    texts = [junk * 300 + " ".join(words(rng, 60))]
    for _ in range(15):
        own = words(rng, 100)
        texts += [junk * 300 + " ".join(own), junk * 300 + " ".join(own[:98] + words(rng, 2))]
    want = brute(texts)
    assert len(want) == 16
    assert kept(spark, texts) == want
