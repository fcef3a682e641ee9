import random

from test_similar import brute, kept, words


def test_repeated_lines_hide_no_link(spark):
    """Copies with a line added many times have almost the same distinct shingles."""
    rng = random.Random(2)
    texts = []
    for _ in range(20):
        base = " ".join(words(rng, 304))
        texts += [base, base + (" " + " ".join(words(rng, 20))) * 10]
    want = brute(texts)
    assert len(want) == 20
    assert kept(spark, texts) == want
