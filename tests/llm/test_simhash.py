import random
import re

import pytest
import xxhash

from gridweft.llm import simhash


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, link):
    """items: list of (id, fp) -> smallest id within reach for each."""
    n = len(items)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= link:
                root[find(i)] = find(j)
    low = {}
    for i, (x, _) in enumerate(items):
        if x is not None:
            low[find(i)] = min(x, low.get(find(i), x))
    return [low.get(find(i)) for i in range(n)]


@pytest.mark.parametrize("radius", [1, 2, 4, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    ms = simhash.masks(radius)
    assert len(ms) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & bits for m in ms)
    assert all(a & b == b for a, b in zip(ms, simhash.masks(radius, 20)))


TEXTS = [None, "", "  \t\n", "one", "One TWO", "one\x0btwo", "É È ARE not lowered", "a b c d e f g", "x" * 200_000, "w " * 70_000, "a b c d e f g"]


def test_fingerprint_matches_its_definition():
    for t in [*TEXTS, "the quick brown fox jumps over the lazy dog " * 3]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t), t


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, table string, u string")


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(300)]
    rows = [(i if i != 17 else None, t, 1, "x", None) for i, t in enumerate(texts)] + [(3, "one", 1, "x", None)]
    for bucket, hot in ((64, 10**6), (2, 1)):
        out = simhash.near_dedup(docs(spark, rows), bucket=bucket, hot=hot).collect()
        want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows], 4)
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=key) == sorted(((r[0], brute_fingerprint(r[1]), w) for r, w in zip(rows, want)), key=key)


def test_near_fingerprints_link_in_crowded_buckets(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(120)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for bucket in (3, 64, 1000):
        got = {r.node: r.root for r in simhash.graph.components(simhash.links(df, bucket=bucket)).collect()}
        signed = [(simhash.signed(f), f) for f in fps]
        want = brute_components(signed, 4)
        assert [got.get(s, s) for s, _ in signed] == want


def test_empty_table(spark):
    assert simhash.near_dedup(docs(spark, [])).count() == 0
