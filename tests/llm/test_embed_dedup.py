import duckdb
import numpy as np
import pytest

from gridweft.llm import embed_dedup


def brute(rows, cosine=0.93):
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unit(v):
        if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x)

    units, links = [unit(r[1]) for r in rows], [0] * n
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][0] is not None and rows[j][0] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return [(r[0], links[i], low.get(find(i)), r[0] is not None and low[find(i)] == r[0]) for i, r in enumerate(rows)]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, size int")
    got = [tuple(r) for r in embed_dedup.near_dedup(df, **kw).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [8, 128])
def test_links_match_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows, k = [], 0
    for c in range(30):
        center = rng.normal(size=24)
        for _ in range([1, 2, 3, 60][c % 4]):
            v = center + rng.normal(size=24) * 0.1 * (c % 4 > 0)
            rows.append((k, [float(x) for x in v], c % 3))
            k += 1
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(40)] + [(5, rows[5][1], rows[5][2])]
    check(spark, rows, block=block, look=1 if block == 8 else 15, hot=10 if block == 8 else 10**5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, v, None), (8, v, 1), (9, [2.0, 4.0], 1), (None, v, 1), (10, v, 2), (11, [1.0, 2.0, 0.0], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3), (13, [0.0, 1.0], 3)]
    check(spark, rows)
    assert embed_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_passes_follow_the_rows_and_their_spread():
    assert embed_dedup.passes(16 * 1024) == (15, 1) and embed_dedup.passes(1024)[1] == 1
    few, more, most = (embed_dedup.passes(n)[1] for n in (10**5, 10**7, 10**9))
    assert 1 < few < more < most < 400
    assert embed_dedup.passes(10**6, 0.5)[1] > embed_dedup.passes(10**6)[1]
    assert embed_dedup.passes(10**5, 0.1)[1] == 0  # all pairs cost less


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)]
    check(spark, rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, h int")
    assert sorted(tuple(r) for r in embed_dedup.near_dedup(df).collect()) == sorted(brute(rows))


def test_sql_agrees_on_a_table(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    got = sorted(tuple(r) for r in embed_dedup.near_dedup(spark.read.parquet(path)).collect())
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}'")
    assert got == sorted(con.sql(embed_dedup.ORACLE).fetchall())
