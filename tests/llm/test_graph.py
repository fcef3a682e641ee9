import random

from gridweft.llm import graph


def brute(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        if u is not None and v is not None and u != v and find(u) != find(v):
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {i: find(i) for i in root}


def test_components_of_hubs_chains_and_noise(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)]
    edges += [(5, 5), (None, 7), (8, None), (399, 1050), (0, 1)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = brute(edges)
    for hot in (10, graph.HOT):
        got = [tuple(r) for r in graph.components(df, hot).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert graph.components(df.where("false")).count() == 0


def test_edges_of_a_hub_stay_in_many_tasks(spark):
    """A million edges of one node: no task of the join has more than its share."""
    edges = spark.range(1, 1_000_001, numPartitions=8).selectExpr("0L as u", "id as v")
    side = spark.createDataFrame([(0, 5, 1_000_000), (1, 6, 1)], "u long, m long, n long")
    plan = graph.joined(edges, side, "u")
    sizes = [r.n for r in plan.selectExpr("spark_partition_id() as p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) <= 200_000
    assert {r.m for r in plan.select("m").distinct().collect()} == {5}
