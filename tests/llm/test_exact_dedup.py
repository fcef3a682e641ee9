import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from gridweft.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for norm, g in groups.items():
        g.sort()
        for m in g:
            out[m[3]] = (rows[m[3]][0], rows[g[0][3]][0], len(g), hashlib.sha256(norm.encode()).hexdigest())
    return [out[k] for k in range(len(rows))], len(groups)


@pytest.mark.parametrize("copies", [3, 400])
def test_groups_match_brute_force(spark, copies):
    rng = random.Random(2)
    texts = [None, "", " \t", "a b", "ab", "a\x0bb", "a b", "é" * 3, "ÉÉÉ", "x" * 300_000, "x" * 300_000 + " ", "License " + "y" * 50 + "1", "License " + "y" * 50 + "2"]
    texts += [rng.choice(["p q", "pq ", "r", "s t u"]) for _ in range(60)] + ["hot text", "hottext"] * copies
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, "ab"), (5, "z"), (5, "z"), (None, "only"), (None, "only")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, norm string, h int").repartition(4)
    got = exact_dedup.dedup(df).collect()
    want, groups = brute(rows)
    key = lambda r: tuple((v is None, v or 0) for v in r[:3]) + (r[3],)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    rows_back = exact_dedup.dedup(df, keep_columns=True).where("kept").select("row.*")
    assert rows_back.columns == df.columns and rows_back.count() == groups


def test_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_agrees_on_a_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = sorted(tuple(r) for r in exact_dedup.dedup(spark.read.parquet(path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    duckdb.sql(f"create or replace view documents as select * from '{path}'")
    assert got == sorted(duckdb.sql(exact_dedup.ORACLE).fetchall())


@pytest.mark.parametrize("hot", [False, True])
def test_texts_are_range_partitioned_and_shuffled_once(spark, hot):
    rows = [(i, "hot" if hot and i % 2 else f"text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = exact_dedup.dedup(df)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    if hot:  # the hot groups' aggregate stands beside the window
        window = window[: window.index("BroadcastExchange")] if "BroadcastExchange" in window else window
    assert "rangepartitioning(head" in window and "hashpartitioning(head" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_and_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, "x", "y"), (2, "ab", 2, "x", "y")], "doc_id long, text string, kept int, `a.b` string, salt string")
    out = exact_dedup.dedup(df, keep_columns=True)
    assert [tuple(r) for r in out.where("kept").select("row.*").collect()] == [(1, "a b", 1, "x", "y")]
