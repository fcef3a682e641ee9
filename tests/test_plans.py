import re

import pytest

from gridweft import queries
from gridweft.functions.cells import Box
from gridweft.operators import predicates, sample
from gridweft.operators.overlay import Dominance
from gridweft.plans import builder
from gridweft.plans.tree import Raster, merge, query

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Functions of the user run in Python.
OWN = {"leaf_generator"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OWN))
def test_no_products_and_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", text)


def stored(spark, tmp_path, name, df, exponents):
    df.write.parquet(f"{tmp_path}/{name}")
    return Raster(spark.read.parquet(f"{tmp_path}/{name}"), exponents)


def test_a_box_reaches_every_scan_of_an_overlay(spark, tmp_path):
    fine = stored(spark, tmp_path, "fine", queries.r_orders_s(spark, SF).df, (-1,))
    coarse = stored(spark, tmp_path, "coarse", queries.r_coarse(spark, SF).df, (2,))
    text = plan(query(merge(Dominance.SECOND, coarse, fine), predicates.inside_box(Box(3, 0, 9, 3))))
    scans = re.findall(r"FileScan parquet[^\n]*", text)
    assert scans and all("GreaterThanOrEqual(x," in s and "LessThanOrEqual(y," in s for s in scans)
    # scans that only place cells don't read values
    assert any("heights" not in s.split("ReadSchema")[1] for s in scans)


def test_a_selection_reads_only_what_it_needs(spark, tmp_path):
    part = stored(spark, tmp_path, "part", queries.r_part(spark, SF).df, (0,))
    df = query(part, predicates.inside_polygon([(1, 1), (9, 1), (9, 9)])).select("e", "x", "y", "heights")
    scan = re.findall(r"FileScan parquet[^\n]*", plan(df))[0]
    assert "intensity" not in scan and "GreaterThanOrEqual(x," in scan
    assert "Exchange" not in plan(df)


def broadcasts(text):
    """The sources of what a plan broadcasts, as far as they are above the next exchange."""
    found, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = line.index("BroadcastExchange")
            below = lines[i + 1:]
            end = next((k for k, x in enumerate(below) if len(re.match(r"[\s:+\-]*", x)[0]) <= deep), len(below))
            found.append("\n".join(below[:end]))
    return found


def test_samples_are_never_broadcast_to_place_them(spark, tmp_path, monkeypatch):
    """Lists made on the driver are broadcast, the samples joined with them or with each other in an overlay aren't: a few MB of files are millions of cells."""
    seen = []
    whole = builder.cut

    def cut(df):
        seen.append(plan(df))
        return whole(df)

    monkeypatch.setattr(builder, "cut", cut)
    seen.append(plan(queries.QUERIES["builder_adaptive"](spark, SF)))
    part = stored(spark, tmp_path, "part", queries.r_part(spark, SF).df, (0,))
    seen.append(plan(sample.position(part, 3.5, 2.5)))
    seen.append(plan(queries.QUERIES["overlay_chain"](spark, SF)))
    sources = [b for text in seen for b in broadcasts(text)]
    assert sources and not [b for b in sources if "FileScan" in b or "Scan parquet" in b]


def test_two_exponents_of_one_patch_are_both_kept_in_a_region(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 1, 0, 2.0)], "patch_seq long, e int, x long, y long, heights1d double")
    got = builder.Builder(2).add_table(rows).build_adaptive().samples
    assert {(r.e, r.x, r.y, r.heights1d) for r in got.collect()} == {(0, 0, 0, 1.0), (1, 1, 0, 2.0)}


def test_tiles_are_aggregated_without_a_group_for_each_cell(spark):
    """Rows of tile_counts that share a tile make one group from the first aggregate on."""
    text = plan(queries.QUERIES["tile_counts"](spark, SF))
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text)
    assert keys and not [k for k in keys if re.search(r"\b[xy]#", k)]
    assert text.count("Exchange hashpartitioning") == 1
