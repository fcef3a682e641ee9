import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gridweft.functions import cells, semantics
from gridweft.functions.cells import Box, Cell, IntBox, Relation
from gridweft.operators import inspect, layers, predicates, sample
from gridweft.operators.overlay import Dominance
from gridweft.plans.builder import Builder
from gridweft.plans.tree import EMPTY, Link, Merge, Raster, full, merge, query
from gridweft.sources.arrays import DataMapping, explode_buffers, from_arrays, rasterise, read_points, read_polygon, to_array
from gridweft.sources.store import Store


def raster(spark, ox, oy, e, w, h, data, layer="heights1d", split=8, mask=None):
    return from_arrays(spark, DataMapping(Cell(ox, oy, e), w, h), {layer: data}, mask, split)


def grid(spark):
    return raster(spark, 0, 0, 0, 10, 7, [x + y / 100 for y in range(7) for x in range(10)], "heights1f", 2)


def values(df, layer="heights1d"):
    return {(r.x, r.y, r.e): r[layer] for r in df.collect()}


def test_selections_on_the_grid(spark):
    g = grid(spark)
    n = lambda p: query(g, p).count()
    assert n(predicates.everything()) == 70
    assert [n(predicates.inside_cell(Cell(*c))) for c in ((0, 0, 4), (1, 0, 4), (0, 0, 3), (4, 2, -1))] == [70, 0, 56, 0]
    one = query(g, predicates.inside_cell(Cell(2, 1, 0))).collect()
    assert len(one) == 1 and one[0].heights1f == pytest.approx(2.01)
    assert [n(predicates.intersects_cell(Cell(*c))) for c in ((0, 0, 4), (1, 0, 4), (0, 0, 3), (2, 1, 0))] == [70, 0, 56, 1]
    around = query(g, predicates.intersects_cell(Cell(4, 2, -1))).collect()
    assert [(r.x, r.y, r.e) for r in around] == [(2, 1, 0)]
    assert [n(predicates.inside_box(Box(*b))) for b in ((0, 0, 10, 7), (10, 1, 100, 100), (-1, -1, 5, 3))] == [70, 0, 15]
    six = [(3.9, -0.1), (10.1, -0.1), (10.1, 7.1), (8.1, 7.1), (8.1, 4.1), (3.9, 4.1)]
    five = [(0, 0), (5, 0), (4, 4), (4.0, 4.5), (0, 4)]
    assert [n(predicates.inside_polygon(p)) for p in (six, six[::-1], [(4, 7), (10, 8), (6, 15)], five)] == [30, 30, 0, 18]
    assert [n(predicates.near_line(*a)) for a in (((0, 0), (10, 7), 10.0), ((10, -2), (10, 7), 1.0), ((0, 0), (3, 4), 1.0))] == [70, 0, 16]
    assert n(predicates.near_line((5, 3), (1, 0), 0.6, half_line=True)) < n(predicates.near_line((5, 3), (1, 0), 0.6))
    assert n(predicates.generic(lambda: F.col("x") == F.col("y"))) == 7
    assert query(g, predicates.everything(), min_exponent=2).count() == 70
    with pytest.raises(ValueError):
        query(g, predicates.everything(), min_exponent=3)


def test_polygon_edges_count_as_inside(spark):
    r = raster(spark, 0, 0, 0, 3, 4, [float(i) for i in range(12)])
    got = values(query(r, predicates.inside_polygon([(0, 0), (2, 2), (3, 2), (3, 0), (0, 0)])))
    assert set(got) == {(0, 0, 0), (1, 0, 0), (2, 0, 0), (1, 1, 0), (2, 1, 0)}


def test_two_layers_near_a_line(spark):
    r = from_arrays(spark, DataMapping(Cell(500000, 2000, 0), 4, 3), {"heights1d": [1.0, 1.0, 2.0, 2.0, 1.5, 1.6, 1.7, 1.8, 1.6, 1.7, 2.0, 2.2], "colors3b": [(255, i, 0) for i in range(4)] + [(0, 255, 1), (1, 255, 1), (2, 255, 1), (3, 255, 1)] + [(i, 2, 255) for i in range(4)]})
    got = query(r, predicates.near_line((500000, 2000), (1, 1), 0.5)).orderBy("x").collect()
    assert [(g.x - 500000, g.heights1d, tuple(g.colors3b)) for g in got] == [(0, 1.0, (255, 0, 0)), (1, 1.6, (1, 255, 1)), (2, 2.0, (2, 2, 255))]


def test_overlay_goldens(spark):
    a = raster(spark, 0, 0, 0, 1, 1, [10.0])
    b = raster(spark, 1, 0, -1, 2, 1, [20.0, 20.0])
    want = {(1, 0, -1): 20, (2, 0, -1): 20, (0, 0, -1): 10, (0, 1, -1): 10, (1, 1, -1): 10}
    assert values(merge(Dominance.SECOND, a, b).samples) == want
    l1 = raster(spark, 0, 0, 1, 2, 2, [1.0, 2.0, 3.0, 4.0])
    deep = raster(spark, 2, 0, -1, 2, 2, [91.0, 92.0, 93.0, 94.0])
    want = {(0, 0, 0): 1, (0, 1, 0): 1, (1, 1, 0): 1, (2, 0, -1): 91, (3, 0, -1): 92, (2, 1, -1): 93, (3, 1, -1): 94, (1, 0, 1): 2, (0, 1, 1): 3, (1, 1, 1): 4}
    assert values(merge(Dominance.SECOND, l1, deep).samples) == want
    assert values(merge(Dominance.FIRST, l1, deep).samples) == values(l1.df)
    l0 = raster(spark, 2, 0, 0, 2, 2, [-1.0, -2.0, -3.0, -4.0])
    lm = raster(spark, 4, 0, -1, 2, 2, [91.0, 92.0, 93.0, 94.0])
    chain = merge(Dominance.SECOND, merge(Dominance.SECOND, l1, l0), lm)
    want = {(0, 0, 1): 1, (4, 0, -1): 91, (5, 0, -1): 92, (4, 1, -1): 93, (5, 1, -1): 94, (3, 0, 0): -2, (2, 1, 0): -3, (3, 1, 0): -4, (0, 1, 1): 3, (1, 1, 1): 4}
    assert values(chain.samples) == want
    fine = raster(spark, 0, 0, -1, 4, 4, [float(i) for i in range(1, 17)])
    coarse = raster(spark, 0, 0, 0, 1, 1, [50.0])
    got = values(merge(Dominance.SECOND, fine, coarse).samples)
    assert len(got) == 13 and got[0, 0, 0] == 50 and got[2, 1, -1] == 7
    for d in (Dominance.MORE_DETAILED_OR_FIRST, Dominance.MORE_DETAILED_OR_SECOND):
        assert values(merge(d, coarse, fine).samples) == values(fine.df)
    nan = (math.nan,) * 4
    ob = (1.5, 1.0, 0.0, 0.0)
    planes = raster(spark, 0, 0, 0, 3, 3, [nan, nan, nan, ob, ob, nan, ob, ob, nan], "volumes_bilinear4f")
    tiny = raster(spark, 4, 4, -2, 1, 1, [(3.0, 0.0, 0.0, 0.0)], "volumes_bilinear4f")
    assert merge(Dominance.SECOND, planes, tiny).samples.count() == 15
    assert {(r.x, r.y, r.e) for r in merge(Dominance.SECOND, planes, tiny).samples.where("e < 0").collect()} == {(3, 2, -1), (2, 3, -1), (3, 3, -1), (4, 4, -2), (5, 4, -2), (4, 5, -2), (5, 5, -2)}


def brute(x, y):
    """All of x; y split where x has cells."""
    box = lambda c: Cell(*c).box
    out = dict(x)

    def resolve(c, src):
        hits = [b for b in x if box(b).intersects(box(c))]
        if not hits:
            out[c] = y[src]
        elif not any(box(b).contains(box(c)) for b in hits):
            for q in Cell(*c).children:
                resolve((q.x, q.y, q.e), src)

    for c in y:
        resolve(c, c)
    return out


def random_cells(rng, n, value):
    out = {}
    for i in range(n):
        c = (rng.randint(-9, 8), rng.randint(-9, 8), rng.randint(-2, 2))
        if not any(Cell(*c).box.intersects(Cell(*o).box) for o in out):
            out[c] = value + i
    return out


def mixed(spark, own):
    df = spark.createDataFrame([(e, x, y, float(v)) for (x, y, e), v in own.items()], "e int, x long, y long, heights1d double")
    return Raster(df, tuple(sorted({c[2] for c in own})))


@pytest.mark.parametrize("seed", range(4))
def test_random_overlays(spark, seed):
    rng = random.Random(seed)
    a, b = random_cells(rng, 40, 0), random_cells(rng, 40, 1000)
    ra, rb = mixed(spark, a), mixed(spark, b)
    assert values(merge(Dominance.FIRST, ra, rb).samples) == brute(a, b)
    assert values(merge(Dominance.SECOND, ra, rb).samples) == brute(b, a)
    want = {}
    for level in range(-2, 3):
        own = {c: v for c, v in b.items() if c[2] == level} | {c: v for c, v in a.items() if c[2] == level}
        want = brute(want, own)
    tree = merge(Dominance.MORE_DETAILED_OR_FIRST, ra, rb)
    assert values(tree.samples) == want
    area = lambda cs: sum(4.0 ** c[2] for c in cs)
    assert area(want) <= area(a) + area(b)
    box = Box(-3.25, -2, 4.5, 6)
    got = values(query(Merge(Dominance.SECOND, ra, rb), predicates.inside_box(box)))
    assert got == {c: v for c, v in brute(b, a).items() if box.contains(Cell(*c).box)}
    pts = [(i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(60)]
    df = spark.createDataFrame(pts, "pid long, px double, py double")
    for d, order in ((Dominance.FIRST, (a, b)), (Dominance.SECOND, (b, a))):
        got = {r.pid: r.heights1d for r in sample.positions(merge(d, ra, rb), df).collect()}
        hit = lambda s, p: next((v for c, v in s.items() if Cell(*c).box.x0 <= p[1] < Cell(*c).box.x1 and Cell(*c).box.y0 <= p[2] < Cell(*c).box.y1), None)
        want = {p[0]: v for p in pts if (v := hit(order[0], p) if hit(order[0], p) is not None else hit(order[1], p)) is not None}
        assert got == want


def test_filter_first_and_bbox_elimination(spark):
    a = raster(spark, 0, 0, 0, 3, 3, [1.0] * 9, mask=[1, 1, 1, 1, 0, 1, 1, 1, 1])
    b = raster(spark, 1, 1, 0, 1, 1, [5.0])
    assert values(merge(Dominance.FIRST, a, b).samples)[1, 1, 0] == 5
    assert (1, 1, 0) not in values(merge(Dominance.FIRST, a, b, bbox_elimination=True).samples)
    big, small = raster(spark, 0, 0, 1, 1, 1, [1.0]), raster(spark, 0, 0, 0, 2, 1, [2.0, 3.0])
    p = predicates.inside_box(Box(0, 0, 1, 2))
    assert values(query(merge(Dominance.FIRST, big, small), p)) == {}
    assert values(query(Merge(Dominance.FIRST, big, small), p, filter_first=True)) == {(0, 0, 0): 2}


def test_sampling(spark):
    g = grid(spark)
    pts = spark.createDataFrame([(i, 0.5 + i, 0.5 + i) for i in range(5)] + [(9, 50.0, 1.0)], "pid long, px double, py double")
    assert sample.positions(g, pts).count() == 5
    assert sample.positions(g, pts, whole_or_nothing=True).count() == 0
    assert sample.positions(g, pts, min_exponent=1).count() == 0
    assert sample.value_at(g, 2.5, 1.5, "heights1f") == pytest.approx(2.01) and sample.value_at(g, -1, 0, "heights1f") is None
    assert sample.cell_at(g, 2.5, 1.5) == Cell(2, 1, 0) and sample.cell_at(g, 99, 0) is None
    keys = spark.createDataFrame([(-1, 5, 3), (0, 20, 3), (0, -4, -4)], "qe int, qx long, qy long")
    got = {(r.qe, r.qx): r.value for r in sample.at_cells(g, keys, "heights1f", sample.Border.CLAMP_TO_EDGE).collect()}
    assert got[-1, 5] == pytest.approx(2.01) and got[0, 20] == pytest.approx(9.03) and got[0, -4] == 0
    got = {r.qx: r.value for r in sample.at_cells(g, keys, "heights1f", sample.Border.CLAMP_TO_BORDER, -7.0).collect()}
    assert got[20] == -7
    with pytest.raises(Exception):
        sample.at_cells(g, keys, "heights1f").collect()


def test_layer_algebra(spark):
    r = raster(spark, 0, 0, 0, 2, 1, [1.0, 2.0])
    assert values(layers.supersample(r.df, -1, (0,))) == {(x, y, -1): 1.0 + (x > 1) for x in range(4) for y in range(2)}
    with pytest.raises(ValueError):
        layers.supersample(r.df, 1, (0,))
    rows = [(0, 0, 0, 0, -(2**31), (1, 1, 1)), (1, 0, 0, 0, 7, (2, 2, 2)), (2, 0, 0, 0, 9, (0, 0, 0)), (0, 0, 1, 0, 3, None), (1, 0, 1, 0, -(2**31), (0, 0, 0))]
    p = spark.createDataFrame(rows, "patch_seq long, e int, x long, y long, intensities1i int, colors3b struct<r:short,g:short,b:short>")
    got = {r.x: (r.intensities1i, tuple(r.colors3b)) for r in layers.merge_layers(p).collect()}
    assert got == {0: (7, (1, 1, 1)), 1: (3, (0, 0, 0))}
    got = {r.x: (r.intensities1i, tuple(r.colors3b)) for r in layers.flatten_layers(p, (0,)).collect()}
    assert got == {0: (9, (2, 2, 2)), 1: (3, (0, 0, 0))}
    nan = spark.createDataFrame([(0, 0, 0, 0, 1.0), (1, 0, 0, 0, math.nan)], "patch_seq long, e int, x long, y long, heights1d double")
    assert math.isnan(layers.flatten_layers(nan, (0,)).first().heights1d) and layers.merge_layers(nan).first().heights1d == 1.0
    side = raster(spark, 1000, 500, 0, 20, 10, [1.0] * 200), raster(spark, 1020, 500, 0, 20, 10, [2.0] * 200)
    both = layers.merge_layers(Builder().add_range(side).patches())
    assert tuple(both.agg(*cells.bounding_box()).first()) == (1000, 500, 1040, 510)


def test_coarser_kernels(spark):
    data = {"heights1f": [1.0, 2.0, 3.0, 4.0], "intensities1i": [-1, -2, -3, -1], "colors3b": [(255, 0, 1), (255, 1, 1), (255, 1, 1), (254, 1, 0)], "normals3d": [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]}
    data["intensities1l"] = [2**62, 2**62, 2**62, 2**62]
    r = from_arrays(spark, DataMapping(Cell(-2, -2, 0), 2, 2), data)
    got = layers.coarser(r.df).collect()
    assert [(g.e, g.x, g.y) for g in got] == [(1, -1, -1)]
    assert got[0].heights1f == 2.5 and got[0].intensities1i == -1 and tuple(got[0].colors3b) == (254, 0, 0) and got[0].intensities1l == 0
    assert tuple(got[0].normals3d) == pytest.approx((math.sqrt(0.5), math.sqrt(0.5), 0))
    assert layers.pyramid(r.df, 1).count() == 5


def test_builder(spark):
    b = Builder(2).add_range([raster(spark, 0, 0, 1, 2, 2, [1.0, 2.0, 3.0, 4.0]), raster(spark, 2, 0, -1, 2, 2, [91.0, 92.0, 93.0, 94.0]), raster(spark, 1, 1, 1, 1, 1, [9.0])])
    folded, flat = values(b.build().samples), values(b.build_flat().samples)
    assert folded[1, 1, 1] == 9 and folded[2, 0, -1] == 91 and folded[0, 0, 0] == 1 and len(folded) == 10
    assert len(flat) == 64 and {k[2] for k in flat} == {-1} and flat[2, 0, -1] == 91 and flat[7, 7, -1] == 9
    assert Builder().build() is EMPTY and Builder().build_flat() is EMPTY
    with pytest.raises(ValueError):
        b.add(raster(spark, 0, 0, 0, 1, 1, [1.0], "heights1f"))
    assert len(b.describe()) == 3


def test_trees_and_counts(spark):
    g = grid(spark)
    assert inspect.count_leaf_nodes(g) == 6
    for split, leaf, nodes in ((2, 1, 1), (1, 4, 5)):
        r = raster(spark, -2, -2, 0, 4, 4, [1.0] * 16, split=split)
        assert (inspect.count_leaf_nodes(r), inspect.count_nodes(r)) == (leaf, nodes)
    r = raster(spark, -1, -1, 0, 2, 2, [1.0] * 4, split=0)
    assert (inspect.count_leaf_nodes(r), inspect.count_nodes(r)) == (4, 5)
    m = merge(Dominance.SECOND, g, raster(spark, 0, 0, -1, 1, 1, [1.0], "heights1f"))
    assert inspect.count_merge_nodes(Link(m)) == 1 and merge(Dominance.FIRST, EMPTY, g) is g and merge(Dominance.FIRST, g, EMPTY) is g
    assert full(m).count() == 71 and [type(t).__name__ for t in inspect.nodes(m, True)] == ["Merge", "Raster", "Raster"]
    assert "merge SECOND" in inspect.structure(m) and "<rect" in inspect.to_html(g.df, "heights1f")
    assert m.renamed("heights1f", "volumes1f").layers == ("volumes1f",) and m.renamed("nope", "x") is m
    with pytest.raises(ValueError):
        g.renamed("heights1f", "heights1f")
    with pytest.raises(ValueError):
        g.layer("nope")
    assert g.try_layer("nope") is None and g.contains_layer("heights1f")
    assert g.with_window(IntBox(2, 2, 4, 5)).df.count() == 6 and g.with_window(IntBox(50, 0, 60, 9)) is None
    assert merge(Dominance.FIRST, g, raster(spark, 1, 1, 0, 2, 2, [1.0] * 4, "heights1f")) is g
    assert g.root_cell() == Cell(0, 0, 4) and EMPTY.samples.count() == 0


def test_store(spark, tmp_path):
    g, b = grid(spark), raster(spark, 1, 0, -1, 2, 1, [20.0, 20.0], "heights1f")
    tree = merge(Dominance.SECOND, g, Link(b))
    disk, other, memory = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"{tmp_path}/b", cache=True), Store(spark, cache=True)
    want = values(tree.samples, "heights1f")
    for s in (disk, memory):
        key = s.save(tree)
        assert s.save(tree) == key and s.exists(key) and values(s.load(key).samples, "heights1f") == want
        assert len(s.keys(key)) == 4
    seen = []
    assert disk.export(other, tree.id, lambda i, n: seen.append((i, n)), "copy") == 4 and seen == [(1, 2), (2, 2)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert values(other.load(tree.id).samples, "heights1f") == want
    assert disk.load("nope") is EMPTY and disk.keys("nope") == []
    plan = query(disk.load(g.id), predicates.inside_cell(Cell(2, 1, 0)))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo\(x,2\)|GreaterThanOrEqual\(x,2\))", plan), plan
    name = disk.save_patches(Builder().add(g).patches())
    assert disk.load_patches(name).count() == 70 and disk.patch_exponents(name) == (0,)
    other.release()


def test_sources(spark, tmp_path):
    (tmp_path / "points.txt").write_text("x y z\n0.5 0.5 1\n-0.5 0.25 2\n0.75 0.1 3\n")
    (tmp_path / "ring.txt").write_text("0,0\n4,0\n4,4\n")
    pts = read_points(spark, str(tmp_path / "points.txt"), {"px": 0, "py": 1, "heights1d": 2})
    assert values(rasterise(pts, 0, ["heights1d"]).df) == {(0, 0, 0): 3, (-1, 0, 0): 2}
    assert values(rasterise(pts, 0, ["heights1d"], truncate=True).df) == {(0, 0, 0): 3}
    assert read_polygon(spark, str(tmp_path / "ring.txt")) == [(0, 0), (4, 0), (4, 4)]
    m = DataMapping(Cell(3, -2, 1), 3, 2)
    r = from_arrays(spark, m, {"heights1d": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}, mask=[1, 0, 1, 1, 1, 1])
    assert to_array(r.df, m, "heights1d", -1.0) == [1, -1, 3, 4, 5, 6]
    assert m.index(4, -1) == 4 and m.cell_at(7.9, -3.0) == Cell(3, -2, 1) and DataMapping.of_max(Cell(3, -2, 1), (5, -1)) == m
    assert m.with_window(IntBox(0, 0, 1, 1)) is None and m.contains(Cell(5, -1, 1)) and not m.contains(Cell(6, -1, 1))
    buf = spark.createDataFrame([(0, 5, 6, 2, [1.0, 2.0, 3.0, 4.0])], "e int, ox long, oy long, w int, data array<double>")
    assert values(explode_buffers(buf, "heights1d")) == {(5, 6, 0): 1, (6, 6, 0): 2, (5, 7, 0): 3, (6, 7, 0): 4}
    for bad in (lambda: DataMapping(Cell(0, 0, 1, True), 1, 1), lambda: from_arrays(spark, m, {}), lambda: from_arrays(spark, m, {"heights1d": [1.0]}), lambda: DataMapping(Cell(0, 0, 0), 2, 2, IntBox(0, 0, 3, 1))):
        with pytest.raises(ValueError):
            bad()


def test_cells_and_boxes():
    assert Cell.of_box(Box(0, 0, 8, 8)).e == 4 and Cell.of_box(Box(0, 0, 4, 4)).e == 3 and Cell.of_box(Box(7, 0, 8, 1)) == Cell(0, 0, 4)
    assert Cell.of_box(Box(-2, -2, 2, 2)) == Cell(0, 0, 2, True) and Cell.of_box(Box(-2, 0.5, 0, 2)).x == -1
    assert Cell(5, -3, 0).parent == Cell(2, -2, 1) and Cell(5, -3, 0).quadrant == 3 and Cell(0, 0, 3, True).children[0] == Cell(-1, -1, 2)
    assert Cell(1, 1, 0).relation(Cell(0, 0, 1)) is Relation.SECOND_CONTAINS and Cell(1, 1, 0).relation(Cell(3, 1, 0)) is Relation.DISJOINT
    assert Cell(0, 0, 2, True).relation(Cell(0, 0, 2)) is Relation.PARTIAL and Cell(1, 2, 3).relation(Cell(1, 2, 3)) is Relation.IDENTICAL
    assert Cell(1, 2, 3).bounds(1) == IntBox(4, 8, 8, 12) and Cell(5, 6, 0).bounds(2) == IntBox(1, 1, 2, 2) and Cell(0, 0, 3, True).bounds(0) == IntBox(-4, -4, 4, 4)
    assert Cell(0, 0, 0).union(Cell(3, 3, 0)).contains(Cell(3, 3, 0))
    b = IntBox(0, 0, 4, 4)
    assert b.has_box(IntBox(0, 0, 3, 3)) and not b.has_box(b) and b.covers(b) and not b.intersects(IntBox(4, 0, 5, 5)) and b.intersection(IntBox(2, 2, 9, 9)) == IntBox(2, 2, 4, 4)
    assert b.square_power_of_two() and not IntBox(0, 0, 3, 3).square_power_of_two() and len(b.split_at_center()) == 4 and b.has_point(0, 3) and not b.has_point(0, 4)
    assert not Box(0, 0, 1, 1).intersects(Box(1, 0, 2, 1)) and Box(0, 0, 1, 1).contains(Box(0, 0, 1, 1))


def test_registry():
    assert len(semantics.REGISTRY) >= 23 and semantics.semantic("colors4b").components == tuple("rgba")
    assert semantics.semantic("heights1d").id == semantics.semantic("heights1d").id
    with pytest.raises(ValueError):
        semantics.register(semantics.Semantic("heights1d", "", "float"))
    with pytest.raises(ValueError):
        semantics.semantic("nothing")


def test_streamed_patches(spark, tmp_path):
    from gridweft.streaming.patches import append_patches

    store = Store(spark, str(tmp_path / "s"))
    src = str(tmp_path / "in")
    Builder().add(grid(spark)).patches().write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for _ in range(2):
        append_patches(stream, store, "p", str(tmp_path / "cp"), ["patch_seq", "e", "x", "y"]).awaitTermination(120)
    assert store.load_patches("p").count() == 70


@pytest.mark.parametrize("split", [0, 1, 3, 4, 6])
def test_tiles_of_cells_that_repeat(spark, split):
    rng = random.Random(split)
    rows = [(rng.choice((-1, 0, 2)), rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(700)]
    rows += rows[:300] + [(0, x, y) for x in range(-64, 0) for y in range(64)] + [(0, None, 3), (0, None, 3), (0, None, 4), (0, 5, None), (2, None, None)]
    up = lambda v: None if v is None else v >> split
    tiles = {}
    for e, x, y in set(rows):
        tiles.setdefault((e + split, up(x), up(y), e), []).append((x, y))
    want = set()
    for key, inside in tiles.items():
        xs, ys = ([p[k] for p in inside if p[k] is not None] for k in (0, 1))
        x0, x1 = (min(xs), max(xs) + 1) if xs else (None, None)
        y0, y1 = (min(ys), max(ys) + 1) if ys else (None, None)
        s = 2.0 ** key[3]
        holes = len(inside) < (x1 - x0) * (y1 - y0) if xs and ys else None
        want.add((*key, split, x0, y0, x1, y1, *[None if v is None else v * s for v in (x0, y0, x1, y1)], len(inside), holes))
    df = spark.createDataFrame(rows, "e int, x long, y long").repartition(5)
    got = inspect.tiles_of(df, split)
    assert [f.dataType.typeName() for f in got.schema] == ["integer", "long", "long", "integer", "integer", *["long"] * 4, *["double"] * 4, "long", "boolean"]
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(want) and set(listed) == want
    unique = inspect.tiles(Raster(df.distinct(), (-1, 0, 2), split))
    assert {tuple(r) for r in unique.collect()} == want
