"""More registered queries, for the parts of the engine that queries.py leaves out: sources, stores, helpers, kernels, tile functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import cells
from .functions.cells import Box, Cell, IntBox
from .operators import inspect, layers, predicates, sample
from .operators.overlay import Dominance
from .operators.predicates import SampleMode
from .plans import builder
from .plans.tree import Link, Raster, merge, per_tile, query
from .queries import FRAGMENTS, ORACLES, OUT, _heights, _mixed, _pair, _table, overlay_cte, points, r_coarse, r_orders, r_part, registered, sql
from .sources.arrays import DataMapping, explode_buffers, from_arrays, rasterise, read_points
from .sources.store import Store
from .sources.tables import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# sources


@registered("SELECT 0 AS e, (3 + i % 4)::BIGINT AS x, (-2 + i // 4)::BIGINT AS y, (i * 1.5)::DOUBLE AS heights1d FROM range(12) t(i) WHERE i % 5 <> 3 AND 3 + i % 4 >= 4")
def array_source(spark, sf):
    """A flat array with a mask and a window."""
    mapping = DataMapping(Cell(3, -2, 0), 4, 3, IntBox(4, -2, 7, 1))
    return from_arrays(spark, mapping, {"heights1d": [i * 1.5 for i in range(12)]}, [int(i % 5 != 3) for i in range(12)]).samples.select("e", "x", "y", "heights1d")


@registered("SELECT -1 AS e, ox + i % 3 AS x, oy + i // 3 AS y, (p + i)::DOUBLE AS v FROM (SELECT p_partkey % 9 * 3 AS ox, p_partkey // 9 * 2 AS oy, p_partkey AS p FROM part), range(6) t(i)")
def buffer_source(spark, sf):
    """One small array a row, exploded where it lies."""
    k = F.col("p_partkey")
    data = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (k + i).cast("double"))
    return explode_buffers(_table(spark, sf, "part").select(F.lit(-1).alias("e"), (k % 9 * 3).alias("ox"), (F.floor(k / 9) * 2).alias("oy"), F.lit(3).alias("w"), data.alias("data")), "v")


@registered("SELECT i, (3 + i % 4) AS x, (-2 + i // 4) AS y, i AS index, 3 + i % 4 BETWEEN 4 AND 6 AS inside, 3 + i % 4 AS px_cell FROM range(12) t(i)")
def mapping_helpers(spark, sf):
    m = DataMapping(Cell(3, -2, 0), 4, 3, IntBox(4, -2, 7, 1))
    rows = [(i, x := 3 + i % 4, y := -2 + i // 4, m.index(x, y), m.contains(Cell(x, y, 0)), m.cell_at(x + 0.5, y + 0.5).x) for i in range(12)]
    return spark.createDataFrame(rows, "i long, x long, y long, index long, inside boolean, px_cell long")


@registered(sql("SELECT 2 AS e, x >> 2 AS x, y >> 2 AS y, max_by(heights, y * 64 + x) AS heights FROM r_part GROUP BY x >> 2, y >> 2"))
def point_file(spark, sf):
    """A written point file, read back and rasterised: of several points in a cell the last line wins."""
    where = _folder(spark, "points")
    rows = _heights(r_part(spark, sf)).df.repartitionByRange(3, "y", "x").sortWithinPartitions("y", "x")
    rows.select((F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"), "heights").write.csv(where, sep=" ")
    return rasterise(read_points(spark, where, {"px": 0, "py": 1, "heights": 2}, header=False), 2, ["heights"]).df


# stores


@registered(sql("SELECT e, x, y, heights FROM r_part"))
def memory_store(spark, sf):
    store = Store(spark)
    return store.load(store.save(_heights(r_part(spark, sf)))).samples.select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part"))
def cached_store(spark, sf):
    store = Store(spark, _folder(spark, "store"), cache=True)
    return store.load(store.save(_heights(r_part(spark, sf)))).samples.select(*OUT)


@registered(ORACLES["overlay_second"])
def roundtrip_merge(spark, sf):
    """A link to a merge, saved and loaded: the manifests bring the overlay back."""
    store = Store(spark, _folder(spark, "store"))
    return store.load(store.save(Link(_pair(spark, sf, Dominance.SECOND)))).samples.select(*FRAGMENTS)


@registered(ORACLES["overlay_first"])
def export_store(spark, sf):
    a, b = Store(spark, _folder(spark, "store")), Store(spark, _folder(spark, "store"))
    tree = _pair(spark, sf, Dominance.FIRST)
    a.export(b, a.save(tree))
    return b.load(tree.id).samples.select(*FRAGMENTS)


@registered("SELECT 4::BIGINT AS keys, true AS found, false AS missing")
def store_keys(spark, sf):
    """A link, its merge and both bases have a key each."""
    store = Store(spark, _folder(spark, "store"))
    key = store.save(Link(_pair(spark, sf, Dominance.SECOND)))
    return spark.createDataFrame([(len(set(store.keys(key))), store.exists(key), store.exists("none"))], "keys long, found boolean, missing boolean")


@registered(sql("SELECT e, x, y, heights, intensity FROM r_part"))
def roundtrip_layers(spark, sf):
    """Two layers of two types, saved and loaded together."""
    store = Store(spark, _folder(spark, "store"))
    return store.load(store.save(r_part(spark, sf))).samples.select("e", "x", "y", "heights", "intensity")


@registered(ORACLES["layer_flatten"])
def roundtrip_builder(spark, sf):
    store = Store(spark, _folder(spark, "store"))
    name = builder.Builder(4).add_table(_mixed(spark, sf)).save(store)
    return builder.Builder.load(store, name, 4).build_flat().samples.select(*OUT)


@registered(ORACLES["layer_flatten"])
def export_builder(spark, sf):
    """Patches and their key file to another store, and a builder of them there."""
    a, b = Store(spark, _folder(spark, "store")), Store(spark, _folder(spark, "store"))
    key = builder.Builder(4).add_range([_heights(r_part(spark, sf)), r_orders(spark, sf, 3), r_coarse(spark, sf)]).export(a, "patches")
    b.import_patches(a, key)
    return builder.Builder.import_(b, b.key_file("patches"), 4).build_flat().samples.select(*OUT)


# cells, boxes, positions


@registered(sql("SELECT x, y, (y + 8) * 200 + x + 40 AS index, (x < 3) <> (x + 5 < 3) OR (y < 1) <> (y - 2 < 1) AS apart FROM r_part_c"))
def buffer_positions(spark, sf):
    """Places in a buffer, and whether two points are in different quadrants about a centre."""
    from .queries import r_part_c

    x, y = F.col("x"), F.col("y")
    return r_part_c(spark, sf).df.select("x", "y", cells.buffer_index(x, y, (-40, -8), 200).alias("index"), cells.different_quadrants(x, y, x + 5, y - 2, 3.0, 1.0).alias("apart"))


@registered(sql("""SELECT least(a0, b0) AS ux0, least(a1, b1) AS uy0, greatest(a2, b2) AS ux1, greatest(a3, b3) AS uy1, a0 < b2 AND b0 < a2 AND a1 < b3 AND b1 < a3 AS touch, a0 <= b0 AND a1 <= b1 AND a2 >= b2 AND a3 >= b3 AS holds
FROM (SELECT min(x)::DOUBLE AS a0, min(y)::DOUBLE AS a1, max(x) + 1::DOUBLE AS a2, max(y) + 1::DOUBLE AS a3 FROM r_part_c), (SELECT min(x) * 0.5::DOUBLE AS b0, min(y) * 0.5::DOUBLE AS b1, (max(x) + 1) * 0.5::DOUBLE AS b2, (max(y) + 1) * 0.5::DOUBLE AS b3 FROM r_orders)"""))
def box_algebra(spark, sf):
    from .queries import r_part_c

    a, b = r_part_c(spark, sf).bounding_box(), r_orders(spark, sf).bounding_box()
    u = a.union(b)
    return spark.createDataFrame([(u.x0, u.y0, u.x1, u.y1, a.intersects(b), a.contains(b))], "ux0 double, uy0 double, ux1 double, uy1 double, touch boolean, holds boolean")


_CELLS = [(0, 0, 2), (1, 1, 0), (3, 3, 0), (4, 0, 0), (0, 0, 3), (-1, 0, 1), (0, 0, 0)]


@registered("""WITH c(x, y, e) AS (VALUES """ + ", ".join(map(str, _CELLS)) + """), b AS (SELECT *, x * 2.0 ** e AS x0, y * 2.0 ** e AS y0, (x + 1) * 2.0 ** e AS x1, (y + 1) * 2.0 ** e AS y1 FROM c)
SELECT a.x AS ax, a.y AS ay, a.e AS ae, b.x AS bx, b.y AS by, b.e AS be, CASE WHEN a.x = b.x AND a.y = b.y AND a.e = b.e THEN 'IDENTICAL' WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 THEN 'FIRST_CONTAINS'
WHEN b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 THEN 'SECOND_CONTAINS' ELSE 'DISJOINT' END AS relation FROM b a, b""")
def cell_relation(spark, sf):
    rows = [(*a, *b, Cell(*a).relation(Cell(*b)).name) for a in _CELLS for b in _CELLS]
    return spark.createDataFrame(rows, "ax int, ay int, ae int, bx int, by int, be int, relation string")


_AT = [(3.5, 2.25), (10.0, 0.0), (-4.0, 1.0), (63.99, 1.5), (500.0, 500.0)]
_AT_SQL = "p(k, px, py) AS (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(_AT)) + ")"


@registered(sql("SELECT k, r.x AS x, r.y AS y, r.heights AS value FROM p LEFT JOIN r_part r ON r.x = floor(px)::BIGINT AND r.y = floor(py)::BIGINT", _AT_SQL))
def sample_typed(spark, sf):
    """The cell and the typed value at single positions, null where there is no sample."""
    tree, rows = _heights(r_part(spark, sf)), []
    for k, (px, py) in enumerate(_AT):
        c = sample.cell_at(tree, px, py)
        rows.append((k, c and c.x, c and c.y, sample.value_at(tree, px, py, "heights")))
    return spark.createDataFrame(rows, "k int, x long, y long, value double")


@registered(sql("SELECT px, py, e, x, y, heights FROM (SELECT 10.25::DOUBLE AS px, 1.5::DOUBLE AS py) JOIN r_part ON x = 10 AND y = 1"))
def sample_position(spark, sf):
    """The first sample at one position."""
    return sample.position(_heights(r_part(spark, sf)), 10.25, 1.5).select("px", "py", *OUT)


@registered(sql("SELECT pid, px, pid % 3 + 0.5::DOUBLE AS py, e, x, y, heights FROM points JOIN r_part ON x = floor(px)::BIGINT AND y = pid % 3"))
def sample_whole_or_nothing(spark, sf):
    """All positions are in the raster's box; with one outside there is no row at all."""
    tree, inside = _heights(r_part(spark, sf)), points(spark, sf).withColumn("py", (F.col("pid") % 3 + 0.5))
    outside = inside.unionByName(inside.limit(1).withColumn("py", F.lit(-7.5)))
    found = sample.positions(tree, inside, whole_or_nothing=True)
    return found.unionByName(sample.positions(tree, outside, whole_or_nothing=True))


@registered(sql("SELECT pid, px, py, e, x, y, heights FROM points JOIN r_part ON x = floor(px)::BIGINT AND y = floor(py)::BIGINT"))
def sample_min_exponent(spark, sf):
    """Bases finer than the least exponent have no part in sampling."""
    return sample.positions(_pair(spark, sf, Dominance.SECOND), points(spark, sf), min_exponent=0)


@registered(sql("SELECT e, x, y, heights FROM r_part"))
def query_min_exponent(spark, sf):
    """Tiles of exponent 4 aren't finer than 4."""
    return query(_heights(r_part(spark, sf)), predicates.everything(), min_exponent=4).select(*OUT)


@registered(sql("SELECT 0 AS qe, x AS qx, y AS qy, heights AS value FROM r_part"))
def border_fail(spark, sf):
    """Every asked cell has a sample, so that none fails."""
    part = r_part(spark, sf)
    return sample.at_cells(part, part.df.select(F.lit(0).alias("qe"), F.col("x").alias("qx"), F.col("y").alias("qy")), "heights", sample.Border.FAIL)


@registered(sql("SELECT m AS mode, e, x, y, heights FROM r_part, (VALUES ('BOTTOM_RIGHT', 1, 0), ('TOP_LEFT', 0, 1), ('TOP_RIGHT', 1, 1), ('CENTER', 0.5, 0.5)) t(m, dx, dy) WHERE x + dx >= 4 AND x + dx <= 9 AND y + dy >= 2 AND y + dy <= 5"))
def sample_modes(spark, sf):
    ring, out = [(4.0, 2.0), (9.0, 2.0), (9.0, 5.0), (4.0, 5.0)], None
    for mode in (SampleMode.BOTTOM_RIGHT, SampleMode.TOP_LEFT, SampleMode.TOP_RIGHT, SampleMode.CENTER):
        own = query(r_part(spark, sf), predicates.inside_polygon(ring, mode)).select(F.lit(mode.name).alias("mode"), *OUT)
        out = own if out is None else out.union(own)
    return out


# trees


@registered(sql("SELECT e, x, y, heights, true AS has, false AS lacks FROM r_part"))
def layer_access(spark, sf):
    tree = r_part(spark, sf)
    lacks = tree.contains_layer("none") or tree.try_layer("none") is not None
    return tree.layer("heights").withColumns({"has": F.lit(tree.contains_layer("heights")), "lacks": F.lit(lacks)})


@registered(ORACLES["overlay_second"])
def in_memory(spark, sf):
    """A merge whose bases the executors keep."""
    return _pair(spark, sf, Dominance.SECOND).in_memory().samples.select(*FRAGMENTS)


@registered(sql("SELECT e, x, y, heights FROM r_part"))
def link_tree(spark, sf):
    return Link(_heights(r_part(spark, sf))).samples.select(*OUT)


@registered("SELECT 0 AS e, i % 8 AS x, i // 8 AS y, i::DOUBLE AS heights1d, 0::BIGINT AS merges FROM range(64) t(i)")
def merge_elimination(spark, sf):
    """A side without gaps that covers the other wins before anything is planned."""
    low = from_arrays(spark, DataMapping(Cell(2, 2, 0), 4, 4), {"heights1d": [-1.0] * 16})
    top = from_arrays(spark, DataMapping(Cell(0, 0, 0), 8, 8), {"heights1d": [float(i) for i in range(64)]})
    tree = merge(Dominance.SECOND, low, top)
    return tree.samples.select("e", "x", "y", "heights1d", F.lit(inspect.count_merge_nodes(tree)).cast("long").alias("merges"))


@registered(sql("SELECT * FROM o", "w AS (SELECT e, x, y, heights FROM r_part WHERE x < 20)," + overlay_cte("o", "r_coarse", "w")))
def overlay_disjoint_layers(spark, sf):
    """An overlay of a windowed raster and a coarser one that dominates."""
    part = _heights(r_part(spark, sf))
    return merge(Dominance.SECOND, Raster(part.df.where("x < 20"), (0,), 4), r_coarse(spark, sf)).samples.select(*FRAGMENTS)


@registered(sql("""SELECT (SELECT count(*) FROM (SELECT DISTINCT x >> 4, y >> 4 FROM r_part)) + (SELECT count(*) FROM (SELECT DISTINCT x >> 4, y >> 4 FROM r_coarse)) AS leaves, 1::BIGINT AS merges,
(SELECT count(*) FROM (SELECT DISTINCT k, x >> (4 + k) AS tx, y >> (4 + k) AS ty FROM r_part, range(1, 12) r(k) WHERE 4 + k <= (SELECT 1 + floor(log2(max(greatest(x, y)) + 1)) FROM r_part))) AS inners"""))
def node_counts(spark, sf):
    """Leaf and merge nodes of a merge, and inner nodes of one base."""
    part = _heights(r_part(spark, sf))
    tree = merge(Dominance.SECOND, r_coarse(spark, sf), part)
    return spark.createDataFrame([(inspect.count_leaf_nodes(tree), inspect.count_merge_nodes(tree), inspect.count_inner_nodes(part))], "leaves long, merges long, inners long")


@registered(sql("SELECT te, tx, ty, sum(((tx >> b) & 1) * 4 ** b + ((ty >> b) & 1) * 2 * 4 ** b)::BIGINT AS morton FROM (SELECT DISTINCT 4 AS te, x >> 4 AS tx, y >> 4 AS ty FROM r_part), range(20) t(b) GROUP BY te, tx, ty"))
def node_order(spark, sf):
    """The place of each leaf in Morton order."""
    low = inspect.tiles_by_level(_heights(r_part(spark, sf))).where("leaf")
    return low.select("te", "tx", "ty", F.conv(F.substring(inspect.morton("tx", "ty"), 65, 64), 2, 10).cast("long").alias("morton"))


@registered(sql("SELECT 4 AS te, x >> 4 AS tx, y >> 4 AS ty, count(*) AS n, max(heights) AS top FROM r_part GROUP BY x >> 4, y >> 4 HAVING count(*) > 3"))
def leaf_generator(spark, sf):
    """A function of each leaf that gives rows, or nothing for small leaves."""
    def make(tile, rows):
        import pandas as pd

        return pd.DataFrame([(*tile, len(rows), rows["heights"].max())], columns=["te", "tx", "ty", "n", "top"]) if len(rows) > 3 else None

    return per_tile(_heights(r_part(spark, sf)), make, "te int, tx long, ty long, n long, top double")


@registered("SELECT 0 AS k, 'merge SECOND' AS line UNION ALL SELECT 1, '  raster e=2 split=4 layers=heights box=None' UNION ALL SELECT 2, '  raster e=0 split=4 layers=heights box=None'")
def print_structure(spark, sf):
    text = inspect.structure(merge(Dominance.SECOND, r_coarse(spark, sf), _heights(r_part(spark, sf))))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "k int, line string")


@registered(sql("SELECT least(count(*), 500) AS shapes, least(count(*), 500) AS labels FROM r_coarse"))
def html_view(spark, sf):
    page = inspect.to_html(r_coarse(spark, sf).df, "heights", limit=500)
    return spark.createDataFrame([(page.count("<rect"), page.count("<text"))], "shapes long, labels long")


# layers


@registered(sql("""SELECT 1 AS e, qx AS x, qy AS y, ((f0 + f1 + f2 + f3) * 0.25)::FLOAT AS heights1f, (l0 + l1 + l2 + l3) // 4 AS intensities1l, struct_pack(r := (f0 % 256 + f1 % 256 + f2 % 256 + f3 % 256)::INTEGER // 4, g := 7, b := (l0 % 200 + l1 % 200 + l2 % 200 + l3 % 200)::INTEGER // 4)::VARCHAR AS colors FROM (
SELECT x >> 1 AS qx, y >> 1 AS qy, count(*) AS n, """ + ", ".join(f"max(floor(heights)) FILTER (x % 2 = {q % 2} AND y % 2 = {q // 2}) AS f{q}, max(intensity::BIGINT * 1000) FILTER (x % 2 = {q % 2} AND y % 2 = {q // 2}) AS l{q}" for q in range(4)) + " FROM r_part GROUP BY ALL) WHERE n = 4"))
def lod_kernels(spark, sf):
    """Means of float, long and colour layers."""
    h, i = F.floor("heights"), (F.col("intensity") * 1000).cast("long")
    color = F.struct((h % 256).cast("short").alias("r"), F.lit(7).cast("short").alias("g"), (i % 200).cast("short").alias("b"))
    up = layers.coarser(r_part(spark, sf).df.select("e", "x", "y", h.cast("float").alias("heights1f"), i.alias("intensities1l"), color.alias("colors3b")))
    c = F.col("colors3b")
    text = F.concat(F.lit("{'r': "), c["r"].cast("string"), F.lit(", 'g': "), c["g"].cast("string"), F.lit(", 'b': "), c["b"].cast("string"), F.lit("}"))
    return up.select("e", "x", "y", "heights1f", "intensities1l", text.alias("colors"))


@registered(sql("""SELECT 1 AS e, x, y, a / n AS nx, b / n AS ny, c / n AS nz FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (
SELECT x >> 1 AS x, y >> 1 AS y, """ + ", ".join("(" + " + ".join(f"max({v}) FILTER (x % 2 = {q % 2} AND y % 2 = {q // 2})" for q in range(4)) + f") * 0.25 AS {k}" for k, v in (("a", "heights"), ("b", "intensity::DOUBLE"), ("c", "100::DOUBLE"))) + " FROM r_part GROUP BY x >> 1, y >> 1 HAVING count(*) = 4))"))
def lod_normals(spark, sf):
    """Means of normal vectors have length one."""
    v = F.struct(F.col("heights").alias("x"), F.col("intensity").cast("double").alias("y"), F.lit(100.0).alias("z"))
    up = layers.coarser(r_part(spark, sf).df.select("e", "x", "y", v.alias("normals3d")))
    return up.select("e", "x", "y", *[F.col("normals3d")[c].alias(f"n{c}") for c in "xyz"])


def _two_layers(spark, sf):
    """Two patches of one exponent with two layers each."""
    part, orders = r_part(spark, sf).df, r_orders(spark, sf).df
    a = part.select(F.lit(0).cast("long").alias("patch_seq"), "e", "x", "y", "heights", F.when(F.col("x") % 3 == 0, -2147483648).otherwise(F.col("intensity")).cast("int").alias("intensities1i"))
    b = orders.where("x % 2 = 0 and y % 2 = 0").select(F.lit(1).cast("long").alias("patch_seq"), F.lit(0).alias("e"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), "heights", F.lit(5).alias("intensities1i"))
    return a.unionByName(b)


_TWO = "two AS (SELECT 0 AS seq, e, x, y, heights, CASE WHEN x % 3 = 0 THEN -2147483648 ELSE intensity END::INTEGER AS v FROM r_part UNION ALL SELECT 1, 0, x >> 1, y >> 1, heights, 5 FROM r_orders WHERE x % 2 = 0 AND y % 2 = 0)"


@registered(sql("SELECT e, x, y, min_by(heights, seq) AS heights, coalesce(min_by(v, seq) FILTER (v <> -2147483648), -2147483648)::INTEGER AS intensities1i FROM two GROUP BY e, x, y", _TWO))
def layer_set_merge(spark, sf):
    """The first writer of each layer wins, layer by layer."""
    return layers.merge_layers(_two_layers(spark, sf))


@registered(sql("SELECT e, x, y, max_by(heights, seq) AS heights, coalesce(max_by(v, seq) FILTER (v <> -2147483648), -2147483648)::INTEGER AS intensities1i FROM two GROUP BY e, x, y", _TWO))
def layer_set_flatten(spark, sf):
    """The last writer of each layer wins, layer by layer."""
    return layers.flatten_layers(_two_layers(spark, sf), (0,))


@registered(sql("""SELECT ce AS e, x, y, max_by(heights, -oe * 10 + seq) AS heights FROM (
  SELECT seq, oe, ce, CASE WHEN pe > ce THEN 2 * x + i ELSE x END AS x, CASE WHEN pe > ce THEN 2 * y + j ELSE y END AS y, heights FROM (
    SELECT *, min(pe) OVER (PARTITION BY x >> (0 - pe), y >> (0 - pe)) AS ce FROM (
      SELECT 0 AS seq, 0 AS pe, 0 AS oe, x, y, heights FROM r_part UNION ALL SELECT 1, -1, -1, x, y, heights FROM r_orders_s UNION ALL SELECT 2, 0, 2, 4 * x + i, 4 * y + j, heights FROM r_coarse, range(4) a(i), range(4) b(j))),
  range(2) a(i), range(2) b(j) WHERE i < 2 ** (pe - ce) AND j < 2 ** (pe - ce)) GROUP BY ALL"""))
def builder_coarse_patches(spark, sf):
    """Patches coarser than a tile count in every tile they cover."""
    return builder.flat_per_tile(_mixed(spark, sf), (0, -1, 2), 1).df.select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE x * 2 >= 9 AND y < 3 UNION ALL SELECT e, x, y, heights FROM r_part WHERE x * 2 < 9 AND y < 3"))
def streamed_and_saved_patches(spark, sf):
    """A stream and a batch append to one table, whose columns are those of the patches."""
    from .streaming.patches import append_patches

    base = _folder(spark, "stream")
    rows = _heights(r_part(spark, sf)).df.where("y < 3").withColumn("patch_seq", F.lit(0).cast("long"))
    rows.where("x * 2 >= 9").write.parquet(f"{base}/in")
    store = Store(spark, f"{base}/store")
    append_patches(spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in"), store, "p", f"{base}/state").awaitTermination()
    store.save_patches(rows.where("x * 2 < 9"), "p")
    return store.load_patches("p").drop("patch_seq")


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE x BETWEEN 3 AND 12 AND y BETWEEN 0 AND 5"))
def window_then_box(spark, sf):
    """A window of a raster, then a box: both are index ranges."""
    r = _heights(r_part(spark, sf)).with_window(IntBox(3, -4, 40, 90))
    return query(r, predicates.inside_box(Box(0, 0, 13, 6))).select(*OUT)


def _patchwork(spark, sf):
    """Four patches of three resolutions that overlap in parts."""
    part, orders, coarse = _heights(r_part(spark, sf)).df, r_orders(spark, sf, 3).df, r_coarse(spark, sf).df
    out = None
    for k, df in enumerate((coarse, part.where("x < 40"), orders.where("x >= 40 and y < 30"), part.where("x >= 30 and y < 9"))):
        own = df.withColumn("patch_seq", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


@registered(sql("""SELECT -1 AS e, x, y, max_by(heights, -pe * 10 + seq) AS heights FROM (
  SELECT 1 AS seq, 0 AS pe, 2 * x + i AS x, 2 * y + j AS y, heights FROM r_part, range(2) a(i), range(2) b(j) WHERE x < 40
  UNION ALL SELECT 3, 0, 2 * x + i, 2 * y + j, heights FROM r_part, range(2) a(i), range(2) b(j) WHERE x >= 30 AND y < 9
  UNION ALL SELECT 2, -1, x, y, heights FROM r_orders_s WHERE x >= 40 AND y < 30
  UNION ALL SELECT 0, 2, 8 * x + i, 8 * y + j, heights FROM r_coarse, range(8) a(i), range(8) b(j)) GROUP BY x, y"""))
def builder_adaptive(spark, sf):
    """Quadrants with resolutions of their own show the same values as everything in the finest grid."""
    tree = builder.Builder(2).add_table(_patchwork(spark, sf)).build_adaptive()
    return layers.supersample(tree.samples.select(*OUT), -1, tree.exponents)
