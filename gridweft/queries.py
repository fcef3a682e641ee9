"""Registered queries over rasters made from the driver's tables, with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .functions.cells import Box, Cell, IntBox
from .operators import inspect, layers, predicates, sample
from .operators.overlay import Dominance
from .operators.predicates import SampleMode
from .plans import builder
from .plans.tree import Raster, Tree, build, full, merge, query
from .sources.arrays import rasterise
from .sources.store import Store
from .sources.tables import shared_folder


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r_part(spark: SparkSession, sf: str) -> Raster:
    t = _table(spark, sf, "part")
    k = F.col("p_partkey")
    return build(t.select((k % 64).cast("long").alias("x"), F.floor(k / 64).cast("long").alias("y"), F.col("p_retailprice").cast("double").alias("heights"), F.col("p_size").cast("int").alias("intensity")), 0, 4)


def r_part_c(spark: SparkSession, sf: str) -> Raster:
    df = r_part(spark, sf).df
    return build(df.select((F.col("x") - 32).alias("x"), (F.col("y") - 8).alias("y"), "heights", "intensity"), 0, 4)


def r_orders(spark: SparkSession, sf: str, every: int = 1) -> Raster:
    t = _table(spark, sf, "orders")
    k = F.col("o_orderkey") * every
    return build(t.select((k % 128).cast("long").alias("x"), F.floor(k / 128).cast("long").alias("y"), F.col("o_totalprice").cast("double").alias("heights")), -1, 4)


def r_orders_s(spark: SparkSession, sf: str) -> Raster:
    """The samples of r_orders in every third cell: a raster of the whole table with gaps, through which overlays and flattening show what lies below."""
    return r_orders(spark, sf, 3)


def r_coarse(spark: SparkSession, sf: str) -> Raster:
    df = r_part(spark, sf).df
    up = df.groupBy(F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y")).agg(F.max("heights").alias("heights"))
    return build(up, 2, 4)


def _lineitem_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of r_lineitem, one for each row of the table."""
    t = _table(spark, sf, "lineitem")
    return t.select(F.lit(0).alias("e"), F.col("l_suppkey").cast("long").alias("x"), F.floor(F.col("l_partkey") / 16).cast("long").alias("y"), "l_linenumber")


def r_lineitem(spark: SparkSession, sf: str) -> Raster:
    df = _lineitem_cells(spark, sf).groupBy("x", "y").agg(F.max("l_linenumber").cast("int").alias("intensity"))
    return build(df, 0, 4)


def r_vec(spark: SparkSession, sf: str) -> Raster:
    t = _table(spark, sf, "embeddings")
    v = F.struct(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abcd")]).alias("heights_bilinear4d")
    return build(t.select((F.col("vec_id") % 32).alias("x"), F.floor(F.col("vec_id") / 32).cast("long").alias("y"), v), 0, 4)


def points(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "events")
    return t.select(F.col("event_id").alias("pid"), ((F.col("user_id") % 64) + 0.25).alias("px"), ((F.col("event_id") % 40) + 0.5).alias("py"))


def _heights(tree: Raster) -> Raster:
    return tree.with_layers("heights")


VIEWS = """
r_part AS (SELECT 0 AS e, (p_partkey % 64)::BIGINT AS x, (p_partkey // 64)::BIGINT AS y, p_retailprice::DOUBLE AS heights, p_size::INTEGER AS intensity FROM part),
r_part_c AS (SELECT e, x - 32 AS x, y - 8 AS y, heights, intensity FROM r_part),
r_orders AS (SELECT -1 AS e, (o_orderkey % 128)::BIGINT AS x, (o_orderkey // 128)::BIGINT AS y, o_totalprice::DOUBLE AS heights FROM orders),
r_orders_s AS (SELECT -1 AS e, (o_orderkey * 3 % 128)::BIGINT AS x, (o_orderkey * 3 // 128)::BIGINT AS y, o_totalprice::DOUBLE AS heights FROM orders),
r_coarse AS (SELECT 2 AS e, x >> 2 AS x, y >> 2 AS y, max(heights) AS heights FROM r_part GROUP BY ALL),
r_lineitem AS (SELECT 0 AS e, l_suppkey::BIGINT AS x, (l_partkey // 16)::BIGINT AS y, max(l_linenumber)::INTEGER AS intensity FROM lineitem GROUP BY ALL),
r_vec AS (SELECT 0 AS e, vec_id % 32 AS x, vec_id // 32 AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
points AS (SELECT event_id AS pid, (user_id % 64) + 0.25::DOUBLE AS px, (event_id % 40) + 0.5::DOUBLE AS py FROM events)
"""


def sql(body: str, recursive: str = "") -> str:
    return f"WITH RECURSIVE {VIEWS.strip()}{',' + recursive if recursive else ''}\n{body}"


def overlay_cte(name: str, x: str, y: str, nested: bool = False) -> str:
    """SQL for all of x, and y where x has no cell, by recursive splitting: e, x, y, src_e, src_x, src_y, heights. nested: y is such an overlay."""
    source = "src_e AS se, src_x AS sx, src_y AS sy" if nested else "e AS se, x AS sx, y AS sy"
    return f"""
{name}_up AS (SELECT DISTINCT l AS e, {x}.x >> (l - {x}.e) AS x, {x}.y >> (l - {x}.e) AS y FROM {x}, range(-6, 8) r(l) WHERE l > {x}.e),
{name}_f AS (SELECT e, x, y, {source}, heights FROM {y}
  UNION ALL SELECT (f.e - 1)::INTEGER, 2 * f.x + dx, 2 * f.y + dy, se, sx, sy, heights FROM {name}_f f JOIN {name}_up u ON u.e = f.e AND u.x = f.x AND u.y = f.y, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(dx, dy)),
{name}_cov AS (SELECT DISTINCT f.e, f.x, f.y FROM {name}_f f, (SELECT DISTINCT e AS l FROM {x}) v, {x} c WHERE v.l >= f.e AND c.e = v.l AND c.x = f.x >> greatest(v.l - f.e, 0) AND c.y = f.y >> greatest(v.l - f.e, 0)),
{name} AS (SELECT e, x, y, e AS src_e, x AS src_x, y AS src_y, heights FROM {x}
  UNION ALL SELECT f.e, f.x, f.y, se, sx, sy, heights FROM {name}_f f ANTI JOIN {name}_up u ON u.e = f.e AND u.x = f.x AND u.y = f.y ANTI JOIN {name}_cov c ON c.e = f.e AND c.x = f.x AND c.y = f.y)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


OUT = ["e", "x", "y", "heights"]
FRAGMENTS = ["e", "x", "y", "src_e", "src_x", "src_y", "heights"]


@registered(sql("SELECT e, x, y, heights, intensity FROM r_part"))
def all(spark, sf):  # noqa: A001
    return query(r_part(spark, sf), predicates.everything()).select("e", "x", "y", "heights", "intensity")


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE x >> 3 = 1 AND y >> 3 = 0"))
def inside_cell(spark, sf):
    return query(r_part(spark, sf), predicates.inside_cell(Cell(1, 0, 3))).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part_c WHERE x BETWEEN -8 AND 7 AND y BETWEEN -8 AND 7"))
def inside_centered_cell(spark, sf):
    return query(r_part_c(spark, sf), predicates.inside_cell(Cell(0, 0, 4, True))).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_orders WHERE x * 0.5 >= 3.25 AND (x + 1) * 0.5 <= 20.5 AND y * 0.5 >= -1 AND (y + 1) * 0.5 <= 9.75"))
def inside_box(spark, sf):
    return query(r_orders(spark, sf), predicates.inside_box(Box(3.25, -1, 20.5, 9.75))).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_orders WHERE x >> 4 = 2 AND y >> 4 = 1"))
def intersects_cell_fine(spark, sf):
    return query(r_orders(spark, sf), predicates.intersects_cell(Cell(2, 1, 3))).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_coarse WHERE x = 13 >> 3 AND y = 9 >> 3"))
def intersects_cell_coarse(spark, sf):
    return query(r_coarse(spark, sf), predicates.intersects_cell(Cell(13, 9, -1))).select(*OUT)


# a convex polygon as half planes, an independent formulation
@registered(sql("SELECT e, x, y, heights FROM (SELECT *, x + 0.5 AS px, y + 0.5 AS py FROM r_part) WHERE py >= 1 AND py <= px AND 2 * px + 3 * py <= 90 AND px <= 31.5"))
def inside_polygon(spark, sf):
    ring = [(1.0, 1.0), (31.5, 1.0), (31.5, 9.0), (18.0, 18.0)]
    return query(r_part(spark, sf), predicates.inside_polygon(ring)).select(*OUT)


# a concave one: a square without its upper triangle
@registered(sql("SELECT e, x, y, heights FROM (SELECT *, x + 0.5 AS px, y + 0.5 AS py FROM r_part) WHERE px BETWEEN 2 AND 22 AND py >= 0.5 AND py <= 20 AND NOT (py > 20 - (px - 2) AND py > 20 - (22 - px))"))
def inside_polygon_concave(spark, sf):
    ring = [(2.0, 20.0), (12.0, 10.0), (22.0, 20.0), (22.0, 0.5), (2.0, 0.5)]
    return query(r_part(spark, sf), predicates.inside_polygon(ring)).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part_c WHERE abs(3 * (y + 0.5) - 4 * (x + 0.5 - 2)) <= 12.25"))
def near_line(spark, sf):
    return query(r_part_c(spark, sf), predicates.near_line((2.0, 0.0), (3.0, 4.0), 2.45)).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE x >= 4 AND x <= 9 AND y >= 2 AND y <= 5"))
def sample_mode_bl(spark, sf):
    ring = [(4.0, 2.0), (9.0, 2.0), (9.0, 5.0), (4.0, 5.0)]
    return query(r_part(spark, sf), predicates.inside_polygon(ring, SampleMode.BOTTOM_LEFT)).select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE (x + y) % 5 = 0 AND heights > 950"))
def generic(spark, sf):
    df = query(r_part(spark, sf), predicates.generic(lambda: (F.col("x") + F.col("y")) % 5 == 0))
    return df.where("heights > 950").select(*OUT)


def _pair(spark, sf, d: Dominance) -> Tree:
    return merge(d, _heights(r_part(spark, sf)), r_orders_s(spark, sf))


@registered(sql("SELECT * FROM o", overlay_cte("o", "r_part", "r_orders_s")))
def overlay_first(spark, sf):
    return _pair(spark, sf, Dominance.FIRST).samples.select(*FRAGMENTS)


@registered(sql("SELECT * FROM o", overlay_cte("o", "r_orders_s", "r_part")))
def overlay_second(spark, sf):
    return _pair(spark, sf, Dominance.SECOND).samples.select(*FRAGMENTS)


@registered(sql("SELECT * FROM o", overlay_cte("o", "r_part", "r_coarse")))
def overlay_more_detailed_first(spark, sf):
    return merge(Dominance.MORE_DETAILED_OR_FIRST, r_coarse(spark, sf), _heights(r_part(spark, sf))).samples.select(*FRAGMENTS)


@registered(sql("SELECT * FROM o", "p1 AS (SELECT e, x, y, heights + 1 AS heights FROM r_part WHERE x % 2 = 0 UNION ALL SELECT e, x, y, heights FROM r_part WHERE x % 2 = 1)," + overlay_cte("o", "r_orders_s", "p1")))
def overlay_more_detailed_second(spark, sf):
    part = _heights(r_part(spark, sf))
    even = Raster(part.df.where("x % 2 = 0").withColumn("heights", F.col("heights") + 1), (0,), 4)
    tied = merge(Dominance.MORE_DETAILED_OR_SECOND, part, even)
    return merge(Dominance.MORE_DETAILED_OR_SECOND, r_orders_s(spark, sf), tied).samples.select(*FRAGMENTS)


@registered(sql("SELECT * FROM b", overlay_cte("a", "r_part", "r_coarse") + "," + overlay_cte("b", "r_orders_s", "a", nested=True)))
def overlay_chain(spark, sf):
    inner = merge(Dominance.SECOND, r_coarse(spark, sf), _heights(r_part(spark, sf)))
    return merge(Dominance.SECOND, inner, r_orders_s(spark, sf)).samples.select(*FRAGMENTS)


@registered(sql("SELECT * FROM o WHERE x * 2.0 ** e >= 2.5 AND (x + 1) * 2.0 ** e <= 21 AND y * 2.0 ** e >= 1 AND (y + 1) * 2.0 ** e <= 12.5", overlay_cte("o", "r_orders_s", "r_coarse")))
def overlay_then_box(spark, sf):
    tree = merge(Dominance.SECOND, r_coarse(spark, sf), r_orders_s(spark, sf))
    return query(tree, predicates.inside_box(Box(2.5, 1, 21, 12.5))).select(*FRAGMENTS)


@registered(sql("SELECT e, x, y, heights FROM r_part UNION ALL SELECT e, x, y, heights FROM r_orders_s"))
def full_union(spark, sf):
    return full(_pair(spark, sf, Dominance.SECOND)).select(*OUT)


@registered(sql("SELECT pid, px, py, e, x, y, heights FROM points JOIN r_part ON x = floor(px)::BIGINT AND y = floor(py)::BIGINT"))
def sample_positions(spark, sf):
    return sample.positions(_heights(r_part(spark, sf)), points(spark, sf))


@registered(sql("""SELECT pid, px, py, coalesce(s.e, r.e) AS e, coalesce(s.x, r.x) AS x, coalesce(s.y, r.y) AS y, coalesce(s.heights, r.heights) AS heights FROM points
LEFT JOIN r_orders_s s ON s.x = floor(px * 2)::BIGINT AND s.y = floor(py * 2)::BIGINT
LEFT JOIN r_part r ON r.x = floor(px)::BIGINT AND r.y = floor(py)::BIGINT WHERE s.e IS NOT NULL OR r.e IS NOT NULL"""))
def sample_positions_overlay(spark, sf):
    return sample.positions(_pair(spark, sf, Dominance.MORE_DETAILED_OR_FIRST), points(spark, sf))


@registered(sql("""SELECT p.e, p.x, p.y, o.e AS oe, o.x AS ox, o.y AS oy, p.heights AS old, o.heights AS new, o.heights - p.heights AS difference
FROM r_part p JOIN r_orders_s o ON o.x >> 1 = p.x AND o.y >> 1 = p.y WHERE p.x + 0.5 >= 2 AND p.x + 0.5 <= 20 AND p.y + 0.5 >= 2 AND p.y + 0.5 <= 14"""))
def epoch_difference(spark, sf):
    area = predicates.inside_polygon([(2.0, 2.0), (20.0, 2.0), (20.0, 14.0), (2.0, 14.0)])
    return sample.epoch_difference(_heights(r_part(spark, sf)), r_orders_s(spark, sf), "heights", area)


@registered(sql("SELECT -1 AS e, 2 * x + i AS x, 2 * y + j AS y, heights FROM r_part, range(2) a(i), range(2) b(j)"))
def resample_super(spark, sf):
    return layers.supersample(_heights(r_part(spark, sf)).df, -1, (0,))


def _patches(spark, sf) -> DataFrame:
    """Two overlapping patches of one exponent with an integer layer whose least value is undefined."""
    a = r_part(spark, sf).df.select(F.lit(0).cast("long").alias("patch_seq"), "e", "x", "y", F.when(F.col("x") % 3 == 0, -2147483648).otherwise(F.col("intensity")).cast("int").alias("intensities1i"))
    b = r_lineitem(spark, sf).df.select(F.lit(1).cast("long").alias("patch_seq"), "e", "x", "y", F.col("intensity").alias("intensities1i"))
    return a.unionByName(b)


_PATCHES = """
patches AS (SELECT 0 AS seq, e, x, y, CASE WHEN x % 3 = 0 THEN -2147483648 ELSE intensity END::INTEGER AS v FROM r_part
  UNION ALL SELECT 1, e, x, y, intensity FROM r_lineitem)"""


@registered(sql("SELECT e, x, y, coalesce(min_by(v, seq) FILTER (v <> -2147483648), -2147483648)::INTEGER AS intensities1i FROM patches GROUP BY e, x, y", _PATCHES))
def layer_merge(spark, sf):
    return layers.merge_layers(_patches(spark, sf))


@registered(sql("""SELECT -1 AS e, x, y, max_by(heights, -pe * 10 + seq) AS heights FROM (
  SELECT 0 AS seq, 0 AS pe, 2 * x + i AS x, 2 * y + j AS y, heights FROM r_part, range(2) a(i), range(2) b(j)
  UNION ALL SELECT 1, -1, x, y, heights FROM r_orders_s
  UNION ALL SELECT 2, 2, 8 * x + i, 8 * y + j, heights FROM r_coarse, range(8) a(i), range(8) b(j)) GROUP BY x, y"""))
def layer_flatten(spark, sf):
    rows = _mixed(spark, sf)
    return layers.flatten_layers(rows, (0, -1, 2))


def _mixed(spark, sf) -> DataFrame:
    out = None
    for k, r in enumerate((_heights(r_part(spark, sf)), r_orders_s(spark, sf), r_coarse(spark, sf))):
        own = r.df.withColumn("patch_seq", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


@registered(sql("SELECT * FROM b", overlay_cte("a", "r_part", "r_coarse") + "," + overlay_cte("b", "r_orders_s", "a", nested=True)))
def builder_fold(spark, sf):
    return builder.fold(_mixed(spark, sf), (2, 0, -1), 4).samples.select(*FRAGMENTS)


@registered(ORACLES["layer_flatten"])
def builder_flatten(spark, sf):
    return builder.Builder(4).add_range([_heights(r_part(spark, sf)), r_orders_s(spark, sf), r_coarse(spark, sf)]).build_flat().samples.select(*OUT)


@registered(sql("""SELECT ce AS e, x, y, max_by(heights, -pe * 10 + seq) AS heights FROM (
  SELECT seq, pe, ce, CASE WHEN pe > ce THEN (x * 2 ** (pe - ce))::BIGINT + i ELSE x END AS x, CASE WHEN pe > ce THEN (y * 2 ** (pe - ce))::BIGINT + j ELSE y END AS y, heights FROM (
    SELECT *, min(pe) OVER (PARTITION BY x >> (3 - pe), y >> (3 - pe)) AS ce FROM (
      SELECT 0 AS seq, 0 AS pe, x, y, heights FROM r_part UNION ALL SELECT 1, -1, x, y, heights FROM r_orders_s UNION ALL SELECT 2, 2, x, y, heights FROM r_coarse)),
  range(8) a(i), range(8) b(j) WHERE i < 2 ** (pe - ce) AND j < 2 ** (pe - ce)) GROUP BY ALL"""))
def builder_flatten_per_tile(spark, sf):
    return builder.flat_per_tile(_mixed(spark, sf), (0, -1, 2), 4).df.select(*OUT)


@registered(sql("SELECT e, x, y, heights FROM r_part WHERE x >= 5 AND x < 20 AND y >= 1 AND y < 9"))
def window_slice(spark, sf):
    return r_part(spark, sf).with_window(IntBox(5, 1, 20, 9)).df.select(*OUT)


@registered(sql("SELECT e, x, y FROM r_part ANTI JOIN (SELECT x, y FROM r_part WHERE x BETWEEN 5 AND 19) w USING (x, y)"))
def window_difference(spark, sf):
    r = r_part(spark, sf)
    return layers.window_difference(r.df, r.with_window(IntBox(5, -1000, 20, 100000)).df).select("e", "x", "y")


@registered(sql("SELECT e, x, y, heights AS volumes1d FROM r_part"))
def rename_semantic(spark, sf):
    return _heights(r_part(spark, sf)).renamed("heights", "volumes1d").df


@registered(sql("""SELECT e + 4 AS te, x >> 4 AS tx, y >> 4 AS ty, e, 4 AS split, min(x) AS wx0, min(y) AS wy0, max(x) + 1 AS wx1, max(y) + 1 AS wy1,
min(x)::DOUBLE AS bb_x0, min(y)::DOUBLE AS bb_y0, (max(x) + 1)::DOUBLE AS bb_x1, (max(y) + 1)::DOUBLE AS bb_y1, count(*) AS n,
count(*) < (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) AS has_mask FROM r_lineitem GROUP BY e, x >> 4, y >> 4"""))
def tile_counts(spark, sf):
    """Tiles of r_lineitem. They depend on its cells alone, so the cells aren't made unique with their values first."""
    return inspect.tiles_of(_lineitem_cells(spark, sf), 4)


@registered(sql("SELECT e, count(*) AS n FROM (SELECT e FROM r_part UNION ALL SELECT e FROM r_orders_s UNION ALL SELECT e FROM r_coarse) GROUP BY e"))
def level_counts(spark, sf):
    return inspect.level_counts(_mixed(spark, sf))


@registered(sql("SELECT e, count(*) * 4.0 ** e AS area FROM (SELECT e FROM r_part UNION ALL SELECT e FROM r_orders_s) GROUP BY e"))
def area_by_level(spark, sf):
    return inspect.covered_area(full(_pair(spark, sf, Dominance.SECOND)))


@registered(sql("SELECT min(x * 2.0 ** e) AS x0, min(y * 2.0 ** e) AS y0, max((x + 1) * 2.0 ** e) AS x1, max((y + 1) * 2.0 ** e) AS y1 FROM (SELECT e, x, y FROM r_part_c UNION ALL SELECT e, x, y FROM r_orders_s)"))
def bounding_box(spark, sf):
    return full(merge(Dominance.SECOND, _heights(r_part_c(spark, sf)), r_orders_s(spark, sf))).agg(*cells.bounding_box())


@registered(sql("""SELECT te, tx, ty, leaf FROM (SELECT DISTINCT 4 + k AS te, x >> (4 + k) AS tx, y >> (4 + k) AS ty, k = 0 AS leaf FROM r_part, range(0, 12) r(k)
 WHERE 4 + k <= (SELECT 1 + floor(log2(max(greatest(x, y)) + 1)) FROM r_part))"""))
def tree_nodes(spark, sf):
    return inspect.tiles_by_level(r_part(spark, sf))


@registered(sql("SELECT pid, px, py, a + b * (px - x - 0.5) + c * (py - y - 0.5) + d * (px - x - 0.5) * (py - y - 0.5) AS value FROM points JOIN r_vec ON x = floor(px)::BIGINT AND y = floor(py)::BIGINT"))
def bilinear_eval(spark, sf):
    return sample.evaluate(r_vec(spark, sf), "heights_bilinear4d", points(spark, sf))


@registered(sql("""SELECT 1 AS e, x >> 1 AS x, y >> 1 AS y,
(max(heights) FILTER (x % 2 = 0 AND y % 2 = 0) + max(heights) FILTER (x % 2 = 1 AND y % 2 = 0) + max(heights) FILTER (x % 2 = 0 AND y % 2 = 1) + max(heights) FILTER (x % 2 = 1 AND y % 2 = 1)) * 0.25 AS heights,
(sum(intensity) // 4)::INTEGER AS intensity FROM r_part GROUP BY x >> 1, y >> 1 HAVING count(*) = 4"""))
def lod_mean(spark, sf):
    return layers.coarser(r_part(spark, sf).df)


@registered(sql("SELECT 3 AS e, x >> 3 AS x, y >> 3 AS y, max_by(extendedprice, seq) AS value FROM (SELECT l_suppkey % 100 + 0.5 AS x0, l_orderkey AS seq0, (l_suppkey % 100)::BIGINT AS x, (l_partkey % 50)::BIGINT AS y, l_extendedprice::DOUBLE AS extendedprice, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY ALL"))
def rasterise_points(spark, sf):
    t = _table(spark, sf, "lineitem")
    pts = t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_suppkey") % 100 + 0.5).alias("px"), (F.col("l_partkey") % 50 + 0.5).alias("py"), F.col("l_extendedprice").cast("double").alias("value"))
    return rasterise(pts, 3, ["value"]).df


@registered(sql("SELECT e, x, y, x >> 1 AS parent_x, y >> 1 AS parent_y, ((x & 1) + 2 * (y & 1))::INTEGER AS quadrant, x * 2.0 ** e AS bx, 2.0 ** e AS size FROM r_orders_s"))
def cell_functions(spark, sf):
    _, px, py, q = cells.parent()
    return r_orders_s(spark, sf).df.select("e", "x", "y", px.alias("parent_x"), py.alias("parent_y"), q, (F.col("x") * cells.size()).alias("bx"), cells.size().alias("size"))


@registered(sql("SELECT e, x, y, heights FROM r_part"))
def roundtrip_store(spark, sf):
    import uuid

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    return store.load(store.save(_heights(r_part(spark, sf)))).samples.select(*OUT)


@registered(sql("SELECT patch_seq::BIGINT AS patch_seq, e, x, y, heights FROM (SELECT 0 AS patch_seq, e, x, y, heights FROM r_part UNION ALL SELECT 1, e, x, y, heights FROM r_orders_s UNION ALL SELECT 2, e, x, y, heights FROM r_coarse)"))
def roundtrip_patches(spark, sf):
    import uuid

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    return store.load_patches(store.save_patches(_mixed(spark, sf)))


@registered(sql("SELECT qe, qx, qy, CASE WHEN heights IS NULL THEN -1.0 ELSE heights END AS value FROM (SELECT -1 AS qe, event_id % 150 AS qx, user_id % 90 AS qy FROM events) LEFT JOIN r_part ON x = qx >> 1 AND y = qy >> 1"))
def border_value(spark, sf):
    keys = _table(spark, sf, "events").select(F.lit(-1).alias("qe"), (F.col("event_id") % 150).alias("qx"), (F.col("user_id") % 90).alias("qy"))
    return sample.at_cells(r_part(spark, sf), keys, "heights", sample.Border.CLAMP_TO_BORDER, -1.0)


@registered(sql("""SELECT qe, qx, qy, heights AS value FROM (SELECT 0 AS qe, event_id % 80 - 5 AS qx, user_id % 3 - 2 AS qy FROM events)
JOIN r_part ON x = least(greatest(qx, 0), 63) AND y = least(greatest(qy, 0), (SELECT max(y) FROM r_part))"""))
def border_edge(spark, sf):
    keys = _table(spark, sf, "events").select(F.lit(0).alias("qe"), (F.col("event_id") % 80 - 5).alias("qx"), (F.col("user_id") % 3 - 2).alias("qy"))
    return sample.at_cells(r_part(spark, sf), keys, "heights", sample.Border.CLAMP_TO_EDGE)


# both sides filtered first: a rejected cell of the winner hides nothing
@registered(sql("SELECT e, x, y, heights FROM r_coarse WHERE x * 4 >= 2 AND x * 4 + 4 <= 30 AND y * 4 >= 0 AND y * 4 + 4 <= 3 UNION ALL SELECT e, x, y, heights FROM r_part p WHERE x >= 2 AND x + 1 <= 30 AND y + 1 <= 3 AND NOT EXISTS (SELECT 1 FROM r_coarse c WHERE c.x = p.x >> 2 AND c.y = p.y >> 2 AND c.x * 4 >= 2 AND c.x * 4 + 4 <= 30 AND c.y * 4 + 4 <= 3)"))
def filter_then_overlay(spark, sf):
    tree = merge(Dominance.FIRST, r_coarse(spark, sf), _heights(r_part(spark, sf)))
    return query(tree, predicates.inside_box(Box(2, 0, 30, 3)), filter_first=True).select(*OUT)


@registered(sql("SELECT 0 AS e, x, y FROM (SELECT x0 + i AS x, y0 + j AS y, x0, y0, x1, y1, i, j FROM (SELECT DISTINCT (p_partkey % 7) * 10 AS x0, p_size * 5 AS y0, (p_partkey % 7) * 10 + 3 AS x1, p_size * 5 + 2 AS y1 FROM part), range(3) a(i), range(2) b(j))"))
def window_enumeration(spark, sf):
    t = _table(spark, sf, "part").select(((F.col("p_partkey") % 7) * 10).cast("long").alias("x0"), (F.col("p_size") * 5).cast("long").alias("y0")).distinct()
    return layers.window_cells(t.select(F.lit(0).alias("e"), "x0", "y0", (F.col("x0") + 3).alias("x1"), (F.col("y0") + 2).alias("y1")))


@registered(sql("""SELECT p.e, p.x, p.y, o.e AS oe, o.x AS ox, o.y AS oy, p.heights AS old, o.heights AS new, o.heights - p.heights AS difference FROM r_coarse p JOIN r_part o ON o.x >> 2 = p.x AND o.y >> 2 = p.y
UNION ALL SELECT p.e, p.x, p.y, o.e, o.x, o.y, p.heights, o.heights, o.heights - p.heights FROM r_orders_s p JOIN r_part o ON p.x >> 1 = o.x AND p.y >> 1 = o.y"""))
def epoch_difference_levels(spark, sf):
    part = _heights(r_part(spark, sf))
    a = sample.epoch_difference(r_coarse(spark, sf), part, "heights")
    return a.unionByName(sample.epoch_difference(r_orders_s(spark, sf), part, "heights"))


@registered(sql("SELECT 0::BIGINT AS patch_seq, e, x, y, heights FROM r_part"))
def streamed_patches(spark, sf):
    """Patches that arrive as a stream end in the store once, though the stream runs twice."""
    import uuid

    from .streaming.patches import append_patches

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _heights(r_part(spark, sf)).df.withColumn("patch_seq", F.lit(0).cast("long")).write.parquet(f"{base}/in")
    store = Store(spark, f"{base}/store")
    for _ in range(2):
        stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
        append_patches(stream, store, "p", f"{base}/state").awaitTermination()
    return store.load_patches("p")


from . import more_queries  # noqa: E402, F401  (registers the rest)
