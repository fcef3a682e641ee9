"""Sampling rasters at positions: a lookup join on the cell a position falls in."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.tree import EMPTY, Link, Merge, Raster, Tree
from .overlay import CELL, Dominance
from .predicates import SampleMode, relative


class Border(Enum):
    FAIL = "fail"
    CLAMP_TO_EDGE = "edge"
    CLAMP_TO_BORDER = "border"


def positions(tree: Tree, points: DataFrame, layers: list[str] | None = None, min_exponent: int | None = None, whole_or_nothing: bool = False) -> DataFrame:
    """(columns of points, e, x, y, layers) for each position (pid, px, py) that has a sample.

    Every base is joined once on (e, cell of the position at e); the merges then pick a winner
    per position, so nothing is overlaid. The cell is the base's own. pid is unique; it may be
    of any type. whole_or_nothing returns no row when any position is outside the bounding box.
    """
    bases = tree.bases()
    names = list(layers or tree.layers)
    if not bases:
        return points.join(EMPTY.samples.select(*CELL), F.lit(False), "inner")
    if whole_or_nothing:
        b = tree.bounding_box()
        outside = points.where(~(F.col("px").between(b.x0, b.x1) & F.col("py").between(b.y0, b.y1))).limit(1).count() if b else 1
        if outside:
            points = points.limit(0)
    found = None
    for k, r in enumerate(bases):
        es = [e for e in r.exponents if min_exponent is None or e >= min_exponent]
        if not es:
            continue
        have = [n for n in names if n in r.layers]
        values = F.struct(*CELL, *[F.col(n) if n in have else F.lit(None).cast(_type(bases, n)).alias(n) for n in names])
        at = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), cells.cell_index(F.col("px"), e).alias("x"), cells.cell_index(F.col("py"), e).alias("y")) for e in es]))
        keyed = points.select("pid", at.alias("k")).select("pid", "k.*")
        df, _ = r.resolved()
        own = keyed.join(df.select(*CELL, *have), CELL).select("pid", F.lit(k).alias("base"), values.alias("v"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return points.limit(0).join(bases[0].resolved()[0].select(*CELL, *[n for n in names if n in bases[0].layers]), F.lit(False), "inner")
    if len(bases) == 1:
        best = found.select("pid", F.col("v").alias("best"))
    else:
        sides = [F.max(F.when(F.col("base") == k, F.struct(F.col("v.e").alias("o"), F.struct(*[F.col(f"v.{c}") for c in [*CELL, *names]]).alias("v")))).getField("v").alias(f"v{k}") for k in range(len(bases))]
        grouped = found.groupBy("pid").agg(*sides)
        best = grouped.select("pid", _winner(tree, iter(range(len(bases)))).alias("best"))
    return points.join(best.where("best is not null"), "pid").select(*points.columns, *[F.col(f"best.{c}").alias(c) for c in [*CELL, *names]])


def _type(bases: list[Raster], name: str):
    return next(r.df.schema[name].dataType for r in bases if name in r.layers)


def _winner(tree: Tree, ks) -> Column:
    if isinstance(tree, Raster):
        return F.col(f"v{next(ks)}")
    if isinstance(tree, Link):
        return _winner(tree.target, ks)
    assert isinstance(tree, Merge)
    a, b = _winner(tree.first, ks), _winner(tree.second, ks)
    if tree.dominance is Dominance.FIRST:
        return F.coalesce(a, b)
    if tree.dominance is Dominance.SECOND:
        return F.coalesce(b, a)
    if tree.dominance is Dominance.MORE_DETAILED_OR_SECOND:
        a, b = b, a
    return F.when(b.isNull() | (a["e"] <= b["e"]), a).otherwise(b)


def position(tree: Tree, px: float, py: float, layers: list[str] | None = None) -> DataFrame:
    """The sample at one position: no row or one."""
    spark = tree.samples.sparkSession
    point = spark.createDataFrame([(0, float(px), float(py))], "pid long, px double, py double")
    return positions(tree, F.broadcast(point), layers).limit(1)  # a list has no size that the planner knows: not the samples


def value_at(tree: Tree, px: float, py: float, layer: str):
    """The layer's value at one position, None where there is no sample."""
    r = position(tree, px, py, [layer]).first()
    return None if r is None else r[layer]


def cell_at(tree: Tree, px: float, py: float) -> cells.Cell | None:
    """The sample cell at one position."""
    r = position(tree, px, py).first()
    return None if r is None else cells.Cell(r.x, r.y, r.e)


def at_cells(raster: Raster, keys: DataFrame, layer: str, border: Border = Border.FAIL, border_value=None) -> DataFrame:
    """(qe, qx, qy, value): a layer of a single-level raster at cells (qe, qx, qy) of its own or finer exponents.

    Cells off the raster raise when read, take the nearest edge sample, or the border value.
    """
    (e,) = raster.exponents
    up = F.lit(e) - F.col("qe")
    keys = keys.select("qe", "qx", "qy", F.when(up < 0, F.raise_error(F.lit("a query cell is coarser than the samples")).cast("long")).otherwise(cells.shift(F.col("qx"), F.greatest(up, F.lit(0)))).alias("kx"), cells.shift(F.col("qy"), F.greatest(up, F.lit(0))).alias("ky"))
    if border is Border.CLAMP_TO_EDGE:
        b = raster.bounding_box()
        s = 2.0**e
        clamp = lambda c, lo, hi: F.greatest(F.least(F.col(c), F.lit(int(hi / s) - 1)), F.lit(int(lo / s))).cast("long")
        keys = keys.withColumn("kx", clamp("kx", b.x0, b.x1)).withColumn("ky", clamp("ky", b.y0, b.y1))
    own = raster.df.select(F.col("x").alias("kx"), F.col("y").alias("ky"), F.col(layer).alias("value"), F.lit(True).alias("hit"))
    out = keys.join(own, ["kx", "ky"], "left")
    if border is Border.CLAMP_TO_BORDER:
        value = F.when(F.col("hit"), F.col("value")).otherwise(F.lit(border_value))
    else:
        value = F.when(F.col("hit"), F.col("value")).otherwise(F.raise_error(F.lit("no sample at a query cell")).cast(raster.df.schema[layer].dataType))
    return out.select("qe", "qx", "qy", value.alias("value"))


def epoch_difference(before: Tree, after: Tree, layer: str, predicate=None) -> DataFrame:
    """(e, x, y, oe, ox, oy, old, new, difference): cells of one epoch with the overlapping cells of another.

    Overlap is an equi-join on the ancestor at each pair of exponents, the coarser of the two.
    """
    from ..plans.tree import query
    from .predicates import everything

    predicate = predicate or everything()
    a = query(before, predicate).select(*CELL, F.col(layer).alias("old"))
    b, eb = after.resolved(None if predicate.box is None else predicate.box.aligned(max(before.exponents)))
    b = b.select(F.col("e").alias("oe"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col(layer).alias("new"))
    key = lambda e, x, y, level: F.struct(F.lit(level).alias("l"), cells.shift(F.col(x), F.lit(level) - F.col(e)).alias("x"), cells.shift(F.col(y), F.lit(level) - F.col(e)).alias("y"))
    ea = before.exponents
    left = a.select("*", F.explode(F.filter(F.array(*[F.when(F.col("e") <= m, F.struct(F.lit(o).alias("oe"), key("e", "x", "y", m).alias("k"))) for o in eb for m in sorted({max(o, e) for e in ea})]), lambda c: c.isNotNull())).alias("j")).select(*CELL, "old", F.col("j.oe").alias("oe"), F.col("j.k").alias("k")).where(F.col("k.l") == F.greatest("e", "oe"))
    right = b.select("*", F.explode(F.filter(F.array(*[F.when(F.col("oe") <= m, key("oe", "ox", "oy", m)) for m in sorted({max(o, e) for e in ea for o in eb})]), lambda c: c.isNotNull())).alias("k"))
    return left.join(right, ["oe", "k"]).select(*CELL, "oe", "ox", "oy", "old", "new", (F.col("new") - F.col("old")).alias("difference"))


def evaluate(tree: Tree, layer: str, points: DataFrame) -> DataFrame:
    """(columns of points, value): a bilinear layer evaluated at each position, relative to its sample cell's centre."""
    from ..functions.semantics import bilinear

    found = positions(tree, points, [layer])
    cx, cy = cells.position(*relative(SampleMode.CENTER))
    return found.select(*points.columns, bilinear(F.col(layer), F.col("px") - cx, F.col("py") - cy).alias("value"))
