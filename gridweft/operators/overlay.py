"""Dominance overlay of two rasters as equi-joins on shifted cell keys.

Cells are nested or disjoint. A dominated cell inside a dominating one goes; one that holds
dominating cells is split into the children of every cell on the way down to them; all others
stay. No join compares more than equal keys and none has a product of both sides. Every join has
samples on both sides, so all are sorted: by their size in files or shuffles, millions of cells
pass for small enough to be broadcast, and an overlay of several levels would have many such
tables on the driver at once.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..sources.tables import cut

CELL = ["e", "x", "y"]
SOURCE = ["src_e", "src_x", "src_y"]


class Dominance(Enum):
    FIRST = "first"
    SECOND = "second"
    MORE_DETAILED_OR_FIRST = "more detailed, else first"
    MORE_DETAILED_OR_SECOND = "more detailed, else second"

    @property
    def flipped(self) -> Dominance:
        return {Dominance.FIRST: Dominance.SECOND, Dominance.SECOND: Dominance.FIRST, Dominance.MORE_DETAILED_OR_FIRST: Dominance.MORE_DETAILED_OR_SECOND, Dominance.MORE_DETAILED_OR_SECOND: Dominance.MORE_DETAILED_OR_FIRST}[self]


def _sorted(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast."""
    return df.hint("merge")


def _uncovered(y: DataFrame, x: DataFrame, ex: tuple[int, ...], ey: tuple[int, ...]) -> DataFrame:
    """Rows of y in no cell of x: one anti-join for each exponent of x that can hold a cell of y. Rows too coarse for a level keep keys of their own, which spreads them."""
    for level in ex:
        if level >= min(ey):
            own = x.where(F.col("e") == level).select(F.lit(level).alias("ke"), F.col("x").alias("kx"), F.col("y").alias("ky"))
            at = F.greatest(F.col("e"), F.lit(level))
            ax, ay = cells.shift(F.col("x"), at - F.col("e")), cells.shift(F.col("y"), at - F.col("e"))
            y = y.withColumns({"ke": at, "kx": ax, "ky": ay}).join(_sorted(own), ["ke", "kx", "ky"], "left_anti").drop("ke", "kx", "ky")
    return y


def dominate(x: DataFrame, y: DataFrame, ex: tuple[int, ...], ey: tuple[int, ...]) -> tuple[DataFrame, tuple[int, ...]]:
    """All of x, and y where x has no cell. Cells of each side are unique and disjoint; ex and ey are their exponents.

    Both have columns e, x, y, src_e, src_x, src_y and layers; a fragment keeps the source cell
    of the value it carries. Layers that one side lacks are null there. Values are never looked
    at: a dominating NaN covers.
    """
    if not ex or not ey:
        return (x, ex) if not ey else (y, ey)
    layers = [c for c in y.columns if c not in CELL + SOURCE]
    left = _uncovered(y, x, ex, ey)
    finer = [level for level in ey if level > min(ex)]
    if not finer:
        return x.unionByName(left, allowMissingColumns=True), tuple(sorted({*ex, *ey}))
    # each cell of x that is finer than a cell of y, with the cell of y around it
    held = F.array(*[F.when(F.col("e") < level, F.struct(F.lit(level).alias("ye"), *[c.alias(n) for c, n in zip(cells.ancestor(level), ("yx", "yy"))])) for level in finer])
    small = x.where(F.col("e") < max(finer)).select(*CELL, F.explode(F.filter(held, lambda c: c.isNotNull())).alias("in")).select(*CELL, "in.*")
    inside = small.join(_sorted(left.select(F.col("e").alias("ye"), F.col("x").alias("yx"), F.col("y").alias("yy"))), ["ye", "yx", "yy"])
    # the cells to split: every ancestor between them
    ups = F.transform(F.sequence(F.col("e") + 1, F.col("ye")), lambda up: F.struct(up.alias("e"), cells.shift(F.col("x"), up - F.col("e")).alias("x"), cells.shift(F.col("y"), up - F.col("e")).alias("y")))
    split = inside.select("ye", "yx", "yy", F.explode(ups).alias("s")).select("ye", "yx", "yy", "s.*").distinct()
    children = F.array(*[F.struct((F.col("e") - 1).alias("e"), (F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)])
    parts = split.select("ye", "yx", "yy", F.explode(children).alias("c")).select("ye", "yx", "yy", "c.*")
    taken = split.select(*CELL).union(x.select(*CELL))
    parts = parts.join(_sorted(taken), CELL, "left_anti")
    values = left.select(F.col("e").alias("ye"), F.col("x").alias("yx"), F.col("y").alias("yy"), *SOURCE, *layers)
    fragments = parts.join(_sorted(values), ["ye", "yx", "yy"]).select(*CELL, *SOURCE, *layers)
    whole = left.join(_sorted(split.where("e = ye").select(*CELL)), CELL, "left_anti").select(*CELL, *SOURCE, *layers)
    es = tuple(range(min(ex), max(*ex, *ey) + 1))
    return x.unionByName(whole, allowMissingColumns=True).unionByName(fragments, allowMissingColumns=True), es


def overlay(first: DataFrame, second: DataFrame, e1: tuple[int, ...], e2: tuple[int, ...], dominance: Dominance) -> tuple[DataFrame, tuple[int, ...]]:
    """The overlay of two rasters and the exponents it can have.

    Where the more detailed side wins, levels are laid under each other from the finest on; at
    one level ties go to the named side. Results of inner steps are written once when several
    steps build on them.
    """
    if dominance is Dominance.FIRST:
        return dominate(first, second, e1, e2)
    if dominance is Dominance.SECOND:
        return dominate(second, first, e2, e1)
    if dominance is Dominance.MORE_DETAILED_OR_SECOND:
        first, second, e1, e2 = second, first, e2, e1
    out, es = None, ()
    for k, level in enumerate(sorted({*e1, *e2})):
        own = None
        if level in e1:
            own = first.where(F.col("e") == level)
        if level in e2:
            other = second.where(F.col("e") == level)
            own = other if own is None else own.unionByName(other.join(_sorted(own.select(*CELL)), CELL, "left_anti"), allowMissingColumns=True)
        if out is None:
            out, es = own, (level,)
        else:
            out, es = dominate(cut(out) if k > 1 else out, own, es, (level,))
    return out, es
