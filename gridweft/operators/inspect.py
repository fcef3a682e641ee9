"""Introspection: tiles, node counts, bounding boxes, printing and an HTML view."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.tree import EMPTY, Link, Merge, Raster, Tree, with_tiles
from .overlay import CELL


#: Cells are counted in blocks of at most 2^BLOCK cells per side, which have a bit for each in longs.
BLOCK = 4


def tiles(raster: Raster) -> DataFrame:
    """A row per leaf tile: te, tx, ty, e, split, window (wx0..wy1, max exclusive), exact bounding box, samples n, has_mask."""
    return tiles_of(raster.df, raster.split)


def tiles_of(rows: DataFrame, split: int) -> DataFrame:
    """tiles() of the raster whose cells are those of rows (e, x, y), which may repeat.

    Aggregates hold blocks instead of cells, so their memory goes with the area that has cells.
    """
    k = min(split, BLOCK)
    place = F.lit(0)
    for c, n in (("x", 0), ("y", k)):  # cells without an index are one
        place = place + F.coalesce(F.col(c).bitwiseAND((1 << k) - 1), F.lit(0)).cast("int") * (1 << n)
    words = range(max(1, 4**k // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63))
    ends = [f(c).alias(n) for n, c, f in (("x0", "x", F.min), ("y0", "y", F.min), ("x1", "x", F.max), ("y1", "y", F.max))]
    blocks = rows.select("e", "x", "y", cells.shift(F.col("x"), k).alias("tx"), cells.shift(F.col("y"), k).alias("ty"), place.alias("place"))
    blocks = blocks.groupBy("e", "tx", "ty").agg(*ends, *[F.bit_or(F.when(F.shiftright("place", 6) == w, bit)).alias(f"bits{w}") for w in words])
    counts = [F.coalesce(F.bit_count(f"bits{w}"), F.lit(0)).cast("long") for w in words]
    out = blocks.select("e", "tx", "ty", "x0", "y0", "x1", "y1", sum(counts[1:], counts[0]).alias("n"))
    if split > k:
        up = [cells.shift(F.col(c), split - k).alias(c) for c in ("tx", "ty")]
        out = out.select("e", *up, "x0", "y0", "x1", "y1", "n").groupBy("e", "tx", "ty").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
    window = [F.col("x0").alias("wx0"), F.col("y0").alias("wy0"), (F.col("x1") + 1).alias("wx1"), (F.col("y1") + 1).alias("wy1")]
    out = out.select((F.col("e") + F.lit(split)).alias("te"), "tx", "ty", "e", F.lit(split).alias("split"), *window, "n")
    box = [(F.col(f"w{c}") * cells.size()).alias(f"bb_{c}") for c in ("x0", "y0", "x1", "y1")]
    area = (F.col("wx1") - F.col("wx0")) * (F.col("wy1") - F.col("wy0"))
    return out.select("te", "tx", "ty", "e", "split", "wx0", "wy0", "wx1", "wy1", *box, "n", (F.col("n") < area).alias("has_mask"))


def leaves(tree: Tree) -> DataFrame:
    """(tree, te, tx, ty) of the leaf tiles of every base."""
    out = None
    for r in tree.bases():
        own = with_tiles(r.df, r.split).select(F.lit(r.id).alias("tree"), "te", "tx", "ty").distinct()
        out = own if out is None else out.unionByName(own)
    return EMPTY.samples.select(F.lit("").alias("tree"), F.col("e").alias("te"), F.col("x").alias("tx"), F.col("y").alias("ty")) if out is None else out


def inner_nodes(raster: Raster) -> DataFrame:
    """(te, tx, ty) of the ancestors of the tiles below and at the root; a root about the origin is one more node."""
    root = raster.root_cell()
    base = with_tiles(raster.df, raster.split).select("te", "tx", "ty").distinct()
    if root is None:
        return base
    levels = max(0, root.e - min(raster.exponents) - raster.split)
    if root.centered:
        levels -= 1
    up = F.explode(F.sequence(F.lit(1), F.lit(levels))) if levels > 0 else None
    if up is None:
        out = base.limit(0)
    else:
        k = F.col("k")
        out = base.select("te", "tx", "ty", up.alias("k")).select((F.col("te") + k).alias("te"), F.call_function("shiftright", F.col("tx"), k).alias("tx"), F.call_function("shiftright", F.col("ty"), k).alias("ty")).distinct()
    if root.centered and root.e > min(raster.exponents) + raster.split:
        out = out.union(base.sparkSession.createDataFrame([(root.e, 0, 0)], "te int, tx long, ty long"))
    return out


def centered_leaf(raster: Raster) -> bool:
    """Whether the whole raster is one tile about the origin."""
    root = raster.root_cell()
    return root is not None and root.centered and root.e <= min(raster.exponents) + raster.split


def count_leaf_nodes(tree: Tree) -> int:
    return sum(1 if centered_leaf(r) else leaves(r).count() for r in tree.bases())


def count_inner_nodes(tree: Tree) -> int:
    return sum(inner_nodes(r).count() for r in tree.bases())


def count_merge_nodes(tree: Tree) -> int:
    """Merges in the plan, each once."""
    if isinstance(tree, Merge):
        return 1 + count_merge_nodes(tree.first) + count_merge_nodes(tree.second)
    return count_merge_nodes(tree.target) if isinstance(tree, Link) else 0


def count_nodes(tree: Tree) -> int:
    return count_leaf_nodes(tree) + count_inner_nodes(tree) + count_merge_nodes(tree)


def nodes(tree: Tree, breadth_first: bool = False) -> list[Tree]:
    """The plan's trees: depth first, or level by level."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop(0) if breadth_first else todo.pop()
        out.append(t)
        below = [t.first, t.second] if isinstance(t, Merge) else [t.target] if isinstance(t, Link) else []
        todo += below if breadth_first else below[::-1]
    return out


def tiles_by_level(raster: Raster) -> DataFrame:
    """(te, tx, ty, leaf) of all nodes, coarse to fine, then in Morton order."""
    low = with_tiles(raster.df, raster.split).select("te", "tx", "ty").distinct().withColumn("leaf", F.lit(True))
    both = low.unionByName(inner_nodes(raster).withColumn("leaf", F.lit(False)))
    return both.orderBy(F.desc("te"), morton("tx", "ty"))


def morton(x: str, y: str) -> Column:
    """All bits of two longs interleaved, y before x, as a string that sorts in Morton order of the unsigned values."""
    bits = lambda c: F.split(F.lpad(F.bin(c), 64, "0"), "")
    return F.array_join(F.zip_with(bits(y), bits(x), lambda a, b: F.concat(a, b)), "")


def level_counts(df: DataFrame, layer: str | None = None) -> DataFrame:
    """(e, n[, n_nan]) per exponent."""
    extra = [F.sum(F.isnan(layer).cast("long")).alias("n_nan")] if layer else []
    return df.groupBy("e").agg(F.count("*").alias("n"), *extra)


def covered_area(df: DataFrame) -> DataFrame:
    """(e, area) of the samples per exponent."""
    return df.groupBy("e").agg((F.count("*") * F.pow(F.lit(4.0), F.first("e"))).alias("area"))


def structure(tree: Tree, indent: int = 0) -> str:
    """The plan as text."""
    pad = "  " * indent
    if isinstance(tree, Merge):
        return f"{pad}merge {tree.dominance.name}\n{structure(tree.first, indent + 1)}\n{structure(tree.second, indent + 1)}"
    if isinstance(tree, Link):
        return f"{pad}link {tree.id}\n{structure(tree.target, indent + 1)}"
    if isinstance(tree, Raster):
        return f"{pad}raster e={','.join(map(str, tree.exponents))} split={tree.split} layers={','.join(tree.layers)} box={tree.box}"
    return f"{pad}empty"


def to_html(df: DataFrame, layer: str, limit: int = 2000, scale: float = 32.0) -> str:
    """An SVG page of at most limit cells with their values, for a look at small rasters."""
    rows = df.select(*CELL, F.col(layer).cast("string").alias("v")).orderBy(*CELL).limit(limit).collect()
    boxes = [cells.Cell(r.x, r.y, r.e).box for r in rows]
    if not boxes:
        return "<svg xmlns='http://www.w3.org/2000/svg'></svg>"
    x0, y1 = min(b.x0 for b in boxes), max(b.y1 for b in boxes)
    parts = []
    for b, r in zip(boxes, rows):
        x, y, w = (b.x0 - x0) * scale, (y1 - b.y1) * scale, (b.x1 - b.x0) * scale
        parts.append(f"<g><rect x='{x:g}' y='{y:g}' width='{w:g}' height='{w:g}' fill='none' stroke='gray'/><text x='{x + w / 2:g}' y='{y + w / 2:g}' font-size='{w / 4:g}' text-anchor='middle'>{html.escape(r.v or '')}</text></g>")
    width = (max(b.x1 for b in boxes) - x0) * scale
    return f"<html><body><svg xmlns='http://www.w3.org/2000/svg' width='{width:g}' height='{(y1 - min(b.y0 for b in boxes)) * scale:g}'>{''.join(parts)}</svg></body></html>"
