"""Layer algebra: resampling, and merging or flattening many patches into one grid.

Patches are rows (patch_seq, e, x, y, layers): patch_seq orders the writers. Which value a cell
gets is one grouped aggregate over all layers, partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.semantics import semantic
from .overlay import CELL


def layer_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in [*CELL, "patch_seq", "src_e", "src_x", "src_y", "te", "tx", "ty"]]


def supersample(df: DataFrame, exponent: int, exponents: tuple[int, ...] | None = None) -> DataFrame:
    """Every cell copied to its 2^k x 2^k cells at a finer exponent; a coarser target raises."""
    if exponents is not None and exponent > min(exponents):
        raise ValueError(f"exponent {exponent} is coarser than samples of exponent {min(exponents)}")
    if exponents is not None and set(exponents) == {exponent}:
        return df
    n = F.col("e") - F.lit(exponent)
    if exponents is None:
        n = F.when(n < 0, F.raise_error(F.lit("the target is coarser than the samples")).cast("int")).otherwise(n)
    side = F.pow(F.lit(2.0), n).cast("long")
    across = F.sequence(F.lit(0).cast("long"), side - 1)
    rest = [c for c in df.columns if c not in CELL]
    out = df.select("x", "y", *rest, side.alias("_s"), F.explode(across).alias("_i")).select("x", "y", *rest, "_s", "_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1)).alias("_j"))
    return out.select(F.lit(exponent).alias("e"), (F.col("x") * F.col("_s") + F.col("_i")).alias("x"), (F.col("y") * F.col("_s") + F.col("_j")).alias("y"), *rest)


def _schema_types(df: DataFrame):
    return {f.name: f.dataType for f in df.schema.fields}


def merge_layers(patches: DataFrame) -> DataFrame:
    """First writer wins: patches of one exponent to one value a cell and layer.

    A later value is used only where all earlier ones are undefined in the sense of the layer;
    if all are undefined the first stays. Cells no patch has are no rows.
    """
    types = _schema_types(patches)
    aggs = []
    for n in layer_names(patches):
        gone = semantic(n, types[n]).undefined(F.col(n))
        aggs.append(F.min_by(n, F.struct(F.col(n).isNull().cast("int").alias("z"), gone.cast("int").alias("u"), F.col("patch_seq").alias("s"))).alias(n))
    return patches.groupBy(*CELL).agg(*aggs)


def flatten_layers(patches: DataFrame, exponents: tuple[int, ...], rank: str | None = None) -> DataFrame:
    """All patches at the finest exponent, painted from coarse to fine; of one exponent the last writer wins.

    An undefined value never paints over a defined one. The exponents are those that occur; rank
    names a column with the exponent that a row is painted by where that isn't its own.
    """
    finest = min(exponents)
    types = _schema_types(patches)
    names = [n for n in layer_names(patches) if n != rank]
    rows = patches.withColumn("_e", F.col(rank or "e"))
    parts = None
    for e in sorted(set(exponents)):
        own = rows.where(F.col("e") == e)
        own = own if e == finest else supersample(own, finest)
        own = own.select(*CELL, "patch_seq", "_e", *names)
        parts = own if parts is None else parts.unionByName(own)
    aggs = []
    for n in names:
        gone = semantic(n, types[n]).undefined(F.col(n))
        aggs.append(F.max_by(n, F.struct((~F.col(n).isNull()).cast("int").alias("z"), (~gone).cast("int").alias("d"), (-F.col("_e")).alias("f"), F.col("patch_seq").alias("s"))).alias(n))
    return parts.groupBy(*CELL).agg(*aggs)


def coarser(df: DataFrame) -> DataFrame:
    """One level of detail: each complete group of four cells becomes their parent with each layer's kernel."""
    types = _schema_types(df)
    names = layer_names(df)
    place = (F.col("x").bitwiseAND(1) + 2 * F.col("y").bitwiseAND(1)).cast("int")
    quads = [[F.max_by(n, place == q).alias(f"_{n}_{q}") for q in range(4)] for n in names]
    up = df.groupBy((F.col("e") + 1).alias("e"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.count("*").alias("_n"), *[c for q in quads for c in q])
    return up.where("_n = 4").select(*CELL, *[semantic(n, types[n]).coarser(*[F.col(f"_{n}_{q}") for q in range(4)]).alias(n) for n in names])


def pyramid(df: DataFrame, levels: int) -> DataFrame:
    """The samples with their next coarser levels of detail."""
    out, top = df, df
    for _ in range(levels):
        top = coarser(top)
        out = out.unionByName(top)
    return out


def window_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells of the first that the second lacks."""
    return first.join(second.select(*CELL), CELL, "left_anti")


def window_cells(df: DataFrame) -> DataFrame:
    """(e, x, y) of every cell of windows (e, x0, y0, x1, y1), max exclusive."""
    w = df.where("x1 > x0 and y1 > y0")
    w = w.select("e", "y0", "y1", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return w.select("e", "x", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))


def quadrant_values(df: DataFrame, layer: str) -> DataFrame:
    """(e, x, y, quadrant, value): the samples under their parents."""
    e, x, y, q = cells.parent()
    return df.select(e, x, y, q, F.col(layer).alias("value"))


def undefined(df: DataFrame, layer: str) -> Column:
    return semantic(layer, df.schema[layer].dataType).undefined(F.col(layer))
