"""Rasters from flat arrays, point files and query results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import Box, Cell, IntBox
from ..functions.semantics import semantic
from ..plans.tree import SPLIT, Raster


@dataclass(frozen=True)
class DataMapping:
    """How a row-major array lies on the grid: its first element, its size, and the window of it in use."""

    origin: Cell
    width: int
    height: int
    window: IntBox | None = None

    def __post_init__(self):
        if self.origin.centered:
            raise ValueError("samples can't be centred on the origin")
        if self.width <= 0 or self.height <= 0:
            raise ValueError("a buffer has a positive size")
        w = self.window or IntBox(self.origin.x, self.origin.y, self.origin.x + self.width, self.origin.y + self.height)
        if not IntBox(self.origin.x, self.origin.y, self.origin.x + self.width, self.origin.y + self.height).covers(w):
            raise ValueError("the window leaves the buffer")
        object.__setattr__(self, "window", w)

    @staticmethod
    def of_max(origin: Cell, max_inclusive: tuple[int, int]) -> DataMapping:
        return DataMapping(origin, max_inclusive[0] - origin.x + 1, max_inclusive[1] - origin.y + 1)

    @property
    def exponent(self) -> int:
        return self.origin.e

    @property
    def box(self) -> Box:
        s = self.origin.side
        return Box(self.window.x0 * s, self.window.y0 * s, self.window.x1 * s, self.window.y1 * s)

    def index(self, x: int, y: int) -> int:
        return (y - self.origin.y) * self.width + (x - self.origin.x)

    def cell_at(self, px: float, py: float) -> Cell:
        s = self.origin.side
        return Cell(int(px // s), int(py // s), self.origin.e)

    def contains(self, c: Cell) -> bool:
        return c.e == self.origin.e and self.window.has_point(c.x, c.y)

    def with_window(self, box: IntBox) -> DataMapping | None:
        w = self.window.intersection(box)
        return None if w is None else replace(self, window=w)


def from_arrays(spark: SparkSession, mapping: DataMapping, layers: dict[str, list], mask: list[int] | None = None, split: int = SPLIT) -> Raster:
    """A raster of one array per layer; mask 0 makes a hole."""
    if not layers:
        raise ValueError("a raster has at least one layer")
    area = mapping.width * mapping.height
    if any(len(v) < area for v in layers.values()):
        raise ValueError(f"the mapping needs {area} values")
    fields = [T.StructField("pos", T.LongType())] + [T.StructField(n, semantic(n).type) for n in layers]
    keep = [i for i in range(area) if (mask is None or mask[i]) and mapping.window.has_point(mapping.origin.x + i % mapping.width, mapping.origin.y + i // mapping.width)]
    rows = [(i, *[v[i] for v in layers.values()]) for i in keep]
    df = spark.createDataFrame(rows, T.StructType(fields))
    return Raster(_placed(df, mapping).select("e", "x", "y", *layers), (mapping.exponent,), split, mapping.box if mask is None else None, mask is not None)


def _placed(df: DataFrame, m: DataMapping) -> DataFrame:
    return df.withColumn("e", F.lit(m.exponent)).withColumn("x", F.col("pos") % m.width + m.origin.x).withColumn("y", F.floor(F.col("pos") / m.width).cast("long") + m.origin.y)


def explode_buffers(df: DataFrame, layer: str) -> DataFrame:
    """Samples of rows (e, ox, oy, w, [wx0, wy0, wx1, wy1,] data): one array each, exploded where it lies."""
    windows = ["wx0", "wy0", "wx1", "wy1"] if "wx0" in df.columns else []
    out = df.select("e", "ox", "oy", "w", *windows, F.posexplode("data").alias("pos", layer))
    out = out.withColumn("x", F.col("ox") + F.col("pos") % F.col("w")).withColumn("y", F.col("oy") + F.floor(F.col("pos") / F.col("w")).cast("long"))
    if windows:
        out = out.where("x >= wx0 and x < wx1 and y >= wy0 and y < wy1")
    return out.select("e", "x", "y", layer)


def to_array(df: DataFrame, mapping: DataMapping, layer: str, hole=None) -> list:
    """A layer of samples as a row-major array of the mapping's window; the window must fit the driver."""
    w, h = mapping.window.size
    out = [hole] * (w * h)
    for r in df.where((F.col("e") == mapping.exponent)).select("x", "y", layer).collect():
        if mapping.window.has_point(r.x, r.y):
            out[(r.y - mapping.window.y0) * w + r.x - mapping.window.x0] = r[layer]
    return out


def in_order(lines: DataFrame) -> DataFrame:
    """Adds seq, a struct that orders lines read from files: file, start of the split, line in the task that reads the split in order."""
    return lines.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))


def read_points(spark: SparkSession, path: str, columns: dict[str, int], separator: str = " ", header: bool = True) -> DataFrame:
    """Rows (seq, name...) of separated point files; columns gives each name's place. seq follows the files by name, and their lines, however they are split."""
    raw = in_order(spark.read.csv(path, sep=separator, header=False, inferSchema=False))
    rows = raw.select("seq", *[F.col(f"_c{i}").try_cast("double").alias(n) for n, i in columns.items()])
    return rows.where(F.col(next(iter(columns))).isNotNull()) if header else rows


def read_polygon(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """Vertices of a comma-separated file, one a line."""
    rows = in_order(spark.read.csv(path, schema="x double, y double")).orderBy("seq").collect()
    return [(r.x, r.y) for r in rows]


def rasterise(points: DataFrame, exponent: int, layers: list[str], split: int = SPLIT, truncate: bool = False) -> Raster:
    """Points (seq, px, py, layers) to cells: of several in a cell the last wins. truncate rounds towards zero instead of down."""
    scale = F.lit(2.0**-exponent)
    index = (lambda c: (F.col(c) * scale).cast("long")) if truncate else (lambda c: F.floor(F.col(c) * scale).cast("long"))
    rows = points.select(index("px").alias("x"), index("py").alias("y"), "seq", *layers)
    df = rows.groupBy("x", "y").agg(*[F.max_by(n, "seq").alias(n) for n in layers]).select(F.lit(exponent).alias("e"), "x", "y", *layers)
    return Raster(df, (exponent,), split, None, True)
