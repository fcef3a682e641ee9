"""Cells of the dyadic grid: cell (e, x, y) is the square [x 2^e, (x+1) 2^e) x [y 2^e, (y+1) 2^e).

Column functions work on the columns ``e``, ``x``, ``y`` unless told otherwise; ``Cell`` and
``Box`` are driver-side scalars for metadata and query arguments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Relation(Enum):
    DISJOINT = "disjoint"
    PARTIAL = "partially overlapping"
    IDENTICAL = "identical"
    FIRST_CONTAINS = "first contains second"
    SECOND_CONTAINS = "second contains first"


@dataclass(frozen=True)
class Box:
    """An axis-parallel box in space."""

    x0: float
    y0: float
    x1: float
    y1: float

    def contains(self, other: Box) -> bool:
        """Closed on all sides."""
        return self.x0 <= other.x0 and self.y0 <= other.y0 and other.x1 <= self.x1 and other.y1 <= self.y1

    def intersects(self, other: Box) -> bool:
        """Open: boxes that only touch don't intersect."""
        return self.x0 < other.x1 and other.x0 < self.x1 and self.y0 < other.y1 and other.y0 < self.y1

    def union(self, other: Box) -> Box:
        return Box(min(self.x0, other.x0), min(self.y0, other.y0), max(self.x1, other.x1), max(self.y1, other.y1))

    def aligned(self, e: int) -> Box:
        """The smallest box of whole cells of exponent e around this one."""
        s = 2.0**e
        return Box(math.floor(self.x0 / s) * s, math.floor(self.y0 / s) * s, math.ceil(self.x1 / s) * s, math.ceil(self.y1 / s) * s)


@dataclass(frozen=True)
class IntBox:
    """A box of cell indices: min inclusive, max exclusive."""

    x0: int
    y0: int
    x1: int
    y1: int

    @property
    def size(self) -> tuple[int, int]:
        return self.x1 - self.x0, self.y1 - self.y0

    @property
    def empty(self) -> bool:
        return self.x1 <= self.x0 or self.y1 <= self.y0

    def has_point(self, x: int, y: int) -> bool:
        return self.x0 <= x < self.x1 and self.y0 <= y < self.y1

    def has_box(self, o: IntBox) -> bool:
        """Strict at the upper side."""
        return self.x0 <= o.x0 and self.y0 <= o.y0 and self.x1 > o.x1 and self.y1 > o.y1

    def covers(self, o: IntBox) -> bool:
        return self.x0 <= o.x0 and self.y0 <= o.y0 and self.x1 >= o.x1 and self.y1 >= o.y1

    def intersects(self, o: IntBox) -> bool:
        return self.x0 < o.x1 and o.x0 < self.x1 and self.y0 < o.y1 and o.y0 < self.y1

    def intersection(self, o: IntBox) -> IntBox | None:
        b = IntBox(max(self.x0, o.x0), max(self.y0, o.y0), min(self.x1, o.x1), min(self.y1, o.y1))
        return None if b.empty else b

    def split_at_center(self) -> list[IntBox]:
        cx, cy = (self.x0 + self.x1) // 2, (self.y0 + self.y1) // 2
        return [IntBox(self.x0, self.y0, cx, cy), IntBox(cx, self.y0, self.x1, cy), IntBox(self.x0, cy, cx, self.y1), IntBox(cx, cy, self.x1, self.y1)]

    def square_power_of_two(self) -> bool:
        w, h = self.size
        return w == h and w > 0 and w & (w - 1) == 0


@dataclass(frozen=True)
class Cell:
    """One cell; centred ones are the squares about the origin that only tiles and roots use."""

    x: int
    y: int
    e: int
    centered: bool = False

    @property
    def side(self) -> float:
        return 2.0**self.e

    @property
    def box(self) -> Box:
        s = self.side
        return Box(-s / 2, -s / 2, s / 2, s / 2) if self.centered else Box(self.x * s, self.y * s, (self.x + 1) * s, (self.y + 1) * s)

    @property
    def parent(self) -> Cell:
        return Cell(0, 0, self.e + 1, True) if self.centered else Cell(self.x >> 1, self.y >> 1, self.e + 1)

    @property
    def quadrant(self) -> int:
        """0 (0,0), 1 (1,0), 2 (0,1), 3 (1,1) within the parent."""
        return (self.x & 1) + 2 * (self.y & 1)

    @property
    def children(self) -> list[Cell]:
        if self.centered:
            return [Cell(x, y, self.e - 1) for y in (-1, 0) for x in (-1, 0)]
        return [Cell(2 * self.x + i, 2 * self.y + j, self.e - 1) for j in (0, 1) for i in (0, 1)]

    def ancestor(self, e: int) -> Cell:
        if e < self.e or self.centered:
            raise ValueError("an ancestor is at least as coarse and cells about the origin have none but their own kind")
        return Cell(self.x >> e - self.e, self.y >> e - self.e, e)

    def contains(self, other: Cell) -> bool:
        """Ancestor or self."""
        if self.centered or other.centered:
            return self.box.contains(other.box)
        return other.e <= self.e and other.ancestor(self.e) == self

    def bounds(self, e: int) -> IntBox:
        """Index box of this cell at exponent e; at a coarser exponent its one ancestor."""
        if self.centered:
            if e > self.e - 1:
                raise ValueError("a cell about the origin has no index box at its own or a coarser exponent")
            h = 1 << self.e - 1 - e
            return IntBox(-h, -h, h, h)
        if e > self.e:
            a = self.ancestor(e)
            return IntBox(a.x, a.y, a.x + 1, a.y + 1)
        k = self.e - e
        return IntBox(self.x << k, self.y << k, self.x + 1 << k, self.y + 1 << k)

    def relation(self, other: Cell) -> Relation:
        if self == other:
            return Relation.IDENTICAL
        if self.contains(other):
            return Relation.FIRST_CONTAINS
        if other.contains(self):
            return Relation.SECOND_CONTAINS
        return Relation.PARTIAL if self.box.intersects(other.box) else Relation.DISJOINT

    def union(self, other: Cell) -> Cell:
        """The smallest cell that holds both."""
        return Cell.of_box(self.box.union(other.box))

    @staticmethod
    def of_box(b: Box) -> Cell:
        """The smallest cell of a box: max-exclusive off the axes, centred and closed where it straddles one.

        A box that ends exactly on an axis belongs to the negative side.
        """
        if b.x0 < 0 < b.x1 or b.y0 < 0 < b.y1:
            reach = max(abs(v) for v in (b.x0, b.y0, b.x1, b.y1))
            return Cell(0, 0, math.ceil(math.log2(reach)) + 1, True)
        e = math.ceil(math.log2(max(b.x1 - b.x0, b.y1 - b.y0, 2.0**-60)))
        while True:
            s = 2.0**e
            cell = Cell(math.floor(b.x0 / s), math.floor(b.y0 / s), e)
            inside = lambda hi, k: hi < (k + 1) * s or (hi == 0 and k == -1)  # noqa: B023, E731
            if inside(b.x1, cell.x) and inside(b.y1, cell.y):
                return cell
            e += 1


def shift(c: Column, n: int | Column) -> Column:
    """Arithmetic right shift; a column n must not be negative."""
    if isinstance(n, int):
        return F.shiftright(c, n) if n else c
    return F.call_function("shiftright", c, n.cast("int"))


def size(e: Column | str = "e") -> Column:
    return F.pow(F.lit(2.0), F.col(e) if isinstance(e, str) else e)


def position(rx: float = 0.5, ry: float = 0.5) -> tuple[Column, Column]:
    """Position within each cell at the relative place (rx, ry)."""
    return (F.col("x") + F.lit(float(rx))) * size(), (F.col("y") + F.lit(float(ry))) * size()


def cell_index(p: Column, e: int | Column) -> Column:
    """Index along an axis of the cell of exponent e at position p."""
    scale = F.lit(2.0**-e) if isinstance(e, int) else F.pow(F.lit(2.0), -e)
    return F.floor(p * scale).cast("long")


def parent() -> tuple[Column, Column, Column, Column]:
    """(e, x, y) of the parent and the quadrant in it."""
    return (F.col("e") + 1).alias("e"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), (F.col("x").bitwiseAND(1) + 2 * F.col("y").bitwiseAND(1)).cast("int").alias("quadrant")


def ancestor(e: int) -> tuple[Column, Column]:
    """x and y of the ancestors at exponent e, which no cell may exceed."""
    n = F.lit(e) - F.col("e")
    return shift(F.col("x"), n), shift(F.col("y"), n)


def buffer_index(x: Column, y: Column, origin: tuple[int, int], width: int) -> Column:
    """Row-major index of a cell in a buffer."""
    return (y - F.lit(origin[1])) * F.lit(width) + (x - F.lit(origin[0]))


def bounding_box() -> list[Column]:
    """Aggregates for the exact bounding box of all cells."""
    s = size()
    return [F.min(F.col("x") * s).alias("x0"), F.min(F.col("y") * s).alias("y0"), F.max((F.col("x") + 1) * s).alias("x1"), F.max((F.col("y") + 1) * s).alias("y1")]


def different_quadrants(px: Column, py: Column, qx: Column, qy: Column, cx: float, cy: float) -> Column:
    """Whether two points lie in different quadrants about a centre."""
    return ((px < cx) != (qx < cx)) | ((py < cy) != (qy < cy))
