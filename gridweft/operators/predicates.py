"""Spatial selections as predicates on (e, x, y), each with a box that no selected sample leaves."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import Box, Cell


class SampleMode(Enum):
    """Where in its cell a sample stands."""

    CENTER = (0.5, 0.5)
    BOTTOM_LEFT = (0.0, 0.0)
    BOTTOM_RIGHT = (1.0, 0.0)
    TOP_LEFT = (0.0, 1.0)
    TOP_RIGHT = (1.0, 1.0)


def relative(mode: SampleMode | tuple[float, float]) -> tuple[float, float]:
    return mode.value if isinstance(mode, SampleMode) else mode


@dataclass(frozen=True)
class Predicate:
    """keep: exponents -> Column. box: bounds of all cells that can be kept, None for all space."""

    keep: Callable[[tuple[int, ...]], Column]
    box: Box | None = None


def everything() -> Predicate:
    return Predicate(lambda es: F.lit(True))


def _by_level(exponents: tuple[int, ...], rule: Callable[[int], Column | None]) -> Column:
    """One comparison per exponent with literal bounds, which scans can push down."""
    out = None
    for e in exponents:
        own = rule(e)
        if own is not None:
            own = (F.col("e") == e) & own
            out = own if out is None else out | own
    return F.lit(False) if out is None else out


def _in(b: cells.IntBox) -> Column:
    return F.col("x").between(b.x0, b.x1 - 1) & F.col("y").between(b.y0, b.y1 - 1)


def inside_cell(cell: Cell) -> Predicate:
    """Samples whose cell lies in the given cell."""
    return Predicate(lambda es: _by_level(es, lambda e: _in(cell.bounds(e)) if e < cell.e + (not cell.centered) else None), cell.box)


def intersects_cell(cell: Cell) -> Predicate:
    """Samples whose square overlaps the given cell: its descendants, and the one cell around it where that is coarser."""

    def rule(e: int) -> Column:
        if cell.centered and e > cell.e - 1:
            return F.col("x").isin(-1, 0) & F.col("y").isin(-1, 0)
        return _in(cell.bounds(e))

    return Predicate(lambda es: _by_level(es, rule), cell.box)


def inside_box(box: Box) -> Predicate:
    """Samples whose whole cell lies in the closed box."""

    def rule(e: int) -> Column | None:
        s = 2.0**e
        b = cells.IntBox(math.ceil(box.x0 / s), math.ceil(box.y0 / s), math.floor(box.x1 / s), math.floor(box.y1 / s))
        return None if b.empty else _in(b)

    return Predicate(lambda es: _by_level(es, rule), box)


def _grown(box: Box, mode: tuple[float, float]) -> Box:
    """A box in index terms can't hold for positions outside their cell: no pruning then."""
    return box if 0 <= mode[0] <= 1 and 0 <= mode[1] <= 1 else None


def inside_polygon(vertices: list[tuple[float, float]], mode: SampleMode | tuple[float, float] = SampleMode.CENTER) -> Predicate:
    """Samples whose position lies in the polygon or on its boundary."""
    ring = [(float(x), float(y)) for i, (x, y) in enumerate(vertices) if (x, y) != vertices[i - 1] or len(vertices) == 1]
    if len(ring) < 3:
        raise ValueError("a polygon has at least three different vertices")
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) < 0:
        ring.reverse()
    xs, ys = zip(*ring)
    rel = relative(mode)

    def keep(es: tuple[int, ...]) -> Column:
        px, py = cells.position(*rel)
        odd, edge = F.lit(False), F.lit(False)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            cross = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
            if ay != by:
                spans = (py >= min(ay, by)) & (py < max(ay, by))
                odd = odd != (spans & ((cross < 0) if by > ay else (cross > 0)))
            edge = edge | ((cross == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by)))
        return px.between(min(xs), max(xs)) & py.between(min(ys), max(ys)) & (odd | edge)

    return Predicate(keep, _grown(Box(min(xs), min(ys), max(xs), max(ys)), rel))


def near_line(origin: tuple[float, float], direction: tuple[float, float], distance: float, mode: SampleMode | tuple[float, float] = SampleMode.CENTER, half_line: bool = False) -> Predicate:
    """Samples whose position is at most distance from the line, or from the half-line that starts at origin."""
    length = math.hypot(*direction)
    if not length:
        raise ValueError("a line has a direction")
    dx, dy = direction[0] / length, direction[1] / length
    rel = relative(mode)

    def keep(es: tuple[int, ...]) -> Column:
        px, py = cells.position(*rel)
        off = F.abs(F.lit(dx) * (py - origin[1]) - F.lit(dy) * (px - origin[0]))
        if half_line:
            along = F.lit(dx) * (px - origin[0]) + F.lit(dy) * (py - origin[1])
            off = F.when(along >= 0, off).otherwise(F.sqrt((px - origin[0]) ** 2 + (py - origin[1]) ** 2))
        return off <= distance

    return Predicate(keep)


def generic(keep: Callable[[], Column], box: Box | None = None) -> Predicate:
    """A predicate of one's own on e, x, y; box bounds the cells it can keep."""
    return Predicate(lambda es: keep(), box)


def pruning(box: Box | None, exponents: tuple[int, ...]) -> Column | None:
    """Index ranges per exponent of all cells that touch the box."""
    if box is None:
        return None

    def rule(e: int) -> Column:
        s = 2.0**e
        return _in(cells.IntBox(math.floor(box.x0 / s) - (box.x0 / s == math.floor(box.x0 / s)), math.floor(box.y0 / s) - (box.y0 / s == math.floor(box.y0 / s)), math.floor(box.x1 / s) + 1, math.floor(box.y1 / s) + 1))

    return _by_level(exponents, rule)
