"""Trees from many patches: append patches, then fold levels or flatten everything."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import Box, Cell, IntBox
from ..operators.layers import flatten_layers, layer_names, supersample
from ..operators.overlay import CELL, SOURCE, Dominance, overlay
from ..sources.tables import cut
from .tree import EMPTY, SPLIT, Raster, Tree, merge


class Builder:
    """Collects patches with the same layers. Adding is safe from several threads."""

    def __init__(self, split: int = SPLIT):
        self.split = split
        self._lock = threading.Lock()
        #: (rows, exponents, box, number of its first patch, whether rows have a patch_seq of their own)
        self._parts: list[tuple[DataFrame, tuple[int, ...], Box | None, int, bool]] = []
        self._next = 0

    def add(self, patch: Raster | DataFrame, exponent: int | None = None) -> Builder:
        """Append a raster, or rows (x, y, layers) of an exponent."""
        if isinstance(patch, Raster):
            for e in patch.exponents:
                self._append(patch.df.where(F.col("e") == e).select(*CELL, *patch.layers), (e,), patch.box)
        else:
            if exponent is None:
                raise ValueError("rows need their exponent")
            df = patch if "e" in patch.columns else patch.withColumn("e", F.lit(exponent))
            self._append(df, (exponent,), None)
        return self

    def add_range(self, patches) -> Builder:
        for p in patches:
            self.add(*p) if isinstance(p, tuple) else self.add(p)
        return self

    def add_table(self, rows: DataFrame) -> Builder:
        """Append a table of many patches (patch_seq, e, x, y, layers) as one part of the plan, after those there are."""
        r = rows.agg(F.collect_set("e").alias("es"), F.max("patch_seq").alias("last")).first()
        if r.last is not None:
            self._append(rows, tuple(sorted(r.es)), None, r.last + 1)
        return self

    def _append(self, df: DataFrame, es: tuple[int, ...], box: Box | None, numbers: int = 0) -> None:
        with self._lock:
            if self._parts and set(layer_names(self._parts[0][0])) != set(layer_names(df)):
                raise ValueError("all patches have the same layers")
            self._parts.append((df, es, box, self._next, bool(numbers)))
            self._next += numbers or 1

    @property
    def exponents(self) -> tuple[int, ...]:
        return tuple(sorted({e for _, es, *_ in self._parts for e in es}))

    def patches(self) -> DataFrame | None:
        """All patches as rows (patch_seq, e, x, y, layers)."""
        out = None
        for df, _, _, first, numbered in self._parts:
            seq = (F.col("patch_seq") if numbered else F.lit(0)) + F.lit(first)
            own = df.withColumn("patch_seq", seq.cast("long")).select("patch_seq", *CELL, *layer_names(df))
            out = own if out is None else out.unionByName(own)
        return out

    def describe(self) -> list[str]:
        return [f"patch {k}{'...' if numbered else ''}: e={','.join(map(str, es))} box={box}" for _, es, box, k, numbered in self._parts]

    def save(self, store, name: str | None = None) -> str:
        """Append all patches to a store's patch table; returns its name."""
        return store.save_patches(self.patches(), name)

    @staticmethod
    def load(store, name: str, split: int = SPLIT) -> Builder:
        """A builder over a stored patch table, which stays one table however many patches it has."""
        return Builder(split).add_table(store.load_patches(name))

    def export(self, store, name: str | None = None) -> str:
        """Save all patches with a key file beside them; returns the key file's path."""
        name = self.save(store, name)
        return store.key_file(name)

    @staticmethod
    def import_(store, key: str, split: int = SPLIT) -> Builder:
        """A builder over the patches of a key file."""
        return Builder.load(store, store.named(key), split)

    def build(self) -> Tree:
        """One raster per exponent (the last patch wins a cell), laid under each other, finer ones on top."""
        return fold(self.patches(), self.exponents, self.split)

    def build_adaptive(self) -> Tree:
        """Quadrants with a resolution of their own, see adaptive()."""
        return EMPTY if not self._parts else adaptive(self.patches(), self.split)

    def build_flat(self) -> Tree:
        """Everything in the grid of the finest patch."""
        return flat(self.patches(), self.exponents, self.split)


def fold(patches: DataFrame | None, exponents: tuple[int, ...], split: int = SPLIT) -> Tree:
    tree: Tree = EMPTY
    for e in sorted(exponents, reverse=True):
        tree = merge(Dominance.SECOND, tree, Raster(flatten_layers(patches.where(F.col("e") == e), (e,)), (e,), split, None, True))
    return tree


def flat(patches: DataFrame | None, exponents: tuple[int, ...], split: int = SPLIT) -> Tree:
    """The flattened raster of a patch table; the empty tree without patches."""
    if patches is None or not exponents:
        return EMPTY
    return Raster(flatten_layers(patches, exponents), (min(exponents),), split, None, True)


def flat_per_tile(patches: DataFrame, exponents: tuple[int, ...], split: int = SPLIT) -> Raster:
    """Each tile (of the finest exponent plus split) in the grid of its own finest patch.

    A tile's finest exponent is a grouped minimum, aggregated before it is shuffled; cells of
    patches coarser than a tile count in every tile they cover.
    """
    top = min(exponents) + split
    coarse = tuple(e for e in exponents if e > top)
    if coarse:  # a cell of such a patch becomes one cell in each of its tiles, which still ranks by its own exponent
        seen = patches.where(F.col("e") <= top).withColumn("_o", F.col("e"))
        for e in sorted(set(coarse)):
            own = patches.where(F.col("e") == e)
            seen = seen.unionByName(supersample(own, top, (e,)).withColumn("_o", F.lit(e)))
    else:
        seen = patches.withColumn("_o", F.col("e"))
    tile = [F.call_function("shiftright", F.col(c), (F.lit(top) - F.col("e")).cast("int")).alias(t) for c, t in (("x", "tx"), ("y", "ty"))]
    rows = seen.select("*", *tile)
    finest = rows.groupBy("tx", "ty").agg(F.min("e").alias("_f"))
    rows = rows.join(finest, ["tx", "ty"]).drop("tx", "ty")
    es = tuple(sorted({min(e, top) for e in exponents}))
    out = None
    for e in es:
        part = flatten_layers(rows.where(F.col("_f") == e).drop("_f"), tuple(x for x in es if x >= e), "_o")
        out = part if out is None else out.unionByName(part)
    return Raster(out, es, split, None, True)


@dataclass(frozen=True)
class Region:
    """A quadrant that isn't divided further, and the patches (number, exponent) whose windows reach into it."""

    cell: Cell
    patches: tuple[tuple[int, int], ...]
    #: single: one patch as it is; pair: an overlay, more detailed or second; flat: all in the grid of the finest
    kind: str


def regions(windows: list[tuple[int, int, IntBox]], split: int) -> list[Region]:
    """Divide the windows (number, exponent, indices) of patches into quadrants.

    Three and more patches are divided until one of the finest covers the quadrant, until all are of
    one exponent and fit into a tile, or down to a single sample. Only windows are looked at.
    """
    out: list[Region] = []
    if not windows:
        return out
    root = None
    for _, e, w in windows:
        b = Box(w.x0 * 2.0**e, w.y0 * 2.0**e, w.x1 * 2.0**e, w.y1 * 2.0**e)
        root = b if root is None else root.union(b)
    todo = [(Cell.of_box(root), windows)]
    while todo:
        cell, own = todo.pop()
        told = tuple((k, e) for k, e, _ in own)
        finest = min(e for _, e, _ in own)
        if cell.centered and len(own) < 3:  # a square about the origin is no ancestor of its cells: its quadrants are
            stop = ""
        elif len(own) < 3:
            stop = "single" if len(own) == 1 else "pair"
        else:
            whole = cell.bounds(finest) if not cell.centered else None
            alike = all(e == finest for _, e, _ in own)
            stop = "flat" if whole and (cell.e <= finest or (alike and cell.e <= finest + split) or any(e == finest and w.covers(whole) for _, e, w in own)) else ""
        if stop:
            out.append(Region(cell, told, stop))
            continue
        for child in cell.children:
            inside = [(k, e, cut) for k, e, w in own if (cut := w.intersection(child.bounds(e)))]
            if inside:
                todo.append((child, inside))
    return out


def adaptive(patches: DataFrame, split: int = SPLIT) -> Tree:
    """Each region of regions() in the resolution its own patches need. One row a patch reaches the driver.

    A cell coarser than its region is cut to the region. Rows find their region by equal keys, one
    for each exponent that regions have; regions are disjoint, so all are worked out at once.
    """
    spans = patches.groupBy("patch_seq", "e").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")])
    windows = [(r.patch_seq, r.e, IntBox(r.min_x, r.min_y, r.max_x + 1, r.max_y + 1)) for r in spans.orderBy("patch_seq", "e").collect()]
    found = regions(windows, split)
    if not found:
        return EMPTY
    names = layer_names(patches)
    told = [(r.cell.e, r.cell.x, r.cell.y, r.kind, min(e for _, e in r.patches), k == 0, seq, e) for r in found for k, (seq, e) in enumerate(r.patches)]
    # a list has no size that the planner knows, and it would broadcast the samples instead
    table = patches.sparkSession.createDataFrame(told, "ce int, cx long, cy long, kind string, finest int, _first boolean, patch_seq long, pe int")
    levels = sorted({r.cell.e for r in found})
    up = F.explode(F.filter(F.array(*[F.when(F.col("e") <= level, F.lit(level)) for level in levels]), lambda c: c.isNotNull()))
    fine = patches.select("*", up.alias("ce"))
    fine = fine.withColumns({"cx": cells.shift(F.col("x"), F.col("ce") - F.col("e")), "cy": cells.shift(F.col("y"), F.col("ce") - F.col("e"))})
    small = table.where("pe <= ce").withColumnRenamed("pe", "e")
    fine = fine.join(F.broadcast(small), ["patch_seq", "e", "ce", "cx", "cy"]).select("patch_seq", *CELL, "kind", "finest", "_first", F.col("e").alias("_o"), *names)
    large = table.where("pe > ce").withColumns({"x": cells.shift(F.col("cx"), F.col("pe") - F.col("ce")), "y": cells.shift(F.col("cy"), F.col("pe") - F.col("ce"))}).withColumnRenamed("pe", "e")
    coarse = patches.join(F.broadcast(large), ["patch_seq", *CELL]).select("patch_seq", F.col("ce").alias("e"), F.col("cx").alias("x"), F.col("cy").alias("y"), "kind", "finest", "_first", F.col("e").alias("_o"), *names)
    rows = cut(fine.unionByName(coarse))
    parts, es = [], set()
    if any(r.kind == "single" for r in found):
        parts.append(rows.where("kind = 'single'").select(*CELL, *names))
        es |= {min(e, r.cell.e) for r in found if r.kind == "single" for _, e in r.patches}
    for finest in sorted({min(e for _, e in r.patches) for r in found if r.kind == "flat"}):
        grid = {min(finest, r.cell.e) for r in found if r.kind == "flat" and min(e for _, e in r.patches) == finest}
        have = tuple(sorted({min(e, r.cell.e) for r in found if r.kind == "flat" and min(e for _, e in r.patches) == finest for _, e in r.patches} | grid))
        own = rows.where((F.col("kind") == "flat") & (F.col("finest") == finest)).drop("kind", "finest", "_first")
        parts.append(flatten_layers(own, have, "_o"))
        es.add(min(have))
    pairs = [r for r in found if r.kind == "pair"]
    if pairs:
        own = rows.where("kind = 'pair'").withColumns({s: F.col(c) for c, s in zip(CELL, SOURCE)})
        # of two patches in a region the first is that of the smaller number
        first, second = (cut(own.where(F.col("_first") == (k == 0)).select(*CELL, *SOURCE, *names)) for k in (0, 1))
        e1 = tuple(sorted({min(r.patches[0][1], r.cell.e) for r in pairs}))
        e2 = tuple(sorted({min(r.patches[1][1], r.cell.e) for r in pairs}))
        both, eb = overlay(first, second, e1, e2, Dominance.MORE_DETAILED_OR_SECOND)
        parts.append(both.select(*CELL, *names))
        es |= set(eb)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Raster(cut(out), tuple(sorted(es)), split, None, True)
