"""Trees: rasters and the merges between them, resolved when they are queried.

A tree is an immutable logical plan. Its base rasters are DataFrames with one row per sample
cell (e, x, y and a column per layer); the exponents that occur are kept on the driver, so that
overlays and pruning are planned without reading data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import Box, Cell
from ..operators.overlay import CELL, SOURCE, Dominance, overlay
from ..operators.predicates import Predicate, pruning
from ..sources.tables import cut

SPLIT = 8


class Tree:
    """Common to all trees; see Raster, Merge, Link and EMPTY."""

    id: str

    @property
    def exponents(self) -> tuple[int, ...]:
        raise NotImplementedError

    @property
    def layers(self) -> tuple[str, ...]:
        raise NotImplementedError

    def bases(self) -> list[Raster]:
        """The base rasters, first to last."""
        raise NotImplementedError

    def resolved(self, box: Box | None = None, only: Predicate | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        """All samples with their source cells, and their possible exponents.

        box limits the bases to cells that touch it; only filters them first.
        """
        raise NotImplementedError

    @property
    def samples(self) -> DataFrame:
        return self.resolved()[0]

    def bounding_box(self) -> Box | None:
        """The exact bounding box; reads the cells of the bases that don't know theirs."""
        boxes = [b for b in (r.bounding_box() for r in self.bases()) if b]
        out = None
        for b in boxes:
            out = b if out is None else out.union(b)
        return out

    def contains_layer(self, name: str) -> bool:
        return name in self.layers

    def layer(self, name: str) -> DataFrame:
        """Cells and values of one layer; a tree without it raises."""
        if name not in self.layers:
            raise ValueError(f"no layer {name}")
        return self.samples.select(*CELL, name)

    def try_layer(self, name: str) -> DataFrame | None:
        return self.layer(name) if name in self.layers else None

    def renamed(self, old: str, new: str) -> Tree:
        """The tree with a layer's meaning changed: unchanged where it lacks the layer, an error where new exists."""
        raise NotImplementedError

    def in_memory(self) -> Tree:
        """The tree with the samples of its bases kept by the executors; unpersist their df to let them go."""
        raise NotImplementedError

    def root_cell(self) -> Cell | None:
        box = self.bounding_box()
        return None if box is None else Cell.of_box(box)


@dataclass(frozen=True)
class Raster(Tree):
    """One base raster. df has unique, disjoint cells."""

    df: DataFrame = field(repr=False)
    known_exponents: tuple[int, ...]
    split: int = SPLIT
    box: Box | None = None
    has_mask: bool = False
    id: str = field(default_factory=lambda: str(uuid.uuid4()))

    @property
    def exponents(self) -> tuple[int, ...]:
        return self.known_exponents

    @property
    def layers(self) -> tuple[str, ...]:
        return tuple(c for c in self.df.columns if c not in CELL + SOURCE + ["te", "tx", "ty"])

    def bases(self) -> list[Raster]:
        return [self]

    def resolved(self, box: Box | None = None, only: Predicate | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        df = self.df
        limit = pruning(box, self.exponents)
        if limit is not None:
            df = df.where(limit)
        if only is not None:
            df = df.where(only.keep(self.exponents))
        source = [F.col(s) if s in self.df.columns else F.col(c).alias(s) for c, s in zip(CELL, SOURCE)]
        return df.select(F.col("e").cast("int").alias("e"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *source, *self.layers), self.exponents

    @cached_property
    def _box(self) -> Box | None:
        if self.box is not None:
            return self.box
        r = self.df.agg(*cells.bounding_box()).first()
        return None if r.x0 is None else Box(r.x0, r.y0, r.x1, r.y1)

    def bounding_box(self) -> Box | None:
        return self._box

    def renamed(self, old: str, new: str) -> Raster:
        if old not in self.layers:
            return self
        if new in self.layers:
            raise ValueError(f"layer {new} is there already")
        return replace(self, df=self.df.withColumnRenamed(old, new), id=str(uuid.uuid4()))

    def with_window(self, window: cells.IntBox) -> Raster | None:
        """The samples of a single-level raster with indices in the window; None when it can't hold any."""
        (e,) = self.exponents
        s = 2.0**e
        box = Box(window.x0 * s, window.y0 * s, window.x1 * s, window.y1 * s)
        if window.empty or (self.box and not self.box.intersects(box)):
            return None
        own = None if self.box is None or self.has_mask else Box(max(self.box.x0, box.x0), max(self.box.y0, box.y0), min(self.box.x1, box.x1), min(self.box.y1, box.y1))
        kept = self.df.where(F.col("x").between(window.x0, window.x1 - 1) & F.col("y").between(window.y0, window.y1 - 1))
        return replace(self, df=kept, box=own, id=str(uuid.uuid4()))

    def in_memory(self) -> Raster:
        return replace(self, df=self.df.persist())

    def with_layers(self, *names: str) -> Raster:
        """Only the named layers, in this order."""
        return replace(self, df=self.df.select(*CELL, *names), id=str(uuid.uuid4()))


@dataclass(frozen=True)
class Merge(Tree):
    """A deferred overlay. bbox_elimination drops a side whose bounding box the winner's covers, gaps included."""

    dominance: Dominance
    first: Tree
    second: Tree
    bbox_elimination: bool = False
    id: str = field(default_factory=lambda: str(uuid.uuid4()))

    @property
    def exponents(self) -> tuple[int, ...]:
        es = {*self.first.exponents, *self.second.exponents}
        return tuple(range(min(es), max(es) + 1))

    @property
    def layers(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.first.layers, *self.second.layers]))

    def bases(self) -> list[Raster]:
        return [*self.first.bases(), *self.second.bases()]

    def resolved(self, box: Box | None = None, only: Predicate | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        if box is not None:  # whole cells of the coarsest level: what happens in one never depends on another
            box = box.aligned(max(self.exponents))
        if self.bbox_elimination and self.dominance in (Dominance.FIRST, Dominance.SECOND):
            top, low = (self.first, self.second) if self.dominance is Dominance.FIRST else (self.second, self.first)
            b, c = top.bounding_box(), low.bounding_box()
            if b and c and b.contains(c):
                return top.resolved(box, only)
        (a, e1), (b, e2) = self.first.resolved(box, only), self.second.resolved(box, only)
        # an overlay reads its sides several times: inner merges are worked out once, within the box
        a, b = (cut(d) if isinstance(t, Merge) else d for d, t in ((a, self.first), (b, self.second)))
        if all(t.box for t in self.bases()) and not self.first.bounding_box().intersects(self.second.bounding_box()):
            return a.unionByName(b, allowMissingColumns=True), tuple(sorted({*e1, *e2}))
        return overlay(a, b, e1, e2, self.dominance)

    def in_memory(self) -> Merge:
        return replace(self, first=self.first.in_memory(), second=self.second.in_memory())

    def renamed(self, old: str, new: str) -> Merge:
        if old not in self.layers:
            return self
        return Merge(self.dominance, self.first.renamed(old, new), self.second.renamed(old, new), self.bbox_elimination)


@dataclass(frozen=True)
class Link(Tree):
    """Another name of a tree."""

    target: Tree
    id: str = field(default_factory=lambda: str(uuid.uuid4()))

    @property
    def exponents(self) -> tuple[int, ...]:
        return self.target.exponents

    @property
    def layers(self) -> tuple[str, ...]:
        return self.target.layers

    def bases(self) -> list[Raster]:
        return self.target.bases()

    def resolved(self, box: Box | None = None, only: Predicate | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        return self.target.resolved(box, only)

    def in_memory(self) -> Link:
        return replace(self, target=self.target.in_memory())

    def renamed(self, old: str, new: str) -> Link:
        return Link(self.target.renamed(old, new), self.id)


class _Empty(Tree):
    id = "00000000-0000-0000-0000-000000000000"
    exponents: tuple[int, ...] = ()
    layers: tuple[str, ...] = ()

    def bases(self) -> list[Raster]:
        return []

    def resolved(self, box: Box | None = None, only: Predicate | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        from pyspark.sql import SparkSession

        schema = "e int, x long, y long, src_e int, src_x long, src_y long"
        return SparkSession.active().createDataFrame([], schema), ()

    def in_memory(self) -> Tree:
        return self

    def renamed(self, old: str, new: str) -> Tree:
        return self


EMPTY = _Empty()


def merge(dominance: Dominance, first: Tree, second: Tree, bbox_elimination: bool = False) -> Tree:
    """Overlay two trees lazily; the empty tree changes nothing.

    A side without gaps whose known box covers the other wins at once.
    """
    if first is EMPTY or second is EMPTY:
        return second if first is EMPTY else first
    if dominance in (Dominance.FIRST, Dominance.SECOND):
        top, low = (first, second) if dominance is Dominance.FIRST else (second, first)
        base = top.bases()
        if len(base) == 1 and base[0].box and not base[0].has_mask and all(r.box for r in low.bases()) and base[0].box.contains(low.bounding_box()):
            return top
    return Merge(dominance, first, second, bbox_elimination)


def build(df: DataFrame, exponent: int, split: int = SPLIT, box: Box | None = None, has_mask: bool = True) -> Raster:
    """A base raster of one exponent from rows (x, y, layers), or (e, x, y, layers)."""
    if split < 0:
        raise ValueError("the split exponent must not be negative")
    if "e" not in df.columns:
        df = df.withColumn("e", F.lit(exponent))
    layers = [c for c in df.columns if c not in CELL]
    if not layers:
        raise ValueError("a raster has at least one layer")
    return Raster(df.select(*CELL, *layers), (exponent,), split, box, has_mask)


def with_tiles(df: DataFrame, split: int = SPLIT) -> DataFrame:
    """Adds the tile (te, tx, ty) of each sample: its ancestor split levels up."""
    return df.withColumn("te", F.col("e") + F.lit(split)).withColumn("tx", cells.shift(F.col("x"), split)).withColumn("ty", cells.shift(F.col("y"), split))


# queries


def query(tree: Tree, predicate: Predicate, min_exponent: int | None = None, filter_first: bool = False) -> DataFrame:
    """Samples (e, x, y, src_e, src_x, src_y, layers) that the predicate keeps.

    The overlay comes first and the filter after it; the bases are limited to the predicate's
    box before, to whole cells of the coarsest level, which changes no result. filter_first
    filters both sides of every merge before it and their fragments again. A tile below
    min_exponent is an error, as levels of detail are not kept in trees.
    """
    if min_exponent is not None:
        for r in tree.bases():
            if min(r.exponents) + r.split < min_exponent:
                raise ValueError(f"tiles of exponent {min(r.exponents) + r.split} are finer than {min_exponent}")
    df, es = tree.resolved(predicate.box, predicate if filter_first else None)
    return df.where(predicate.keep(es))


def per_tile(tree: Tree, make, schema: str, predicate: Predicate | None = None) -> DataFrame:
    """Rows that make(tile, samples) gives for every leaf tile of the tree's bases that has samples: a pandas frame, or None for nothing.

    tile is (te, tx, ty); samples is a pandas frame (e, x, y, layers) of at most 4^split rows a base exponent.
    """
    def of(names: list[str]):
        def run(key, frame):
            import pandas as pd

            found = make(tuple(int(k) for k in key), frame[names])
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(",")]) if found is None else found

        return run

    out = None
    for r in tree.bases():
        df, es = r.resolved(predicate.box if predicate else None)
        rows = with_tiles((df.where(predicate.keep(es)) if predicate else df).select(*CELL, *r.layers), r.split)
        own = rows.groupBy("te", "tx", "ty").applyInPandas(of([*CELL, *r.layers]), schema)
        out = own if out is None else out.union(own)
    return EMPTY.samples.sparkSession.createDataFrame([], schema) if out is None else out


def full(tree: Tree) -> DataFrame:
    """All samples of all bases, whoever dominates."""
    out = None
    for r in tree.bases():
        own = r.resolved()[0].select(*CELL, *r.layers)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return EMPTY.samples.select(*CELL) if out is None else out
