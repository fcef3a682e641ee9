"""Stores: trees as Parquet tables with a manifest, lazy when loaded.

A store is a folder of any file system Spark can reach. Every base raster is a folder of tiled
Parquet, written sorted by tile so that row groups prune; every tree has one small manifest with
its plan. Saving twice writes once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import Box
from ..operators.inspect import nodes
from ..operators.overlay import CELL, SOURCE, Dominance
from ..plans.tree import EMPTY, Link, Merge, Raster, Tree, with_tiles

VERSION = 1
#: Partition of a patch table that holds what was appended at once.
PART = "gridweft_part"


class Files:
    """How a store keeps its small files: any file system that Hadoop knows. Give a Store another one with these three methods to keep them elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _of(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def save(self, path: str, text: str) -> None:
        fs, p = self._of(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def load(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]


class Store:
    """A store at a path; without one, in memory for this session (cached, gone with it). files keeps the manifests."""

    def __init__(self, spark: SparkSession, path: str | None = None, cache: bool = False, files: Files | None = None):
        self.spark, self.path, self.cache = spark, path.rstrip("/") if path else None, cache
        self.files = files or Files(spark)
        self._trees: dict[str, Tree] = {}
        self._kept: dict[str, DataFrame] = {}

    def exists(self, tree_id: str) -> bool:
        return tree_id in self._trees if self.path is None else self.files.exists(f"{self.path}/trees/{tree_id}.json")

    def save(self, tree: Tree) -> str:
        """Keep a tree and with it all trees below; returns its id."""
        if tree is EMPTY:
            return tree.id
        if self.path is None:
            for r in tree.bases():
                if self.cache and r.id not in self._kept:
                    self._kept[r.id] = r.df.persist()
            self._trees.update({t.id: t for t in nodes(tree)})
            return tree.id
        for t in nodes(tree)[::-1]:  # what a manifest names is there before it
            if not self.exists(t.id):
                self.files.save(f"{self.path}/trees/{t.id}.json", json.dumps({"version": VERSION, "plan": self._plan(t)}))
        return tree.id

    def _plan(self, tree: Tree) -> dict:
        if isinstance(tree, Merge):
            return {"op": "merge", "id": tree.id, "dominance": tree.dominance.name, "bbox_elimination": tree.bbox_elimination, "first": self._plan(tree.first), "second": self._plan(tree.second)}
        if isinstance(tree, Link):
            return {"op": "link", "id": tree.id, "target": self._plan(tree.target)}
        if isinstance(tree, Raster):
            where = f"{self.path}/rasters/{tree.id}"
            if not Files(self.spark).exists(f"{where}/_SUCCESS"):
                rows = with_tiles(tree.df, tree.split)
                rows.repartitionByRange("te", "tx", "ty").sortWithinPartitions("te", "tx", "ty", "y", "x").write.mode("overwrite").parquet(where)
            b = tree.box
            return {"op": "raster", "id": tree.id, "exponents": tree.exponents, "split": tree.split, "has_mask": tree.has_mask, "box": [b.x0, b.y0, b.x1, b.y1] if b else None}
        return {"op": "empty"}

    def load(self, tree_id: str) -> Tree:
        """The tree of an id, its data unread; the empty tree when the store lacks it."""
        if not self.exists(tree_id):
            return EMPTY
        if self.path is None:
            return self._trees[tree_id]
        return self._tree(json.loads(self.files.load(f"{self.path}/trees/{tree_id}.json"))["plan"])

    def _tree(self, p: dict) -> Tree:
        if p["op"] == "merge":
            return Merge(Dominance[p["dominance"]], self._tree(p["first"]), self._tree(p["second"]), p["bbox_elimination"], p["id"])
        if p["op"] == "link":
            return Link(self._tree(p["target"]), p["id"])
        if p["op"] == "raster":
            df = self.spark.read.parquet(f"{self.path}/rasters/{p['id']}")
            if self.cache:
                df = self._kept.setdefault(p["id"], df.persist())
            return Raster(df, tuple(p["exponents"]), p["split"], Box(*p["box"]) if p["box"] else None, p["has_mask"], p["id"])
        return EMPTY

    def keys(self, tree_id: str) -> list[str]:
        """Ids of a tree, its subtrees and bases."""
        tree = self.load(tree_id)
        return [] if tree is EMPTY else [t.id for t in nodes(tree)]

    def export(self, target: Store, tree_id: str, progress=None, group: str | None = None) -> int:
        """Copy a tree to another store; returns the number of keys.

        progress is called with (done, all). Its jobs run under the job group, so that
        ``sparkContext.cancelJobGroup`` stops them.
        """
        tree = self.load(tree_id)
        if group:
            self.spark.sparkContext.setJobGroup(group, f"export {tree_id}", True)
        done = tree.bases()
        for k, r in enumerate(done):
            target.save(r)
            if progress:
                progress(k + 1, len(done))
        target.save(tree)
        return len(self.keys(tree_id))

    # patches

    def save_patches(self, patches: DataFrame, name: str | None = None, part: str | None = None) -> str:
        """Append rows (patch_seq, e, x, y, layers), partitioned by exponent. A part that is there already is replaced."""
        name = name or str(uuid.uuid4())
        patches.write.mode("overwrite").partitionBy("e").parquet(f"{self.path}/patches/{name}/{PART}={part or 'p' + uuid.uuid4().hex}")
        return name

    def load_patches(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/patches/{name}").withColumn("e", F.col("e").cast("int"))
        return df.select("patch_seq", *CELL, *[c for c in df.columns if c not in ["patch_seq", *CELL, *SOURCE, PART]])

    def export_patches(self, target: Store, name: str) -> str:
        """Copy a patch table to another store, under its name; returns the path of its key file, which import_patches() takes."""
        target.save_patches(self.load_patches(name), name, "exported")
        return target.key_file(name)

    def import_patches(self, source: Store, key: str) -> str:
        """Copy the patch table of a key file from another store; returns its name."""
        name = source.named(key)
        return self.save_patches(source.load_patches(name), name, "imported")

    def key_file(self, name: str) -> str:
        """Write the key file of a patch table; returns its path."""
        path = f"{self.path}/patch-keys/{name}.json"
        self.files.save(path, json.dumps({"version": VERSION, "patches": name}))
        return path

    def named(self, key: str) -> str:
        """The patch table that a key file names."""
        return json.loads(self.files.load(key))["patches"]

    def patch_exponents(self, name: str) -> tuple[int, ...]:
        return tuple(sorted(r[0] for r in self.load_patches(name).select("e").distinct().collect()))

    def release(self) -> None:
        """Drop what this store keeps in memory."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
