"""Embedding near-duplicates by sorted projection passes.

In a pass the vectors of a label are ordered by the concatenated signs of random projections, and
every vector is compared with those in a window of blocks before it. A label that fits in the
window has one pass, which then compares all its pairs. A larger one has passes with projections of
their own, as many as bring the chance to miss a pair at the least cosine under a bound; the chance
is worked out from how far the label's vectors spread around their mean, which is taken off before
they are projected. Where so many passes would compare as much as all pairs do, a label is compared
block by block instead. What is linked is always decided by the cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .similar import forest

#: Least cosine of a link; vectors of a block, and most blocks before a vector's own in its window.
COSINE, BLOCK, LOOK = 0.93, 1024, 15
#: Chance that all passes miss a pair at the least cosine; share of such pairs left after those that range partitions cut; passes whose rows are shuffled at once.
MISS, UNCUT, TOGETHER = 1e-4, 0.85, 4
#: What sending a vector once costs, in comparisons of it with a block.
SEND = 2
#: Signs of an order; rows of a class from which it is joined by broadcast.
SIGNS, HOT = 62, 100_000


def passes(rows: int, spread: float = 1.0, cosine: float = COSINE, block: int = BLOCK, look: int = LOOK, miss: float = MISS) -> tuple[int, int]:
    """(blocks before a vector's own, passes) for a label of so many vectors; no passes where all pairs of blocks cost less.

    spread is the mean squared distance of the unit vectors from their mean. Two of cosine c differ
    by an angle of about acos(1 - (1 - c) / spread) seen from it, each sign agrees with probability
    1 - angle / pi, and a pair that agrees in enough signs to be in one window's length is compared.
    """
    agree = 1 - math.acos(max(-1.0, 1 - (1 - cosine) / max(spread, 1e-9))) / math.pi
    best = (math.ceil(rows / block) * (0.5 + SEND), 0, 0)
    for back in sorted({1, 3, 7, look} if look > 7 else {1, look}):
        if rows <= (back + 1) * block:
            n = 1
        else:
            hit = UNCUT * agree ** math.ceil(math.log2(rows / (back * block)))
            n = math.ceil(math.log(miss) / math.log1p(-min(hit, 1 - 1e-9))) if hit > 1e-12 else 1 << 40
        cost = 0 if n == 1 else n * (back + 1 + SEND)
        if n == 1 or cost < best[0]:
            best = (cost, back, n)
        if n == 1:
            break
    return best[1], best[2]


class Block:
    """Vectors of one block: ids, numbers of rows, unit vectors; links counts the rows each is linked with."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        self.x32, self.links = self.x.astype(np.float32), np.zeros(len(ids), np.int64)


def near(a: Block, b: Block, cosine: float) -> np.ndarray:
    """Which pairs have at least the cosine: single precision where it is sure, double where it is close."""
    p = a.x32 @ b.x32.T
    sure = 1e-6 + 2.4e-7 * a.x.shape[1]
    linked = p >= cosine + sure
    i, j = np.nonzero((p >= cosine - sure) & ~linked)
    for at in range(0, len(i), 1 << 16):
        u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        linked[u, v] = np.einsum("ij,ij->i", a.x[u], b.x[v]) >= cosine
    if a is b:
        np.fill_diagonal(linked, False)
    return linked


def counted(a: Block, b: Block, cosine: float):
    """Add a pair of blocks' links to their counts; gives (u, v) with the links' reachability."""
    linked = near(a, b, cosine)
    if not linked.any():
        return
    a.links += (linked @ b.sizes.astype(np.float64)).astype(np.int64)
    if a is not b:
        b.links += (a.sizes.astype(np.float64) @ linked).astype(np.int64)
    rows = np.flatnonzero(linked.any(1))
    if a is b:
        every, square = a.ids[rows], linked[np.ix_(rows, rows)]
    else:
        columns = np.flatnonzero(linked.any(0))
        every, square = np.concatenate([a.ids[rows], b.ids[columns]]), np.zeros((len(rows) + len(columns),) * 2, bool)
        square[: len(rows), len(rows) :] = linked[np.ix_(rows, columns)]
        square |= square.T
    for x, found in forest(square):
        yield np.full(len(found), every[x]), every[found]


def pairs(a: Block, b: Block, cosine: float):
    """All linked pairs (u, v) of a pair of blocks."""
    i, j = np.nonzero(near(a, b, cosine))
    if a is b:
        i, j = i[i < j], j[i < j]
    if len(i):
        yield np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])


OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return common.batch({"u": u, "v": v, "n": pa.nulls(len(u), pa.int64())}, OUT)


def _counts(b: Block) -> pa.RecordBatch:
    some = b.links > 0
    return common.batch({"u": b.ids[some], "v": pa.nulls(int(some.sum()), pa.int64()), "n": b.links[some]}, OUT)


def _runs(batches, keys: int, limit: int):
    """(key, rows as a Block) of sorted rows (keys..., dim, id, size, v): runs of one key in pieces of at most limit rows."""
    last, parts, held = None, [], 0

    def whole():
        return last, Block(*(np.concatenate([p[k] for p in parts]) for k in range(3)))

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).dictionary_encode() for k in range(keys)]
        codes = np.stack([np.asarray(c.indices) for c in columns], 1)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), b.num_rows]
        ids, sizes, values, at = np.asarray(b.column(keys)), np.asarray(b.column(keys + 1)), b.column(keys + 2).flatten(), 0
        dims = np.asarray(pa.compute.list_value_length(b.column(keys + 2)))
        for lo, hi in zip(cuts, cuts[1:]):
            now, dim = tuple(c.dictionary[i].as_py() for c, i in zip(columns, codes[lo].tolist())), int(dims[lo])
            x = np.asarray(values.slice(at, (hi - lo) * dim), np.float64).reshape(-1, dim)
            at += (hi - lo) * dim
            if now != last and parts:
                yield whole()
                parts, held = [], 0
            last = now
            while lo < hi:
                take = min(hi - lo, limit - held)
                parts.append((ids[lo : lo + take], sizes[lo : lo + take], x[:take]))
                x, lo, held = x[take:], lo + take, held + take
                if held == limit:
                    yield whole()
                    parts, held = [], 0
    if parts:
        yield whole()


def window(batches, cosine: float, block: int):
    """Rows of OUT from sorted rows (pass, label, dim, look, once, id, size, v): each block against itself and the look blocks before it."""
    last, held = None, []
    for now, b in _runs(batches, 5, block):
        look, once = now[3:]
        if now != last:
            for old in held if last and last[4] else []:
                yield _counts(old)
            last, held = now, []
        for old in [*held, b]:
            for u, v in (counted if once else pairs)(old, b, cosine):
                yield _edges(u, v)
        held.append(b)
        if len(held) > look:
            gone = held.pop(0)
            if once:
                yield _counts(gone)
    for old in held if last and last[4] else []:
        yield _counts(old)


def squares(batches, cosine: float, block: int):
    """Rows of OUT from sorted rows (label, dim, i, j, part, id, size, v): block i against block j."""
    def told():
        if unit and (len(sides) == 2 or unit[2] == unit[3]):
            a, b = sides[min(sides)], sides[max(sides)]
            for x in a:
                for y in b[b.index(x) :] if a is b else b:
                    for u, v in counted(x, y, cosine):
                        yield _edges(u, v)
            for x in {id(x): x for x in (*a, *b)}.values():
                yield _counts(x)

    unit, sides = None, {}
    for now, b in _runs(batches, 5, block):
        if now[:4] != unit:
            yield from told()
            unit, sides = now[:4], {}
        sides.setdefault(now[4], []).append(b)
    yield from told()


def _means(classes: DataFrame) -> DataFrame:
    """(label, dim, mean): the mean of the unit vectors of each label."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int64()), ("total", pa.list_(pa.float64())), ("n", pa.int64())])

    def run(batches):
        sums: dict = {}
        for (label, dim, _, _, _), b in _runs(batches, 5, 1 << 12):
            old = sums.get((label, dim), (0.0, 0))
            sums[label, dim] = old[0] + b.x.sum(0), old[1] + len(b.ids)
            if len(sums) > 64:
                yield common.batch({"label": [k[0] for k in sums], "dim": [k[1] for k in sums], "total": [list(v[0]) for v in sums.values()], "n": [v[1] for v in sums.values()]}, schema)
                sums = {}
        if sums:
            yield common.batch({"label": [k[0] for k in sums], "dim": [k[1] for k in sums], "total": [list(v[0]) for v in sums.values()], "n": [v[1] for v in sums.values()]}, schema)

    none = [F.lit(0).alias(c) for c in "abc"]
    part = classes.select("label", "dim", *none, "id", "size", "v").mapInArrow(common.lean(run), "label string, dim long, total array<double>, n long")
    each = part.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("m"))
    return each.groupBy("label", "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))


def _ordered(large: DataFrame, first: int, last: int, seed: int, v_type: str) -> DataFrame:
    """(pass, label, dim, look, once, place, id, size, v): each vector with its signs in the passes first to last - 1 that its label has; large has a mean."""
    rows = large.select("label", "dim", "look", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.lit(last).cast("long"), F.col("passes")) - 1)).alias("pass"), "id", "size", "v", "mean").where(F.col("passes") > first)

    def run(batches):
        planes: dict = {}
        for b in batches:
            place = np.zeros(b.num_rows, np.int64)
            dims, turn = np.asarray(b.column("dim")), np.asarray(b.column("pass"))
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                take = pa.array(own)
                x, m = (np.asarray(b.column(c).take(take).flatten(), np.float64).reshape(-1, d) for c in ("v", "mean"))
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] - m
                for p in np.unique(turn[own]).tolist():
                    if (d, p) not in planes:
                        planes[d, p] = np.random.default_rng([seed, d, p]).normal(size=(d, SIGNS))
                    at = np.flatnonzero(turn[own] == p)
                    place[own[at]] = (x[at] @ planes[d, p] > 0) @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
            names = ["pass", "label", "dim", "look", "once", "place", "id", "size", "v"]
            columns = [b.column("pass"), b.column("label"), b.column("dim"), b.column("look"), pa.array(np.zeros(b.num_rows, bool)), pa.array(place), b.column("id"), b.column("size"), b.column("v")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(common.lean(run), f"pass long, label string, dim long, look int, once boolean, place long, id long, size long, v {v_type}")


def linked(classes: DataFrame, cosine: float, block: int, look: int, seed: int = 6) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the reachability of all links, and (id, others): rows that each id's vector is linked with; classes is (label, dim, id, size, v)."""
    spark = classes.sparkSession
    parts, v_type = int(spark.conf.get("spark.sql.shuffle.partitions")), classes.schema["v"].dataType.simpleString()
    shuffled = lambda df, n, *by: df.repartitionByRange(n, *by).sortWithinPartitions(*by, "id")
    labels = common.written(classes.groupBy("label", "dim").agg(F.count("*").alias("rows")), "labels")
    small, large = labels.where(F.col("rows") <= (look + 1) * block), labels.where(F.col("rows") > (look + 1) * block)
    once = classes.join(common.small(small.select("label", "dim")), ["label", "dim"])
    once = once.select(F.lit(0).cast("long").alias("pass"), "label", "dim", F.lit(look).alias("look"), F.lit(True).alias("once"), F.lit(0).cast("long").alias("place"), "id", "size", "v")
    columns = ["pass", "label", "dim", "look", "once", "id", "size", "v"]
    run = lambda df: df.select(*columns).mapInArrow(common.lean(lambda bs: window(bs, cosine, block)), "u long, v long, n long")
    found = [common.written(run(shuffled(once, parts, "pass", "label", "dim", "place")), "links")]
    many: list[DataFrame] = []
    if large.limit(1).count():  # at most one label for every (look + 1) * block vectors
        some = classes.join(common.small(large.select("label", "dim")), ["label", "dim"])
        means = common.written(_means(some), "means")
        spread = large.join(means, ["label", "dim"]).select("label", "dim", "rows", "mean", (1 - F.aggregate("mean", F.lit(0.0), lambda s, m: s + m * m)).alias("spread"))
        told = spread.select("label", "dim", "rows", "spread").collect()
        plan = [(r.label, r.dim, *passes(r.rows, r.spread, cosine, block, look)) for r in told]
        plan = common.written(spark.createDataFrame(plan, "label string, dim long, look int, passes long").join(means, ["label", "dim"]), "plan")
        some = some.join(common.small(plan), ["label", "dim"])
        most = plan.agg(F.max("passes")).first()[0] or 0
        rows = sum(r.rows for r in told)
        for at in range(0, most, TOGETHER):
            n = max(1, min(parts, rows * TOGETHER // (4 * look * block)))
            keyed = _ordered(some.where("passes > 0"), at, at + TOGETHER, seed, v_type)
            many.append(common.written(run(shuffled(keyed, n, "pass", "label", "dim", "place")).select("u", "v").distinct(), "links"))
        counts = large.join(plan.where("passes = 0").select("label", "dim"), ["label", "dim"]).select("label", "dim", F.ceil(F.col("rows") / block).alias("blocks"))
        if counts.limit(1).count():
            dense = classes.join(common.small(counts), ["label", "dim"])
            dense = dense.withColumn("b", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            units = dense.select("label", "dim", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") > F.col("other")).cast("long").alias("part"), "id", "size", "v")
            unit = ["label", "dim", "i", "j"]
            units = units.repartition(parts, *unit).sortWithinPartitions(*unit, "part")
            found.append(common.written(units.mapInArrow(common.lean(lambda bs: squares(bs, cosine, block)), "u long, v long, n long"), "links"))
    told = found[0]
    for f in found[1:]:
        told = told.union(f)
    edges, others = told.where("v is not null").select("u", "v"), told.where("v is null").select(F.col("u").alias("id"), F.col("n").alias("others"))
    if many:
        both = many[0]
        for f in many[1:]:
            both = both.union(f)
        both = common.written(both.distinct(), "pairs")
        edges = edges.union(both)
        sizes = classes.select(F.col("id").alias("v"), F.col("size").alias("others"))
        others = others.union(both.union(both.select("v", "u")).join(sizes, "v").select(F.col("u").alias("id"), "others"))
    return edges, others.groupBy("id").agg(F.sum("others").alias("others"))


def near_dedup(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, look: int = LOOK, hot: int = HOT, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for every row of vectors.

    Only vectors of one label and length are compared, by cosine in double precision. Null, empty
    and zero vectors, those with null or non-finite components, null labels and null ids link
    with nothing (component: the id itself). Rows alike in label and vector, by a 128-bit digest, are
    one class: its smallest id stands for it, and each row has a link to every other row of its
    class and of the linked classes, so copies are never expanded into pairs. All pairs are compared
    in labels of up to (look + 1) * block classes; see passes() for larger ones. An empty table
    gives no rows, repeated rows a row each. Only the three columns are read; others may have any names.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    with common.scratch(spark):
        element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
        rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(f"array<{element}>").alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
        rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda c: c + F.lit(0.0).cast(element))))  # -0.0 becomes 0.0
        rows = rows.withColumn("h", F.xxhash64(F.lit(1), "label", "v")).withColumn("g", F.xxhash64(F.lit(2), "v", "label"))
        grouped = rows.where("v is not null").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
        classes = common.written(grouped.select("h", "g", "label", F.size("v").cast("long").alias("dim"), "id", "size", "v"), "classes")
        edges, others = linked(classes.select("label", "dim", "id", "size", "v"), cosine, block, look)
        roots = graph.components(edges)
        of = classes.select("h", "g", "id", "size").join(others, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
        of = common.keep(common.written(of.select("h", "g", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"), "size"), "vector-groups"))
        seen = rows.where("v is not null").select("id", "h", "g")
        crowd = of.where(F.col("size") > hot).select("h", "g", "n_links", "component_id")
        if crowd.limit(1).count():  # classes with many rows: at most rows / hot of them
            seen = seen.join(F.broadcast(crowd), ["h", "g"], "left")
            cold = seen.where("component_id is null").select("id", "h", "g").join(of, ["h", "g"])
            found = seen.where("component_id is not null").select("id", "n_links", "component_id").union(cold.select("id", "n_links", "component_id"))
        else:
            found = seen.join(of, ["h", "g"]).select("id", "n_links", "component_id")
        out = found.union(rows.where("v is null").select("id", F.lit(0).cast("long"), F.col("id")))
        return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum([abs(x::DOUBLE) for x in embedding]) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
low AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
