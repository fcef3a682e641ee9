"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Rows of a key from which they aren't brought to one task.
HOT = 100_000


def joined(rows: DataFrame, side: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """rows joined with side on key; side is (key, n, ...), one row for each key, with n its number of rows.

    Keys of more than hot rows, and of more than a common.BROADCAST_ROWS-th of all rows, are
    joined by broadcast: there are at most common.BROADCAST_ROWS of them.
    """
    most = side.agg(F.max("n"), F.sum("n")).first()
    least = max(hot, (most[1] or 0) // common.BROADCAST_ROWS)
    rest = side.drop("n")
    if (most[0] or 0) <= least:
        return rows.join(rest, key)
    hubs = F.broadcast(side.where(F.col("n") > least).drop("n"))
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(rest, key))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hung(both: DataFrame) -> DataFrame:
    """The edges of a small star: every node and its lower neighbours, on the smallest of them."""
    return both.select("u", F.col("m").alias("v")).union(both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _spread(e: DataFrame, both: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """A round where some node may have more than hot edges: (edges after it, tables it leaves)."""
    low = common.written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
    mins = low.select("u", F.least("u", "m").alias("m"), "n")
    large = common.written(joined(both, mins, "u", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    least = common.written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return common.written(_hung(joined(large, least, "u", hot)), "edges"), [e, low, large, least]


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """Smallest node reachable from each node: edges (u, v) of longs -> (node, root), one row for each node that has an edge.

    Null ends and loops are ignored; no edges give no rows. Each round hangs every node's neighbours
    on its smallest one; the rounds are few (logarithmic in practice), each is written to the shared
    folder, and only a count and a checksum of a round reach the driver. Minima are aggregated
    before the shuffle, and joined() keeps the edges of a hub where they are.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = common.written(e, "edges")
    before = _signature(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        if 2 * before[0] <= hot:  # no hub
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            after = common.written(_hung(large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")), "edges")
            old = [e]
        else:
            after, old = _spread(e, both, hot)
        now = _signature(after)
        for table in old:
            common.remove(table)
        e = after
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
