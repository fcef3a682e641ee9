"""Exact duplicates by a content sort, in DataFrame operations only.

Range partitioning on a bounded splitter key (the first 32 code points of the normalised text and
its hash; for hot texts also a salt) puts equal texts into one partition; the sort inside is Spark's
external sort over whole normalised texts, and the window compares each text in full with its
neighbour. The splitter key only decides where a text goes, never what it equals. The window takes
the range partitions as they are: texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 4, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, and with keep_columns the row's own columns as struct ``row``.

    Equal normalised texts form a group; the row with the most code points in its original text,
    then the smallest id, stays (null ids last; of rows alike in both exactly one). Null and empty
    texts are one group; texts of any length are compared whole. A text with more copies than
    rows / (hot_share * partitions) is salted over all partitions: there are at most
    hot_share * partitions such texts, so their hashes can be named in the plan and their groups,
    merged from partial aggregates, broadcast; any other group is a fraction of a partition.
    Empty tables give no rows; only the two named columns are read unless keep_columns is set.
    Columns of any other name, also those of the result, may be in docs.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in (docs.columns if keep_columns else dict.fromkeys([id_col, text_col]))])
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    norm = normalised(text)
    base = docs.select(row.alias("row")).select("row", F.col(f"row.`{id_col}`").alias("id"), F.length(text).alias("len"), F.substring(norm, 1, 32).alias("head"), F.xxhash64(norm).alias("h"))
    total = docs.count()
    crowd = base.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * hot_share * parts > max(total, 8 * hot_share * parts)).select("h").collect()
    where = ["head", "h"]
    if crowd:
        salt = F.when(F.col("h").isin([r.h for r in crowd]), F.pmod(F.xxhash64("id", "len", F.spark_partition_id()), F.lit(parts)) + 1).otherwise(0)
        base, where = base.withColumn("salt", salt.cast("long")), [*where, "salt"]
    placed = base.repartitionByRange(parts, *where).withColumn("norm", norm)
    group = Window.partitionBy(*where, "norm").orderBy(F.desc("len"), F.asc_nulls_last("id"))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, salted = ["row"] if keep_columns else [], ["salt"] if crowd else []
    seen = placed.select(*own, "id", *salted, "len", "norm", F.first("id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("size"), F.row_number().over(group).alias("place")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    keep = F.col("place") == 1
    if crowd:  # the groups of hot texts, merged before any shuffle: no text of theirs moves twice
        first = F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("salt").alias("s"))
        best = base.where("salt > 0").withColumn("norm", norm).groupBy("norm").agg(F.count("*").alias("g_size"), F.min(first).alias("g"))
        seen = seen.join(F.broadcast(best.select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "g_size", "g")), "sha", "left")
        hot = (F.col("salt") > 0) & F.col("g").isNotNull()
        keep = keep & (~hot | (F.col("salt") == F.col("g.s")))
        seen = seen.withColumn("keep_id", F.when(hot, F.col("g.i")).otherwise(F.col("keep_id"))).withColumn("size", F.when(hot, F.col("g_size")).otherwise(F.col("size")))
    return seen.select(*own, F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"), keep.alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(txt) DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
