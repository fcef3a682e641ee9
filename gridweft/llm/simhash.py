"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Bit i gets
the nonzero vector m(i) of r + 1 bits; table v (every nonzero vector) keeps the bits whose m(i)
has odd overlap with v. The at most r bits in which two fingerprints differ span at most r
dimensions, so some v is orthogonal to all of them: the pair agrees on every bit of that table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

#: Fingerprints of a bucket that are compared pair by pair; fuller buckets go through neighbour variants.
BUCKET = 64
#: Copies of a fingerprint from which its documents take their component from a broadcast row, see graph.joined().
HOT = 100_000
HASHES = 1 << 16


def word_hashes(text: bytes, words: int, seed: int = 42):
    """XXH64 of each shingle of a UTF-8 text, in pieces of at most HASHES values; nothing when it has no word."""
    parts = text.lower().split()
    if not parts:
        return
    joined = memoryview(b" ".join(parts))
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))[words - 1 :]
    for at in range(0, len(ends), HASHES):
        a, b = starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()
        yield np.array([digest(joined[i:j], seed) for i, j in zip(a, b)], np.uint64)


def majority(pieces) -> int:
    """The bits that over half the hashes have, as an unsigned integer; pieces are arrays of 64-bit hashes, none give 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit majority fingerprint as an unsigned integer; 0 for a null text or one without words."""
    return majority(word_hashes(text or b"", words, seed))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text."""
    common.ship(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            out = common.unsigned([fingerprint(t.as_py(), words, seed) for t in b.column(1)])
            yield common.batch({"id": b.column(0), "fp": pa.array(out.view(np.int64))}, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(common.lean(run), "id long, fp long")


def masks(radius: int, key_bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 covering masks; key_bits keeps that many bits of each, drawn by table, which only adds collisions."""
    size, out = (1 << radius + 1) - 1, []
    vector = [1 + i % size for i in range(64)]
    for v in range(1, size + 1):
        bits = [i for i in range(64) if (vector[i] & v).bit_count() & 1]
        out.append(sum(1 << i for i in random.Random(v).sample(bits, min(key_bits, len(bits)))))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(fps: DataFrame, radius: int, key_bits: int = 64) -> DataFrame:
    """(table, key, fp): the distinct fingerprints under every mask, from as many tasks as a shuffle has."""
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    tables = F.array(*[F.lit(signed(m)) for m in masks(radius, key_bits)])
    return fps.select("fp", F.posexplode(tables).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _buckets(rows: DataFrame) -> DataFrame:
    """(table, key, n, a, b, c): keys with several fingerprints, their least and greatest, and the third where there are three."""
    grouped = rows.groupBy("table", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("c")).where("n > 1")
    return common.written(grouped.withColumn("c", F.when(F.col("n") == 3, F.col("c").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")))), "buckets")


def _small(full: DataFrame) -> DataFrame:
    """(u, v): all pairs of buckets of two and three."""
    pairs = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")), F.struct(F.col("c").alias("u"), F.col("b").alias("v")))
    return full.where("n <= 3").select(F.explode(F.when(F.col("n") == 3, pairs).otherwise(F.slice(pairs, 1, 1))).alias("p")).select("p.*")


def _members(rows: DataFrame, full: DataFrame) -> DataFrame:
    n = full.count()
    return rows.join(F.broadcast(full) if n <= common.BROADCAST_ROWS else full, ["table", "key"])


def _variants(rows: DataFrame, radius: int, link: int) -> DataFrame:
    """Links of crowded buckets: every fingerprint names all values within link / 2 bits outside the mask, and hangs on the smallest that names the same one.

    Two that name one value differ in at most link bits, and any two of a bucket that differ in
    at most link bits name a common value, so no link is lost and none is false; a row makes
    at most 1 + 32 + 32 * 31 / 2 variants whatever the size of its bucket.
    """
    if link % 2 or link > 4:
        raise ValueError("crowded buckets need a link distance of 2 or 4")
    flips = []
    for t, m in enumerate(masks(radius)):
        free = [1 << i for i in range(64) if not m >> i & 1]
        own = [0, *free, *([a | b for i, a in enumerate(free) for b in free[:i]] if link == 4 else [])]
        flips += [(t, signed(x)) for x in own]
    table = F.broadcast(rows.sparkSession.createDataFrame(flips, "table int, flip long"))
    named = rows.join(table, "table").select("table", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"), "fp")
    low = named.groupBy("table", "key", "name").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    joined = named.join(low, ["table", "key", "name"])
    return joined.where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def links(fps: DataFrame, radius: int = 4, link: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(u, v): edges between distinct fingerprints with the same reachability as all pairs of at most link <= radius differing bits."""
    if link > radius:
        raise ValueError("a link distance beyond the covering radius would lose pairs")
    rows = keyed(fps, radius)
    full = _buckets(rows)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= link
    out = _small(full).where(near)
    some = _members(rows, full.where(f"n between 4 and {bucket}").select("table", "key"))
    pairs = some.select("table", "key", F.col("fp").alias("u")).join(some.select("table", "key", F.col("fp").alias("v")), ["table", "key"]).where(F.col("u") < F.col("v")).where(near)
    out = out.union(pairs.select("u", "v"))
    crowded = full.where(F.col("n") > max(3, bucket)).select("table", "key")
    if crowded.limit(1).count():
        out = out.union(_variants(_members(rows, crowded), radius, link))
    return out.distinct()


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4, link: int = 4, seed: int = 42, bucket: int = BUCKET, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id), one row for every row of docs.

    component_id is the smallest id reachable through fingerprints of at most link differing
    bits, itself included. Null and empty texts have fingerprint 0 and link like any other.
    Rows of null id link like any other but never name a component: it is null where no row within
    reach has an id. Repeated rows and ties share their fingerprint's component.
    Texts of any length are read whole; an empty table gives no rows. Extra columns of docs, whatever
    they are called, are not read.
    """
    spark = docs.sparkSession
    with common.scratch(spark):
        rows = common.keep(common.written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints"))
        fps = common.written(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
        roots = common.written(graph.components(links(fps.select("fp"), radius, link, bucket)), "roots")
        named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", F.col("n").alias("copies"), "low", "root")
        lows = common.written(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lows")
        of = graph.joined(named, lows, "root").select("fp", F.col("copies").alias("n"), "component_id")
        of = common.keep(common.written(of, "components"))
    out = graph.joined(rows, of, "fp", hot)
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """See similar.similar_groups."""
    from . import similar

    return similar.similar_groups(docs, **options)
