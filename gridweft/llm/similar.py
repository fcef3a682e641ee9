"""Near-duplicate texts by an exact join on the Jaccard similarity of their shingle sets.

Two sets of similarity t or more share an element among the first n - ceil(t n) + 1 of each, in
any order that is the same for all sets. Rare shingles come first, so few sets meet; the order
takes its counts from a sample, which changes the work and never the result. Shingles that more
sets have than are compared pair by pair are crowded: their sets are compared block by block.

SimHash can link texts too: by fingerprints of the same sets, found by covering masks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, simhash

#: Sets of which the common shingles are counted for the order (a 32nd of the rows where that is more), and shingles the order knows.
SAMPLE, KNOWN = 20_000, 500_000
#: Sets and shingles of a block of crowded sets.
BLOCK, MASS = 1000, 2_000_000
#: Sets up to which a column of a block is counted pair by pair, and columns of a product.
RARE, COLUMNS = 8, 4096


def shingles(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.word_hashes(text or b"", words, seed)])).view(np.int64)


def sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """(row, hashes): the distinct shingle hashes of each text; texts is (row, text as binary)."""
    schema = pa.schema([("row", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "text"):
                yield common.batch({"row": b.column(0), "hashes": pa.array([shingles(t.as_py(), words, seed) for t in b.column(1)], pa.list_(pa.int64()))}, schema)

    return texts.mapInArrow(common.lean(run), "row long, hashes array<long>")


def usual(texts: DataFrame, words: int, seed: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most sets of a sample have, ascending, and their numbers of sets; texts is (file, place, text)."""
    share = max(SAMPLE / max(1, rows), 1 / 32)
    some = texts if share >= 1 else texts.where(F.pmod(F.xxhash64(F.lit(1), "file", "place"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = sets(some.select(F.lit(0).cast("long").alias("row"), "text"), words, seed).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    h, n = np.asarray(top.column("h")), np.asarray(top.column("n"))
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a set by count in the sample and hash, of which similar sets share one."""
    n = len(h)
    count = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        count = np.where(known[at] == h, counts[at], 0)
    return h[np.lexsort((h, count))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]] if n else h


def described(texts: DataFrame, id_type: str, words: int, seed: int, similarity: float, known: np.ndarray, counts: np.ndarray, fingerprints: bool = False) -> DataFrame:
    """(row, file, place, id, digest, size, tokens, fp): each text's number, a 128-bit digest of its set, the set's size and prefix, and where asked for the fingerprint of a set that isn't empty; texts is (file, place, id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast((known, counts))

    def run(batches):
        (k, c), n = shared.value, TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in common.slices(whole, "text"):
                found = [shingles(t.as_py(), words, seed) for t in b.column(3)]
                tokens = pa.array([prefix(h, k, c, similarity) for h in found], pa.list_(pa.int64()))
                digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
                fps = pa.array([set_fingerprint(h) if fingerprints and len(h) else None for h in found], pa.int64())
                rows, n = pa.array(np.arange(n, n + len(found))), n + len(found)
                yield pa.RecordBatch.from_arrays([rows, *b.columns[:3], digests, pa.array(list(map(len, found)), pa.int32()), tokens, fps], names=["row", "file", "place", "id", "digest", "size", "tokens", "fp"])

    return texts.mapInArrow(common.lean(run), f"row long, file long, place long, id {id_type}, digest binary, size int, tokens array<long>, fp long")


def set_fingerprint(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingle hashes."""
    return simhash.signed(simhash.majority(h[at : at + simhash.HASHES] for at in range(0, len(h), simhash.HASHES)))


def fingerprint_links(table: DataFrame, link: int, bucket: int) -> DataFrame:
    """(u, v): rows with the reachability of all pairs of fingerprints of at most link differing bits; table is (row, fp), one row for each set."""
    some = table.where("fp is not null")
    fps = common.written(some.groupBy("fp").agg(F.min("row").alias("low"), F.count("*").alias("n")), "fingerprints")
    near = common.written(simhash.links(fps.select("fp"), link, link, bucket), "near-fingerprints")
    lows = fps.select("fp", "low")
    across = near.join(lows.toDF("u", "a"), "u").join(lows.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    equal = graph.joined(some.select("row", "fp"), fps.where("n > 1").select("fp", "low", "n"), "fp").where("row <> low").select(F.col("row").alias("u"), F.col("low").alias("v"))
    return across.union(equal)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)) sizes of the intersections of sets."""
    out = np.zeros((len(a), len(b)), np.float32)
    hs = np.concatenate([np.zeros(0, np.int64), *a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(hs, kind="stable")
    owner = owner[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[order][1:] != hs[order][:-1]
    column = np.cumsum(new) - 1
    left = owner < len(a)
    na, n = np.bincount(column, left), np.bincount(column)
    both = (na > 0) & (na < n)
    rare = both & (n <= RARE)
    starts = np.cumsum(n) - n
    # within a column the owners ascend: those of a come first
    for i in range(RARE):
        for j in range(i + 1, RARE):
            c = np.flatnonzero(rare & (na > i) & (na <= j) & (n > j))
            if len(c):
                np.add.at(out, (owner[starts[c] + i], owner[starts[c] + j] - len(a)), 1)
    place = np.cumsum(both & ~rare) - 1
    use = (both & ~rare)[column]
    where, who = place[column[use]], owner[use]
    for lo in range(0, int(where[-1]) + 1 if len(where) else 0, COLUMNS):
        p, q = np.searchsorted(where, (lo, lo + COLUMNS))
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[who[p:q], where[p:q] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Links of a symmetric matrix that have its reachability, each node at most once on the right."""
    seen, out = np.zeros(len(linked), bool), []
    for start in np.argsort(-linked.sum(1), kind="stable").tolist():
        if seen[start]:
            continue
        seen[start], open_ = True, [start]
        while open_:
            x = open_.pop()
            found = np.flatnonzero(linked[x] & ~seen)
            if len(found):
                seen[found] = True
                open_ += found.tolist()
                out.append((x, found))
    return out


def alike(ids: list[np.ndarray], hashes: list[list[np.ndarray]], similarity: float):
    """(u, v) arrays with the reachability of all links within one block, or between two."""
    a, b = hashes[0], hashes[-1]
    sa, sb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    common_ = overlaps(a, b)
    near = common_ >= similarity * (sa[:, None] + sb[None, :] - common_.astype(np.float64))
    if len(hashes) == 1:
        np.fill_diagonal(near, False)
        every = ids[0]
    else:
        whole = np.zeros((len(a) + len(b),) * 2, bool)
        whole[: len(a), len(a) :] = near
        near, every = whole | whole.T, np.concatenate(ids)
    for x, found in forest(near):
        yield np.full(len(found), every[x]), every[found]


def compare(members: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the sets of each crowded token that aren't in one group yet; members is (token, row, size, root), found (row, hashes).

    A token's largest group isn't compared within itself. The other sets are, and with it, in
    pairs of blocks that any task may take.
    """
    per = members.groupBy("token", "root").agg(F.count("*").alias("n"), F.max("size").alias("big"))
    most = F.max(F.struct("n", "root"))
    per = per.groupBy("token").agg(most["root"].alias("main"), most["n"].alias("mains"), (F.sum("n") - most["n"]).alias("sides"), F.max("big").alias("big")).where("sides > 0")
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(MASS) / F.col("big")))).cast("int")
    per = per.withColumn("ns", F.ceil(F.col("sides") / block)).withColumn("nm", F.ceil(F.col("mains") / block)).select("token", "main", "ns", "nm")
    m = members.join(common.small(per), "token")
    side = F.col("root") != F.col("main")
    m = m.select("token", "row", "ns", "nm", side.alias("side"), F.pmod(F.xxhash64(F.lit(2), "row"), F.when(side, F.col("ns")).otherwise(F.col("nm"))).alias("b"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    s, j, b = m.where("side"), F.col("j"), F.col("b")
    within = s.select("token", "row", "b", F.explode(upto("ns")).alias("j")).select("token", F.lit(0).alias("kind"), F.least(b, j).alias("i"), F.greatest(b, j).alias("j"), (b > j).cast("int").alias("part"), "row")
    across = s.select("token", "row", "b", F.explode(upto("nm")).alias("j")).select("token", F.lit(1).alias("kind"), b.alias("i"), "j", F.lit(0).alias("part"), "row")
    mains = m.where("not side").select("token", "row", "b", F.explode(upto("ns")).alias("j")).select("token", F.lit(1).alias("kind"), j.alias("i"), b.alias("j"), F.lit(1).alias("part"), "row")
    unit = ["token", "kind", "i", "j"]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        def told():
            if ids and (len(ids) == 2 or (last[1] == 0 and last[2] == last[3])):
                for u, v in alike([np.array(x) for x in ids.values()], list(hashes.values()), similarity):
                    yield common.batch({"u": u, "v": v}, schema)

        last, ids, hashes = None, {}, {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for k, (*now, part, row) in enumerate(zip(*columns)):
                if now != last:
                    yield from told()
                    last, ids, hashes = now, {}, {}
                ids.setdefault(part, []).append(row)
                hashes.setdefault(part, []).append(np.array(batch.column(6)[k].values))
        yield from told()

    units = within.union(across).union(mains).join(found, "row").select(*unit, "part", "row", "hashes")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, *unit).sortWithinPartitions(*unit, "part").mapInArrow(common.lean(run), "u long, v long").distinct()


def near_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v): distinct pairs of rows that share tokens and may be similar; members is (token, row, size, at), few of a token.

    Similar sets have t / (1 + t) of both sizes in common. No more are than follow their first
    common token in either, nor than the common tokens of both prefixes and what follows the
    prefix that ends first. That counts on all common tokens of the prefixes being in members: pairs
    with a crowded one may be missing, they are compared with its other sets.
    """
    need = lambda x, y: F.lit(similarity / (1 + similarity)) * (x + y) - 1e-6
    sized = lambda x, y: F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"]) - 1e-6
    left = lambda x: x["size"] - x["at"]
    sets_ = members.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("row", "size", "at"))).alias("s"))
    after = lambda x, i: F.filter(F.slice("s", i + 2, F.size("s")), lambda y: sized(x, y))
    told = lambda x, y: F.struct(x["row"].alias("u"), y["row"].alias("v"), x["size"].alias("su"), y["size"].alias("sv"), F.least(left(x), left(y)).alias("left"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(after(x, i), lambda y: told(x, y))))
    both = sets_.select(F.explode(pairs).alias("p")).select("p.*").groupBy("u", "v", "su", "sv").agg(F.count("*").alias("n"), F.max("left").alias("left"))
    rest = lambda n: F.ceil(F.col(n) * F.lit(similarity) - 1e-9) - 1  # noqa: E731  what follows the prefix
    need_ = need(F.col("su"), F.col("sv"))
    return both.where((F.col("left") >= need_) & (F.col("n") + F.greatest(rest("su"), rest("sv")) >= need_)).select("u", "v")


def within(units: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """(u, v): links between the texts of each unit; units is (unit, row, text as binary), small units only."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        def told():
            if len(rows) > 1:
                for u, v in alike([np.array(rows)], [hashes], similarity):
                    yield common.batch({"u": u, "v": v}, schema)

        last, rows, hashes = None, [], []
        for whole in batches:
            for b in common.slices(whole, "text"):
                for unit, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if unit != last:
                        yield from told()
                        last, rows, hashes = unit, [], []
                    rows.append(row)
                    hashes.append(shingles(text.as_py(), words, seed))
        yield from told()

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(common.lean(run), "u long, v long")


def links(texts: DataFrame, table: DataFrame, words: int, similarity: float, seed: int, bucket: int) -> DataFrame:
    """(u, v): rows of distinct sets, with the reachability of all pairs of at least that similarity.

    table is as described(), one row for each set; texts (file, place, text as binary) has the texts.
    Candidates that hang together are brought to one place and compared there; where more than a
    block hang together each pair is brought together.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = table.select("row", "size", F.posexplode("tokens").alias("at", "token"))
    counted = tokens.repartition(parts, "token").withColumn("n", F.count("*").over(Window.partitionBy("token")))
    members = common.written(counted.where("n > 1"), "bucket-members")
    pairs = common.written(near_pairs(members.where(F.col("n") <= bucket), similarity), "candidates")
    crowded = members.where(F.col("n") > bucket)
    roots = graph.components(pairs)
    of = table.select("row", "file", "place", "size")
    placed = common.written(roots.withColumnRenamed("node", "row").join(of, "row"), "units")
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.max("size").alias("big"))
    small = (F.col("n") <= BLOCK) & (F.col("n") * F.col("big") <= MASS)
    units = placed.join(sizes.where(small).select("root"), "root").select("file", "place", F.col("root").alias("unit"), "row")
    out = common.written(within(texts.join(common.small(units), ["file", "place"]).select("unit", "row", "text"), words, seed, similarity), "links")
    large = placed.join(sizes.where(~small).select("root"), "root").select("row", "file", "place")
    used = common.written(large.union(crowded.select("row").distinct().join(of, "row").select("row", "file", "place")).distinct(), "compared")
    if not used.limit(1).count():
        return out
    found = common.written(sets(texts.join(common.small(used), ["file", "place"]).select("row", "text"), words, seed), "shingles")
    some = large.select("row")
    both = pairs.join(some.withColumnRenamed("row", "u"), "u").join(found.toDF("u", "x"), "u").join(found.toDF("v", "y"), "v")
    same = F.size(F.array_intersect("x", "y"))
    out = common.written(out.union(both.where(same >= F.lit(similarity) * (F.size("x") + F.size("y") - same)).select("u", "v")), "links")
    if not crowded.limit(1).count():
        return out
    # each set under its first crowded token, then all tokens between the groups this leaves
    first = crowded.groupBy("row").agg(F.min_by(F.struct("token", "size"), "at").alias("t")).select("t.token", "row", "t.size")
    for some in (first, crowded.select("token", "row", "size")):
        roots = graph.components(out)
        grouped = some.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        grouped = common.written(grouped.select("token", "row", "size", "root"), "crowded")
        out = common.written(out.union(compare(grouped, found, similarity)), "links")
    return out


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, bucket: int | None = None, link: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept): the columns of docs as a struct, and whether the row stays: one of each group of near-duplicates.

    Two rows are linked when the Jaccard similarity of their texts' sets of word shingles is at
    least similarity; all such links are found at every size of the table. With link, 2 or 4, two rows
    are also linked when the SimHash fingerprints of these sets differ in at most link bits, whatever
    their similarity; all such links are found too. Sets without a shingle have no fingerprint: they
    are one class. Groups are the components of the links. The smallest id of a group is kept (null ids last, of equal ids one
    row). Null texts and texts without words are alike. Rows of one set, by a 128-bit digest of it,
    are one class that its first row stands for. Shingles of more than bucket classes are compared
    by blocks. Texts of any length are read whole; an empty table gives no rows; columns of docs may
    have any names. A table read from Parquet is read where it is, any other is written once.
    """
    spark = docs.sparkSession
    common.ship(spark)
    with common.scratch(spark):
        frame = common.placed(docs)
        at, idc = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
        texts = frame.select("file", "place", F.col(idc).alias("id"), F.col(at).cast("binary").alias("text"))
        bare = texts.select("file", "place", "text")
        table = common.written(described(texts, frame.schema[idc].dataType.simpleString(), words, seed, similarity, *usual(bare, words, seed, frame.count()), link is not None), "described")
        order = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row"))
        classes = common.written(table.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n"), order.alias("best")), "classes")
        copied = common.small(classes.where("n > 1").select("digest", "first"))
        copies = common.written(table.select("row", "digest").join(copied, "digest").where("row <> first").select("row"), "copies")
        bucket = simhash.BUCKET if bucket is None else bucket
        distinct = table.join(common.small(copies), "row", "left_anti")
        found = links(bare, distinct, words, similarity, seed, bucket)
        if link is not None:
            found = found.union(fingerprint_links(distinct.select("row", "fp"), link, bucket))
        roots = common.written(graph.components(found).withColumnRenamed("node", "first"), "groups")
        grouped = classes.select("digest", "first", "n", "best").join(roots, "first", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "first"))
        grouped = common.written(grouped, "grouped")
        stays = grouped.groupBy("root").agg(F.min("best").alias("s")).select("root", F.col("s.row").alias("stays"))
        goes = common.small(common.written(grouped.join(stays, "root").select("digest", "stays"), "stays"))
        gone = common.keep(common.written(table.select("row", "file", "place", "digest").join(goes, "digest").where("row <> stays").select("file", "place", F.lit(False).alias("kept")), "dropped"))
        out = frame.join(common.small(gone), ["file", "place"], "left")
        return out.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row"), F.coalesce("kept", F.lit(True)).alias("kept"))
