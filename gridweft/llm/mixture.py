"""Mixing sources to target weights by iterative proportional fitting.

Token counts of (source, language, topic) cells are raked to the target marginals of the three
dimensions; documents are then sampled with their cell's calibrated probability. Few cells are
raked by the driver, more as tables; every category is raked by itself in both ways. Where the
documents bring no topic, it is learned: texts become small integer sketches of their distinct
words, and k-means over the sketches of all texts names the nearest centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Categories of source, language and topic, and cells, up to which the driver rakes; beyond, tables are raked. Nothing is pooled as OTHER.
LIMITS, CELLS = {"source": 500, "lang": 60, "topic": 20}, 100_000
OTHER, NULL = "(other)", "(null)"
#: Power of the natural shares that makes the default targets; share of all tokens that is kept.
POWER, KEEP = 0.8, 0.9
SEED = 10
#: Learned topics, rounds over all sketches, and the topic of texts without words.
TOPICS, ROUNDS, NONE = 8, 6, "(none)"


def sketch(text: str | None) -> np.ndarray | None:
    """64 small integers: the text's distinct words as sums of signs of their hashes, scaled to length 127; None without words."""
    words = set((text or "").lower().split())
    if not words:
        return None
    hashed = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    total = 2 * np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) - len(hashed)
    return _scaled(total)


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.rint(127 * x / max(1e-9, np.sqrt((x.astype(float) ** 2).sum()))).astype(np.int8)


def nearest(sketches: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the centre of greatest product; in integers, so that every task finds the same. Ties go to the first."""
    return (sketches.astype(np.int64) @ centres.astype(np.int64).T).argmax(1)


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of texts that have words, and their rows."""
    found = [sketch(t) for t in column.to_pylist()]
    rows = np.array([i for i, x in enumerate(found) if x is not None], np.int64)
    return np.array([found[i] for i in rows.tolist()], np.int8).reshape(-1, 64), rows


def _named(x: np.ndarray, rows: np.ndarray, n: int, centres: np.ndarray) -> pa.Array:
    names = np.full(n, NONE, object)
    if len(rows) and len(centres):
        names[rows] = [f"t{k}" for k in nearest(x, centres).tolist()]
    return pa.array(names.tolist(), pa.string())


def learn_topics(table: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> np.ndarray:
    """Integer centres of k-means over all sketches; table is (u, sketch as binary). The first centres are the texts of least u.

    A round brings one row for each centre and component to the driver: sums of integers, so the
    order of tasks changes nothing.
    """
    some = table.where("sketch is not null")
    first = some.select("u", "sketch").distinct().orderBy("u", "sketch").limit(topics).collect()
    centres = np.array([np.frombuffer(r.sketch, np.int8) for r in first], np.int8).reshape(-1, 64)
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
    for _ in range(rounds if len(centres) else 0):
        now = centres

        def run(batches, now=now):
            total, n = np.zeros((len(now), 64), np.int64), np.zeros(len(now), np.int64)
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8).reshape(-1, 64)
                    k = nearest(x, now)
                    np.add.at(total, k, x)
                    n += np.bincount(k, minlength=len(now))
            if n.sum():
                yield common.batch({"k": np.arange(len(now), dtype=np.int32), "n": n, "total": list(total)}, schema)

        part = some.select("sketch").mapInArrow(common.lean(run), "k int, n long, total array<long>")
        sums = part.select("k", F.posexplode("total").alias("at", "x")).groupBy("k", "at").agg(F.sum("x").alias("x")).collect()
        total = np.zeros((len(now), 64), np.int64)
        for r in sums:
            total[r.k, r.at] = r.x
        centres = np.array([_scaled(t) if t.any() else c for t, c in zip(total, now)], np.int8)
        if (centres == now).all():
            break
    return centres


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> list[Column]:
    """gw_source, gw_lang, gw_topic (null where it is to be learned), gw_u (uniform in [0, 1) by seed, id and text)."""
    text = F.col(f"`{text_col}`").cast("string")
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL))
    u = F.pmod(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`").cast("string"), text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    topic = name(topic_col) if topic_col else F.lit(None).cast("string")
    return [name(source_col).alias("gw_source"), name(lang_col).alias("gw_lang"), topic.alias("gw_topic"), u.alias("gw_u")]


def described(docs: DataFrame, id_col: str, text_col: str, columns: list[Column], learned: bool, tokenizer: tuple[str, str] | None) -> DataFrame:
    """(c0, gw_source, gw_lang, gw_topic, gw_u, gw_tokens, sketch) of every row: tokens by the tokenizer (words without one), at least 1; a sketch where topics are learned."""
    common.ship(docs.sparkSession)
    frame = docs.select(F.col(f"`{id_col}`").alias("c0"), *columns, F.col(f"`{text_col}`").cast("string").alias("text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(batches):
        encoding = bpe.codec(*tokenizer).encoding if tokenizer else None
        for whole in batches:
            for b in common.slices(whole, "text"):
                texts = b.column(5).to_pylist()
                tokens = [len(encoding.encode_ordinary(t or "") if encoding else (t or "").encode().split()) for t in texts]
                sketches = [None if not learned or (x := sketch(t)) is None else x.tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.maximum(tokens, 1), pa.int64()), pa.array(sketches, pa.binary())], names=[*b.schema.names[:5], "gw_tokens", "sketch"])

    return frame.mapInArrow(common.lean(run), types + ", gw_tokens long, sketch binary")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Cell weights whose marginals are the targets (shares): tokens scaled dimension by dimension until nothing moves.

    Where targets contradict the zeros of the table it ends after rounds at the last dimension's fit.
    """
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        before = w
        for code, target in zip(codes, targets):
            have = np.bincount(code, w, len(target))
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if np.abs(w - before).max(initial=0.0) < tolerance:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, keep: float) -> np.ndarray:
    """min(1, scale * weight / token share) per cell, scaled so that keep of all tokens is expected."""
    share = tokens / max(tokens.sum(), 1e-300)
    rate = np.divide(weights, share, out=np.zeros_like(share), where=share > 0)
    reach = share[rate > 0].sum()
    if keep >= reach:
        return (rate > 0).astype(float)
    lo, hi = 0.0, 1.0
    while (share * np.minimum(1, hi * rate)).sum() < keep:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.minimum(1, mid * rate)).sum() < keep else (lo, mid)
    return np.minimum(1, hi * rate)


def plan(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, power: float = POWER) -> DataFrame:
    """(source, lang, topic, weight, probability) per cell of described rows.

    targets gives shares by dimension and name; names it leaves out, and dimensions it leaves
    out, take their natural share to the power. The driver holds the cells while they and the
    categories are within CELLS and LIMITS; else they are raked as tables.
    """
    table = common.written(rows.groupBy(*[F.col(f"gw_{d}").alias(d) for d in LIMITS]).agg(F.sum("gw_tokens").alias("n")), "cells")
    sizes = table.agg(F.count("*").alias("cells"), *[F.count_distinct(d).alias(d) for d in LIMITS]).first()
    if sizes.cells > CELLS or any(sizes[d] > most for d, most in LIMITS.items()):
        return table_probabilities(rake_tables(table, {d: table_targets(table, d, (targets or {}).get(d, {}), power) for d in LIMITS}), keep)
    cells = table.orderBy(*LIMITS).collect()
    n = np.array([r.n for r in cells], float)
    codes, wanted = [], []
    for d in LIMITS:
        names = sorted({r[d] for r in cells})
        place = {x: i for i, x in enumerate(names)}
        code = np.array([place[r[d]] for r in cells], np.int64)
        natural = np.bincount(code, n, len(names)) ** power if len(names) else np.zeros(0)
        share = natural / max(natural.sum(), 1e-300)
        given = (targets or {}).get(d, {})
        fixed = np.array([x in given for x in names], bool)
        share = np.array([given.get(x, 0.0) for x in names]) + np.where(fixed, 0, share / max(share[~fixed].sum(), 1e-300) * max(0.0, 1 - sum(given.get(x, 0.0) for x in names)))
        codes.append(code)
        wanted.append(share / max(share.sum(), 1e-300))
    w = rake(n, codes, wanted)
    p = probabilities(n, w, keep)
    return rows.sparkSession.createDataFrame([(*[r[d] for d in LIMITS], float(a), float(b)) for r, a, b in zip(cells, w, p)], "source string, lang string, topic string, weight double, probability double")


small = common.small


def table_targets(cells: DataFrame, d: str, given: dict[str, float], power: float) -> DataFrame:
    """(d, target): the shares of all categories of a dimension, as in plan()."""
    fixed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, given double")
    names = cells.groupBy(d).agg(F.sum("n").cast("double").alias("n")).join(fixed, d, "left").withColumn("free", F.when(F.col("given").isNull(), F.pow("n", F.lit(power))).otherwise(0.0))
    names = common.written(names, "categories")
    free, told = (x or 0.0 for x in names.agg(F.sum("free"), F.sum("given")).first())
    rest = max(0.0, 1 - told)
    total = told + (rest if free else 0.0)
    return names.select(d, ((F.coalesce("given", F.lit(0.0)) + F.col("free") * (rest / max(free, 1e-300))) / max(total, 1e-300)).alias("target"))


def rake_tables(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """(source, lang, topic, n, weight): rake() with the cells and marginals of each step as tables of the shared folder."""
    total = float(cells.agg(F.sum("n")).first()[0])
    now = common.written(cells.withColumn("weight", F.col("n") / F.lit(total)).withColumn("before", F.col("weight")), "raked")
    for _ in range(rounds):
        for d, target in targets.items():
            have = now.groupBy(d).agg(F.sum("weight").alias("have"))
            factor = common.written(have.join(target, d).select(d, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("factor")), "factors")
            after = now.join(small(factor), d).select(*LIMITS, "n", (F.col("weight") * F.col("factor")).alias("weight"), "before")
            last, now = now, common.written(after, "raked")
            common.remove(last)
            common.remove(factor)
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        if moved < tolerance:
            break
        now = now.withColumn("before", F.col("weight"))
    return now.select(*LIMITS, "n", "weight")


def table_probabilities(raked: DataFrame, keep: float, steps: int = 64) -> DataFrame:
    """(source, lang, topic, weight, probability): probabilities() of a table, with steps scales tried at once."""
    total = float(raked.agg(F.sum("n")).first()[0])
    share = F.col("n") / F.lit(total)
    rate = F.col("weight") / share
    reach = raked.agg(F.sum(F.when(F.col("weight") > 0, share))).first()[0] or 0.0
    if keep >= reach:
        return raked.select(*LIMITS, "weight", (F.col("weight") > 0).cast("double").alias("probability"))
    expected = lambda scales: raked.agg(*[F.sum(share * F.least(F.lit(1.0), F.lit(float(x)) * rate)) for x in scales]).first()
    lo, hi = 0.0, 1.0
    while max(found := expected([hi * 2**k for k in range(steps)])) < keep:
        lo, hi = hi * 2 ** (steps - 1), hi * 2**steps
    hi *= 2 ** next(k for k, x in enumerate(found) if x >= keep)
    for _ in range(8):
        scales = np.linspace(lo, hi, steps + 1)[1:]
        at = next((k for k, x in enumerate(expected(scales)) if x >= keep), steps - 1)
        lo, hi = scales[at - 1] if at else lo, scales[at]
    return raked.select(*LIMITS, "weight", F.least(F.lit(1.0), F.lit(float(hi)) * rate).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, keep_columns: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, source, lang, topic, tokens, weight, probability, sampled.

    With keep_columns instead the columns of docs as struct ``row``, and ``sampled``. weight is the
    cell's raked share of all tokens, probability its documents' chance, sampled the draw, which
    depends on seed, id and text only: repeated rows are drawn alike. tokenizer (rank file, pattern)
    counts tokens, words are counted without one. Topics come from topic_col, or are learned from
    whole texts. Nulls form the category ``(null)``, texts without words the topic ``(none)``; null
    and empty texts count as one token. Empty tables give no rows; docs may have columns of any name.
    """
    columns = _columns(docs, id_col, text_col, source_col, lang_col, topic_col)
    with common.scratch(docs.sparkSession):
        table = common.written(described(docs, id_col, text_col, columns, topic_col is None, tokenizer), "described")
        centres = learn_topics(table.select(F.col("gw_u").alias("u"), "sketch")) if topic_col is None else np.zeros((0, 64), np.int8)

        def known(batches):
            for b in batches:
                kept = b.column(6).to_pylist()
                rows = np.array([i for i, x in enumerate(kept) if x is not None], np.int64)
                x = np.frombuffer(b"".join(kept[i] for i in rows.tolist()), np.int8).reshape(-1, 64)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _named(x, rows, b.num_rows, centres), *b.columns[4:6]], names=[*b.schema.names[:3], "gw_topic", *b.schema.names[4:6]])

        if topic_col is None:
            types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[:6])
            narrow = table.mapInArrow(common.lean(known), types)
        else:
            narrow = table.drop("sketch")
        narrow = common.written(narrow, "narrow")
        if not keep_columns:
            common.keep(narrow)
        chances = common.keep(common.written(plan(narrow, targets, keep), "chances"))
    sampled = F.coalesce(F.col("gw_u") < F.col("probability"), F.lit(False)).alias("sampled")
    if not keep_columns:
        rows = narrow.withColumnsRenamed({f"gw_{d}": d for d in LIMITS}).join(small(chances), list(LIMITS), "left")
        return rows.select(F.col("c0").alias(id_col), *LIMITS, F.col("gw_tokens").alias("tokens"), "weight", "probability", sampled)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    frame = docs.select(*own, *columns)
    if topic_col is None:
        at, to = docs.columns.index(text_col), len(own) + 2

        def named(batches):
            for whole in batches:
                for b in common.slices(whole, f"c{at}"):
                    yield b.set_column(to, "gw_topic", _named(*_sketches(b.column(at)), b.num_rows, centres))

        frame = frame.withColumn(f"c{at}", F.col(f"c{at}").cast("string")).mapInArrow(common.lean(named), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields))
    rows = frame.withColumnsRenamed({f"gw_{d}": d for d in LIMITS}).join(small(chances), list(LIMITS), "left")
    return rows.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row"), sampled)
