"""Quality classifier by Bradley-Terry pairwise ranking.

Documents get features from their whole text. A weight vector is learned from all preference pairs
(every document of label 1 against every one of label 0) by logistic loss on the feature differences;
the share of label 0 gives the score quantile that separates both predictions.

The pairs aren't listed. The loss of a pair is an analytic function of the difference of two
scores, so within a bin of scores it is a polynomial to about 1e-10, and sums of Chebyshev
polynomials over the documents of each bin and label give its sums over all pairs, with the
gradient and the curvature. Sums are of integers: the order of rows and tasks doesn't change them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import fold

#: Width of a bin of scores, and Chebyshev polynomials in it.
WIDTH, TERMS = 2.0, 12
_ROOTS = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
#: (j, k): what the value at root k adds to the coefficient of polynomial j.
_TO = np.cos(np.arange(TERMS)[:, None] * np.arccos(_ROOTS)) * np.where(np.arange(TERMS) > 0, 2, 1)[:, None] / TERMS
#: Newton steps at most, roots compared at once on the driver, and tasks whose sums the driver adds up itself.
STEPS, ROOTS, TASKS = 100, 1024, 64
#: Labelled rows that the driver passes over itself, with the same sums to the last bit.
HERE = 20_000
FEATURES = (
    "log_chars", "log_words", "mean_word", "std_word", "long_words", "short_words", "letters", "upper", "digits", "blanks", "marks", "ends", "symbols",
    "bars", "bangs", "other_marks", "distinct_words", "top_word", "upper_words", "marked_words", "lines", "mean_line", "repeated_lines", "repeated_line_chars", "distinct_bigrams", "capital_starts", "alpha_words", "vowels", "bytes_per_char", "max_word",
)
_CLASS = np.zeros(128, np.uint8)
for _c in range(128):
    _x = chr(_c)
    _CLASS[_c] = 1 if _x.islower() else 2 if _x.isupper() else 3 if _x.isdigit() else 4 if _x.isspace() else 5 if _x in ".,;:'\"()-?" else 6 if _x == "|" else 7 if _x == "!" else 8 if _c > 32 else 0
_VOWELS = np.isin(np.arange(128), [ord(c) for c in "aeiouyAEIOUY"])


def features(text: str | None) -> np.ndarray:
    """The FEATURES of a whole text; zeros when it is null or blank."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, low = len(points), points[points < 128]
    kinds = np.bincount(_CLASS[low], minlength=9).astype(float)
    other = n - len(low)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    w = len(words)
    hashed = np.fromiter((hash_word(x) for x in words), np.uint32, w)
    _, counts = np.unique(hashed, return_counts=True)
    pairs = np.unique(hashed[1:].astype(np.uint64) << np.uint64(32) | hashed[:-1]) if w > 1 else hashed
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    again = len(lines) - len(set(lines))
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:?)'\"" for x in words)
    out[:] = (
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), (sizes > 12).mean(), (sizes < 3).mean(), (kinds[1] + kinds[2] + other) / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        text.count(".") / w, kinds[8] / n, kinds[6] / n, kinds[7] / n, other / n, len(counts) / w, counts.max() / w, sum(x.isupper() and len(x) > 1 for x in words) / w, marked / w,
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), again / max(1, len(lines)), 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines))), len(pairs) / max(1, w - 1), sum(x[0].isupper() for x in words) / w, sum(x.isalpha() for x in words) / w,
        _VOWELS[low].sum() / n, len(text.encode("utf-8", "surrogatepass")) / n, np.log1p(sizes.max()),
    )
    return out


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / std, -8, 8)


def weigh(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w in one order of additions, whatever the number of rows."""
    out = np.zeros(len(z))
    for k in range(len(w)):
        out += z[:, k] * w[k]
    return out


class Ranker:
    """Weights over standardised features, the threshold score and the scale that maps scores to 0..1."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, weights: np.ndarray, threshold: float, scale: float):
        self.mean, self.std, self.weights, self.threshold, self.scale = mean, std, weights, threshold, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return weigh(standard(x, self.mean, self.std), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -500, 500)))


def merged(parts, merge) -> dict[int, np.ndarray]:
    out = {}
    for key, v in parts:
        out[key] = merge(out[key], v) if key in out else v
    return out


def by_key(keys: np.ndarray, values: np.ndarray) -> dict[int, np.ndarray]:
    """The sums of the rows of values by key."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return dict(zip(found.tolist(), np.add.reduceat(values[order], starts, axis=0))) if len(found) else {}


def local(x: np.ndarray, y: np.ndarray, rows: int = 1000):
    """total(step, merge): what step(x, y) gives by key, merged over blocks of rows in memory."""

    def total(step, merge=np.add):
        return merged((p for at in range(0, len(x), rows) for p in step(x[at : at + rows], y[at : at + rows]).items()), merge)

    return total


def spread(rows: DataFrame, tasks: int = TASKS):
    """local() over a table (y int, x array<double>): one pass of all its rows for each call."""
    schema = pa.schema([("key", pa.int64()), ("v", pa.binary())])
    parts = rows.rdd.getNumPartitions()

    def total(step, merge=np.add):
        kind = np.int64 if merge is np.add else np.float64
        told = lambda found: common.batch({"key": list(found), "v": [v.tobytes() for v in found.values()]}, schema)
        listed = lambda batches: ((k, np.frombuffer(v, kind)) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

        def run(batches):
            blocks = ((np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), np.asarray(b.column(0))) for b in batches if b.num_rows)
            yield told(merged(((k, v.ravel()) for x, y in blocks for k, v in step(x, y).items()), merge))

        def again(batches):
            yield told(merged(listed(batches), merge))

        out = rows.mapInArrow(common.lean(run), "key long, v binary")
        if parts > tasks:
            out = out.repartition(tasks, "key").mapInArrow(common.lean(again), "key long, v binary")
        return merged(listed(out.toArrow().to_batches()), merge)

    return total


def ranged(x, y):
    return {0: np.concatenate([-x, x], 1).max(0)}


def counted(x, y):
    return {0: np.array([(y == 0).sum(), (y == 1).sum()], np.int64)}


def binned(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each score and the Chebyshev polynomials of its place there."""
    b = np.floor(s / WIDTH)
    t = 2 * (s / WIDTH - b) - 1
    out = np.ones((len(s), TERMS))
    out[:, 1] = t
    for j in range(2, TERMS):
        out[:, j] = 2 * t * out[:, j - 1] - out[:, j - 2]
    return b.astype(np.int64), out


def ordered(s: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores."""
    i = (s + 0.0).view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


class Pairs:
    """Loss, gradient and curvature of all pairs at weights w, but for the curvature's part of single rows."""

    def __init__(self, found: dict[int, np.ndarray], n: list[int], unit: float, w: np.ndarray, ridge: float):
        self.w, self.bins, self.at, sums = w, [], [], []
        for label in (0, 1):
            keys = sorted(k for k in found if k & 1 == label)
            self.bins.append([k >> 1 for k in keys])
            m = np.array([found[k] for k in keys], np.float64).reshape(len(keys), TERMS, -1) / unit / n[label]
            sums.append(np.einsum("jk,bjf->bkf", _TO, m).reshape(len(keys) * TERMS, -1))
            self.at.append((WIDTH * (np.array(self.bins[-1])[:, None] + (_ROOTS + 1) / 2)).ravel())
        (w0, v0), (w1, v1) = [(m[:, 0], m[:, 1:]) for m in sums]
        share = np.array(n) / sum(n)
        mean = sum(share[k] * (m[:, 0] @ self.at[k]) for k, m in enumerate(sums))
        self.deviation = float(np.sqrt(max(0.0, sum(share[k] * (m[:, 0] @ (self.at[k] - mean) ** 2) for k, m in enumerate(sums)))))
        self.loss, self.gradient, self.cross = ridge / 2 * (w @ w), ridge * w, np.zeros((len(w),) * 2)
        wrong, bend = np.zeros(len(w0)), [np.zeros(len(w0)), np.zeros(len(w1))]
        for lo in range(0, len(w1), ROOTS):
            c = slice(lo, lo + ROOTS)
            d = self.at[1][c, None] - self.at[0]
            p = 1 / (1 + np.exp(np.clip(d, -500, 500)))
            q = p * (1 - p)
            self.loss += w1[c] @ np.logaddexp(0, -d) @ w0
            self.gradient = self.gradient - v1[c].T @ (p @ w0)
            wrong += w1[c] @ p
            bend[0] += w1[c] @ q
            bend[1][c] = q @ w0
            self.cross += v1[c].T @ (q @ v0)
        self.gradient = self.gradient + v0.T @ wrong
        #: by label and bin, the coefficients of the curvature of a row's pairs
        self.bend = [dict(zip(self.bins[k], bend[k].reshape(-1, TERMS) @ _TO.T)) for k in (0, 1)]


def solve(total, n_features: int, ridge: float) -> Ranker:
    """The ranker of all pairs of the rows that total() passes over. Without both labels no pair exists: every score is then 0.5."""
    n = total(counted).get(0, np.zeros(2, np.int64)).tolist()
    if not n[0] or not n[1]:
        return Ranker(np.zeros(n_features), np.ones(n_features), np.zeros(n_features), 0.0, 1.0)
    rows = sum(n)
    ends = total(ranged, np.maximum)[0]
    low, width = -ends[:n_features], ends[:n_features] + ends[n_features:]
    width = np.where(width > 0, width, 1.0)
    #: what sums of values up to 1 are multiplied with so that all rows fit 63 bits
    unit = 2.0 ** (61 - rows.bit_length())

    def squares(x, y):
        u = (x - low) / width
        return {0: np.rint(np.concatenate([u, u * u], 1) * unit).astype(np.int64).sum(0)}

    sums = [int(v) for v in total(squares)[0]]
    one, two = sums[:n_features], sums[n_features:]
    mean = low + width * np.array([v / rows / unit for v in one])
    std = width * np.sqrt([max(0, rows * int(unit) * b - a * a) / (rows * int(unit)) ** 2 for a, b in zip(one, two)])
    std[std < 1e-9] = 1
    unit /= 8

    def pairs(w):
        def step(x, y):
            z = standard(x, mean, std)
            b, t = binned(weigh(z, w))
            z = np.concatenate([np.ones((len(z), 1)), z], 1)
            return by_key(2 * b + y, np.rint(t[:, :, None] * z[:, None] * unit).astype(np.int64).reshape(len(z), -1))

        return Pairs(total(step), n, unit, w, ridge)

    def curvature(now):
        bend, w, of = now.bend, now.w, unit / 8
        upper = np.triu_indices(n_features)

        def step(x, y):
            z = standard(x, mean, std)
            b, t = binned(weigh(z, w))
            g = (t * np.array([bend[k][i] for k, i in zip(y.tolist(), b.tolist())])).sum(1)
            return by_key(y, np.rint(z[:, upper[0]] * z[:, upper[1]] * g[:, None] * of).astype(np.int64))

        out = np.zeros((n_features,) * 2)
        for k, v in total(step).items():
            out[upper] += v / of / n[k]
        out = out + np.triu(out, 1).T
        return out - now.cross - now.cross.T + ridge * np.eye(n_features)

    now = pairs(np.zeros(n_features))
    for _ in range(STEPS):
        step = -np.linalg.solve(curvature(now), now.gradient)
        gain, share = -now.gradient @ step, 1.0
        after = pairs(now.w + step)
        while gain > 1e-10 and after.loss > now.loss - 1e-4 * share * gain and share > 1e-6:
            share /= 2
            after = pairs(now.w + share * step)
        now = after
        if gain <= 1e-10:
            break
    w = now.w
    # the quantile at the share of label 0, between the neighbouring scores on both sides
    rank, prefix, below = n[0] - 1, None, 0
    for shift in (48, 32, 16, 0):

        def digits(x, y):
            i = ordered(weigh(standard(x, mean, std), w))
            i = i[i >> (shift + 16) == prefix] if prefix is not None else i
            return by_key(i >> shift, np.ones((len(i), 1), np.int64))

        for prefix, (count,) in sorted(total(digits).items()):
            if below + count > rank:
                break
            below += count

    def bounds(x, y):
        s = weigh(standard(x, mean, std), w)
        i = ordered(s)
        return {0: np.array([s[i <= prefix].max(initial=-np.inf), -s[i > prefix].min(initial=np.inf)])}

    last, after = total(bounds, np.maximum)[0] * (1, -1)
    threshold = (last + (after if below + count == rank + 1 and np.isfinite(after) else last)) / 2
    return Ranker(mean, std, w, float(threshold), float(max(now.deviation, 1e-6) / 2))


def fit(x: np.ndarray, y: np.ndarray, pairs: int | None = None, ridge: float = 1e-4) -> Ranker:
    """Learn from all pairs of rows x with labels y. pairs, once a number of pairs to draw, has no effect."""
    n = x.shape[1] if x.ndim == 2 else len(FEATURES)
    return solve(local(x, np.asarray(y).astype(np.int64)), n, ridge)


def featurised(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    common.ship(docs.sparkSession)
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("read"))
    types = ", ".join(f"c{i} {frame.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "read"):
                x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "x"])

    return frame.mapInArrow(common.lean(run), f"{types}, x array<double>")


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row."""
    return featurised(docs, [id_col], text_col).withColumnRenamed("c0", "id")


def learned(found: DataFrame, labels: DataFrame, id_col: str, label_col: str, modulus: int, held_out: int) -> Ranker:
    """See learn(); found is as read() has it."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("id"), modulus) != held_out))
    with common.scratch(found.sparkSession):
        rows = common.written(found.join(common.small(usable), "id").select(F.col("y").cast("long").alias("y"), "x"), "labelled")
        if rows.count() > HERE:
            return solve(spread(rows), len(FEATURES), 1e-4)
        here = rows.toArrow()
        x = np.asarray(here.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
        return fit(x, np.asarray(here.column("y")))


def scored(found: DataFrame, ranker: Ranker, id_col: str) -> DataFrame:
    """See score(); found is as read() has it."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield common.batch({"id": b.column(0), "score": ranker.score(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1))}, schema)

    out = found.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(common.lean(run), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held_out: int = 1) -> Ranker:
    """Fit on all labelled documents outside the held-out fold and on all pairs of them.

    Null ids and labels other than 0 and 1 are not used; a document with several labels counts
    with each. The ranking reads the labels only.
    """
    return learned(read(docs, id_col, text_col), labels, id_col, label_col, modulus, held_out)


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted): score from 0 to 1 by the whole text alone, predicted 1 from 0.5 on.

    Null and empty texts have the features of an empty text. Repeated rows and null ids give a
    row each and equal texts equal scores; texts of any length are read whole, an empty table gives
    no rows; other columns, whatever they are called, are not read.
    """
    return scored(read(docs, id_col, text_col), ranker, id_col)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """score() by what learn() learns from the same documents, with the features of each text computed once."""
    found = common.written(read(docs, id_col, text_col), "features")
    return scored(found, learned(found, labels, id_col, label_col, modulus, held_out), id_col)
