"""Language identification by cross-parsing entropy.

For every language a suffix automaton of bounded labelled text recognises exactly the substrings
of that text. A document is parsed greedily into the longest phrases each automaton knows; the
language that needs the fewest phrases for its characters wins. A phrase costs log2 of the
automaton's text length in bits, which also gives the score.

The parse is exact over texts of any length. Texts are walked in blocks side by side, each block
first as if a phrase began there; then every block is walked again from the state its predecessor
ends in, until it meets its own first walk (after a few characters as a rule), and what changed is
carried on. Small alphabets give dense tables, large ones sorted transitions.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the fit (predictions read whole texts): languages, those of most labelled documents; documents and characters of each, in pieces of PIECE characters or more from hashed places.
LANGS, DOCS, CHARS, PIECE = 200, 256, 24_000, 200
#: Characters of a block, of all texts walked at once, and entries up to which transitions are a dense table.
BLOCK, STEP, DENSE = 512, 500_000, 24_000_000
#: Rounds of corrections that are walked side by side; what is left then is walked one by one.
ROUNDS = 4
UNKNOWN = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case form, and whether it is a letter."""
    if "_gridweft_letters" not in sys.__dict__:
        lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            if unicodedata.category(c := chr(i))[0] == "L":
                letter[i] = True
                if len(low := c.lower()) == 1:
                    lower[i] = ord(low)
        sys._gridweft_letters = lower, letter
    return sys._gridweft_letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automata:
    """Suffix automata of several texts over one alphabet. Class 1 is any run of non-letters, 2 a letter that no text has."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE, block: int = BLOCK):
        lower, letter = _letters()
        self.langs, self.block = sorted(samples), block
        coded = [lower[_points(samples[x])] for x in self.langs]
        seen = np.unique(np.concatenate([c[letter[c]] for c in coded])) if coded else np.zeros(0, np.uint32)
        self.classes = np.ones(0x110000, np.int32)
        self.classes[letter] = 2
        self.classes[seen] = np.arange(len(seen)) + 3
        self.classes = self.classes[lower]
        self.width = w = len(seen) + 3
        edges, self.roots, self.bits, n = [], [], [], 0
        for x in self.langs:
            states = self._states(self.normal(_points(samples[x])).tolist())
            edges += [((n + i) * w + c, n + to) for i, s in enumerate(states) for c, to in s.items()]
            self.roots.append(n)
            self.bits.append(np.log2(max(2, len(samples[x]))))
            n += len(states)
        keys, targets = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)
        # a missing transition ends the phrase, and the next one starts with the same character; told as
        # -1 - state. No walk leads back to a root, so a root stands for no open phrase.
        self.first = np.repeat(np.array(self.roots, np.int32)[:, None], w, 1).reshape(-1, w)
        for k, r in enumerate(self.roots):
            own = keys // w == r
            self.first[k, keys[own] % w] = targets[own]
        self.first = -1 - self.first
        rooted = np.isin(keys // w, self.roots)
        keys, targets = keys[~rooted], targets[~rooted]
        if n * w <= dense:
            self.table = np.repeat(self.first, np.diff([*self.roots, n]), 0).ravel() if n else np.zeros(0, np.int32)
            self.table[keys] = targets
        else:
            order = np.argsort(keys)
            self.table, self.keys, self.targets = None, np.append(keys[order], np.iinfo(np.int64).max), np.append(targets[order], 0)

    def _next(self, lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one character of each lane; -1 - state where a phrase began with it."""
        if self.table is not None:
            return self.table.take(state * self.width + c)
        key = state.astype(np.int64) * self.width + c
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.targets[at], self.first[lang, c])

    @staticmethod
    def _states(text: list[int]) -> list[dict[int, int]]:
        """Transitions of the suffix automaton of text, by state."""
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        return nxt

    def normal(self, points: np.ndarray) -> np.ndarray:
        """Classes of the code points with runs of non-letters as one."""
        c = self.classes[points]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
        return c[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) numbers of phrases, the texts' numbers of letters, and their lengths as parsed."""
        counts, letters, lengths = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= STEP):
                chars += len(texts[to])
                to += 1
            counts[at:to], letters[at:to], lengths[at:to] = self._walk(texts[at:to])
            at = to
        return counts, letters, lengths

    def _walk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = [_points(t) for t in texts]
        sizes = np.array([len(p) for p in points])
        if not sizes.sum() or not self.langs:
            return np.zeros((len(texts), len(self.langs)), np.int64), np.array([int(_letters()[1][p].sum()) for p in points]), sizes
        flat = np.concatenate(points)
        owner = np.repeat(np.arange(len(texts)), sizes)
        c = self.classes[flat]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 1) | (c[:-1] != 1) | (owner[1:] != owner[:-1])
        letters = np.bincount(owner[c > 1], minlength=len(texts))
        c, owner = c[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        blocks = -(-sizes // self.block)
        who = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[who] + inner * self.block
        size = np.minimum(self.block, starts[who] + sizes[who] - begin)
        order = np.argsort(-size, kind="stable")
        place = np.argsort(order)
        before = np.where(inner > 0, place[np.arange(len(who)) - 1], -1)[order]
        begin, size, who = begin[order], size[order], who[order]
        n, langs = len(begin), len(self.langs)
        lang = np.arange(langs)[:, None]
        longest = int(size[0])
        states = np.zeros((longest, langs, n), np.int32)
        news = np.zeros((longest, langs, n), bool)
        state = np.tile(np.array(self.roots, np.int32)[:, None], (1, n))
        live = n - np.searchsorted(size[::-1], np.arange(1, longest + 1), side="left")
        for step in range(longest):
            m = int(live[step])
            got = self._next(lang, state[:, :m], c[begin[:m] + step])
            new = got < 0
            np.bitwise_xor(got, -1, out=got, where=new)  # -1 - x
            news[step, :, :m], states[step, :, :m], state[:, :m] = new, got, got
        self._carry(c, begin, size, before, states, news, state)
        counts = np.zeros((len(texts), langs), np.int64)
        np.add.at(counts, who, news.sum(0).T)
        return counts, letters, sizes

    def _carry(self, c, begin, size, before, states, news, end) -> None:
        """Walk blocks again from where their predecessors end, until nothing changes; states, news and end are mended in place."""
        used = np.tile(np.array(self.roots, np.int32)[:, None], (1, len(begin)))
        later = np.flatnonzero(before >= 0)
        for _ in range(ROUNDS):
            now = end[:, before[later]]
            lang, at = np.nonzero(now != used[:, later])
            if not len(lang):
                return
            s, b = now[lang, at], later[at]
            used[lang, b] = s
            for step in range(len(states)):
                ends = size[b] == step
                end[lang[ends], b[ends]] = s[ends]
                go = ~ends
                lang, b, s = lang[go], b[go], s[go]
                if not len(b):
                    break
                got = self._next(lang, s, c[begin[b] + step])
                new = got < 0
                got = np.where(new, -1 - got, got)
                go = got != states[step, lang, b]
                news[step, lang, b], states[step, lang, b] = new, got
                lang, b, s = lang[go], b[go], got[go]
            end[lang, b] = s
        for b in later[np.argsort(begin[later])].tolist():  # in the order of the text
            codes = c[begin[b] : begin[b] + size[b]].tolist()
            for k in np.flatnonzero(end[:, before[b]] != used[:, b]).tolist():
                s = used[k, b] = int(end[k, before[b]])
                own, one = states[: size[b], k, b].tolist(), np.array([k])
                for step, x in enumerate(codes):
                    got = int(self.table[s * self.width + x]) if self.table is not None else int(self._next(one, np.array([s]), np.array([x]))[0])
                    s = -1 - got if got < 0 else got
                    news[step, k, b], states[step, k, b] = got < 0, s
                    if s == own[step]:
                        break
                else:
                    end[k, b] = s

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrase length of each text: the least bits for its phrases, its share of exp2(-bits) over all languages, characters a phrase."""
        counts, letters, lengths = self.phrases([t or "" for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        cost = counts * np.array(self.bits)
        best = cost.argmin(1)
        share = 1 / np.exp2(np.maximum(cost.min(1)[:, None] - cost, -1000)).sum(1)
        some = letters > 0
        reach = lengths / np.maximum(1, counts[np.arange(len(best)), best])
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], np.where(some, share, 0.0).tolist(), np.where(some, reach, 0.0).tolist()


def fold(id_: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(modulus))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, docs_per_lang: int = DOCS, chars: int = CHARS, langs: int = LANGS) -> dict[str, str]:
    """At most chars characters of text of each language from at most docs_per_lang labelled documents outside the held-out fold.

    The languages are the langs ones of most such documents (ties by name); the documents are those of
    the smallest id hashes: the ranking reads ids and languages only and is cut in each task before
    its shuffle. Of each chosen document one piece from a hashed place is read, as long as its
    language needs to reach chars, and PIECE characters at least. An empty table gives no language.
    """
    usable = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("id"), modulus) != held_out))
    most = {r.lang: min(r.n, docs_per_lang) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()}
    if not most:
        return {}
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = usable.where(F.col("lang").isin(list(most))).withColumn("place", F.row_number().over(first)).where(F.col("place") <= docs_per_lang).select("id").distinct()
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n = chosen.count()
    found = text.join(F.broadcast(chosen) if n <= common.BROADCAST_ROWS else chosen, "id", "left_semi").where(F.col("text").isNotNull() & F.col("lang").isin(list(most)))
    length = F.create_map(*[F.lit(x) for k, v in most.items() for x in (k, max(PIECE, -(-chars // v)))])[F.col("lang")]
    start = F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(F.length("text") - length, F.lit(0)) + 1) + 1
    piece = F.col("text").substr(start.cast("int"), length)
    rows = found.select("lang", F.xxhash64("id").alias("h"), piece.alias("text")).distinct().orderBy("lang", "h", "text").collect()
    out: dict[str, str] = {}
    for r in rows:
        if len(out.get(r.lang, "")) < chars:
            out[r.lang] = (out.get(r.lang, "") + "\n" + r.text)[:chars]
    return out


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """(id_col, lang_pred, score, phrase_chars); with keep_columns instead of id_col all columns of docs as struct ``row``.

    Reads whole texts of any length. Null texts and texts without a letter are ``und`` with score 0;
    so is everything where no language was learned. phrase_chars is the mean length of the phrases
    the predicted language needs, runs of other characters counting as one (0 where it is ``und``):
    low where a text is in no learned language. Equal texts get equal results; ties go to the first
    language in order. Repeated rows and null ids give a row each, an empty table none; docs may
    have columns named as those of the result.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    taken = docs.columns if keep_columns else [id_col]
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(taken)]
    frame = docs.select(*cols, F.col(f"`{text_col}`").cast("string").alias("parsed"))
    types = ", ".join(f"c{i} {frame.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(taken)))

    def run(batches):
        kept = sys.__dict__.setdefault("_gridweft_automata", {})
        key = hash(tuple(sorted(shared.value.items())))
        if key not in kept:
            kept.clear()
            kept[key] = Automata(shared.value)
        a = kept[key]
        for whole in batches:
            for b in common.slices(whole, "parsed", 1_000_000):
                lang, score, reach = a.predict(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reach, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score", "phrase_chars"])

    out = frame.mapInArrow(common.lean(run), f"{types}, lang_pred string, score double, phrase_chars double")
    own = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(taken)]).alias("row") if keep_columns else F.col("c0").alias(id_col)
    return out.select(own, "lang_pred", "score", "phrase_chars")
