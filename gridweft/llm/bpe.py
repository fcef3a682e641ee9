"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

encode(a + b) is made from encode(a) and encode(b): only a window around the cut is encoded
again. Between texts the window reaches to the nearest places where a non-blank character is
followed by a space or line end: no match of the pattern spans such a place and none looks past it, so what
lies outside is stable. Within one long match the window grows by tokens until the pairs at both
of its ends are stable (a sequence of tokens is the encoding exactly when each neighbouring pair
encodes to itself).
"""

from __future__ import annotations

import base64
import hashlib
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of a text, and bytes of a single match, that are encoded in one call at a leaf.
LEAF, PIECE = 1 << 10, 128
_CUT = regex.compile(r"[^\s\x1c-\x1f](?=[ \n])")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece: int = PIECE):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.pattern, self.leaf, self.piece = regex.compile(pattern), leaf, piece
        self.long = regex.compile(rf"\S{{{piece},}}")

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._leaf(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def _leaf(self, text: str) -> list[int]:
        if not self.long.search(text):
            return self.encoding.encode_ordinary(text)
        return list(chain.from_iterable(self.encode_match(m.encode()) for m in self.pattern.findall(text)))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The encoding of left + right from those of both parts."""
        width = 64
        while True:  # the last place before the cut
            at = max(0, len(left) - width)
            found = [m.end() + at for m in _CUT.finditer(left[at:])]
            if found or not at:
                start = found[-1] if found else 0
                break
            width *= 2
        width = 64
        while True:  # the first place after it
            m = _CUT.search(right[:width])
            if m or width >= len(right):
                end = m.end() if m else len(right)
                break
            width *= 2
        drop, k = len(left[start:].encode()), len(a)
        while drop > 0:
            k -= 1
            drop -= len(self.bytes[a[k]])
        skip, j = len(right[:end].encode()), 0
        while skip > 0:
            skip -= len(self.bytes[b[j]])
            j += 1
        if drop or skip:  # not reached: a token never spans a stable place
            return self._leaf(left + right)
        window = left[start:] + right[:end]
        return a[:k] + self._leaf(window) + b[j:]

    def encode_match(self, piece: bytes) -> list[int]:
        """Merge one match of the pattern, which is a token if the ranks have it whole."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece:
            return self.encoding._encode_single_piece(piece)
        mid = len(piece) // 2
        return self.join_tokens(self._merge(piece[:mid]), self._merge(piece[mid:]))

    def _stable(self, x: int, y: int) -> bool:
        both = self.bytes[x] + self.bytes[y]
        return both not in self.ranks and self.encoding._encode_single_piece(both) == [x, y]

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """Join two parts of one match: re-encode a window of tokens that grows until its ends are stable."""
        i, j = 1, 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            data = b"".join(map(self.bytes.__getitem__, a[len(a) - i :] + b[:j]))
            window = self._window(data)
            left = i == len(a) or self._stable(a[len(a) - i - 1], window[0])
            right = j == len(b) or self._stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else i * 2, j if right else j * 2

    def _window(self, data: bytes) -> list[int]:
        return self.encoding._encode_single_piece(data)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file; kept for its later tasks."""
    kept = sys.__dict__.setdefault("_gridweft_codecs", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]): every whole text encoded, and its ids decoded again.

    Null counts as the empty text, which has no token. Rows are independent: repeated rows, ties
    and null ids give a row each; texts of any length are encoded whole, an empty table gives no rows;
    other columns, whatever they are called, are not read. with_ids adds the ids themselves.
    """
    common.ship(docs.sparkSession)
    fields = [("id", pa.int64()), ("n", pa.int64()), ("ids_sha", pa.string()), ("decoded_sha", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in common.slices(whole, "text"):
                n, ids_sha, decoded_sha, kept = [], [], [], []
                for t in b.column(1):
                    ids = c.encode(t.as_py() or "")
                    packed = np.array(ids, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(packed.view(np.int32))
                lists = {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(kept)))} if with_ids else {}
                yield common.batch({"id": b.column(0), "n": n, "ids_sha": ids_sha, "decoded_sha": decoded_sha} | lists, schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.lean(run), "id long, n long, ids_sha string, decoded_sha string" + ", ids array<int>" * with_ids)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("ids_sha").alias("ids_sha256"), F.col("decoded_sha").alias("decoded_sha256"), *["ids"] * with_ids)
