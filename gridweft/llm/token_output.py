"""Token ids as binary files: Arrow IPC files of fixed-size-list batches.

A shard holds the ids of a range of documents in order, cut into sequences of equal length with
masks, so that any sequence is a slice of a mapped buffer; an index file beside it has each
document's place. Shards are written under a temporary name and renamed, so a repeated task
leaves the same files.
"""

from __future__ import annotations

import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Ids of a sequence, sequences of a batch, the id after each document, entries of a worker's word cache.
LENGTH, BATCH, END, CACHE = 1024, 256, 1, 400_000
_SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_ODD = re.compile(r"[\x1c-\x1f]")


class Encoder:
    """Ids of a lower-casing word-level BPE tokenizer of the tokenizers library.

    White space never enters a token, so blank-separated chunks encode on their own and are
    cached. Chunks of ASCII and Latin-1 letters without apostrophes are cut into the pattern's
    matches here and only merged by the library; all others go through its whole ``encode``.
    A text that may hold an added token of the file ("<|endoftext|>") goes through the library as a
    whole, which gives it that token's id; with special_as_text such strings are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"].get("pretokenizers", [{}])
        # the shortcut holds for exactly this arrangement
        self.known = [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = self.words[word] = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], self.dtype).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        if self.known and _SIMPLE.fullmatch(chunk):
            return b"".join(map(self._word, _PARTS.findall(chunk.lower())))
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian integers of self.dtype."""
        if not self.known or _ODD.search(text) or (self.added and self.added.search(text)):
            return self._whole(text)
        chunks, cache = text.split(), self.chunks
        for c in set(chunks).difference(cache):
            cache[c] = self._chunk(c)
        out = b"".join(map(cache.__getitem__, chunks))
        if len(cache) > CACHE:
            cache.clear()
        return out


def encoder(path: str) -> Encoder:
    kept = sys.__dict__.setdefault("_gridweft_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def replace_file(fs: pa.fs.FileSystem, temp: str, path: str) -> None:
    """Rename over what an earlier attempt left, also where a rename may not overwrite."""
    if not isinstance(fs, pa.fs.LocalFileSystem) and fs.get_file_info(path).type != pa.fs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(temp, path)


class ShardWriter:
    """Packs ids into sequences of equal length and writes them batch by batch."""

    def __init__(self, path: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.path = file_system(path)
        self.temp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.dtype, self.length, self.size, self.kind = dtype, length, length * batch, kind
        self.held, self.n, self.tokens = [], 0, 0
        self.docs: list[tuple] = []
        self.out = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.out, self.schema)

    def add(self, doc_id: int | None, data: bytes) -> None:
        ids = np.frombuffer(data, self.dtype)
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)
        if self.n >= self.size:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        end = -(-len(ids) // self.length) * self.length if last else len(ids) // self.size * self.size
        mask = np.arange(end) < len(ids)
        padded, rest = np.concatenate([ids, np.zeros(max(0, end - len(ids)), self.dtype)])[:end], ids[end:]
        for at in range(0, end, self.size):
            part, m = padded[at : at + self.size], mask[at : at + self.size]
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(m), self.length)], schema=self.schema))
        self.held, self.n = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        replace_file(self.fs, self.temp, self.path)
        table = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "start": pa.array([d[1] for d in self.docs], pa.int64()), "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(self.temp) as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        replace_file(self.fs, self.temp, self.path + ".docs")


class Shard:
    """Random access to a written shard. Local files are mapped, and sequences are views of the mapping."""

    def __init__(self, path: str):
        fs, p = file_system(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p))
        with fs.open_input_file(p + ".docs") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i: only its batch is touched, the ids are not copied."""
        b = self.reader.get_batch(i // self.rows)
        at = i % self.rows
        ids = b.column(0).flatten().to_numpy(zero_copy_only=True)[at * self.length : (at + 1) * self.length]
        return ids, np.asarray(b.column(1).slice(at, 1).flatten())

    def runs(self):
        """(doc_id, start, ids as 32-bit integers in parts) of each document, read batch by batch."""
        batches = (self.reader.get_batch(i).column(0).flatten().to_numpy() for i in range(self.reader.num_record_batches))
        have, at = np.zeros(0, np.uint32), 0
        for doc, start, n in zip(*(c.to_pylist() for c in self.docs.columns)):
            parts = []
            while n:
                if at == len(have):
                    have, at = next(batches), 0
                take = min(n, len(have) - at)
                parts.append(have[at : at + take].astype("<u4"))
                at += take
                n -= take
            yield doc, start, parts


def write(docs: DataFrame, tokenizer: str, directory: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[tuple[int, int, int]]]:
    """Encode every whole text, append the end id, write shards in ascending id order.

    Returns the folder and a row (shard, ids before it, documents) for each shard that has
    documents: at most as many as shuffle partitions. Null texts count as empty; null ids come
    first; rows of one id are ordered by their text's hash. Shards are range partitions of the id.
    Texts of any length are encoded whole; an empty table leaves a manifest without shards. Only the
    two columns are read, whatever else docs has.
    """
    spark = docs.sparkSession
    common.ship(spark)
    directory = directory or common.new_path(spark, "tokens")
    fs, path = file_system(directory)
    fs.create_dir(path)
    schema = pa.schema([("shard", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int64())])
    tail = end

    def run(batches):
        e, w, shard = encoder(tokenizer), None, TaskContext.get().partitionId()
        last = np.array([tail], e.dtype).tobytes()
        for whole in batches:
            for b in common.slices(whole, "text"):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    w = w or ShardWriter(f"{directory}/shard-{shard:06d}.arrow", e.dtype, length)
                    w.add(doc, e.encode(text.as_py() or "") + last)
        if w:
            w.close()
            yield common.batch({"shard": [shard], "tokens": [w.tokens], "docs": [len(w.docs)]}, schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text"))
    found = sorted(tuple(r) for r in placed.mapInArrow(common.lean(run), "shard long, tokens long, docs long").collect())
    out, before = [], 0
    for shard, tokens, n in found:
        out.append((shard, before, n))
        before += tokens
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"length": length, "end": end, "shards": [{"shard": s, "start": b, "docs": n} for s, b, n in out], "tokens": before}).encode())
    return directory, out


def read(spark: SparkSession, directory: str, shards: list[tuple[int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files alone."""
    common.ship(spark)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: dict[str, list] = {n: [] for n in schema.names}
                for doc, start, parts in Shard(f"{directory}/shard-{shard:06d}.arrow").runs():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.tobytes(), crc)
                    for n, v in zip(schema.names, (doc, base + start, sum(map(len, parts)), crc)):
                        rows[n].append(v)
                yield common.batch(rows, schema)

    listed = spark.createDataFrame([s[:2] for s in shards], "shard long, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(common.lean(run), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
