"""Append streamed patches to a store, each patch once."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def append_patches(stream: DataFrame, store: Store, name: str, checkpoint: str, key: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Write a stream of patch rows to a store's patch table.

    Batches are written as parts of their own checkpoint and number, so a batch that is tried again
    replaces itself, and streams and save_patches() may append to one table; with key, rows seen before are dropped (give the stream a watermark to bound what is kept).
    """
    rows = stream.dropDuplicates(key) if key else stream

    def write(batch: DataFrame, number: int) -> None:
        store.save_patches(batch, name, f"s{zlib.crc32(checkpoint.encode()):08x}-{number}")

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()
