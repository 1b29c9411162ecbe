"""Packing: documents to token sequences of a fixed length by best-fit decreasing.

A document is cut into full windows and a rest as it is encoded. Pieces then go to shards by the hash of their
place, about ``SHARD_DOCUMENTS`` documents each; a shard places its pieces from the longest to the shortest, each
in the open window with the least room that fits, found in a segment tree over remaining room. Only the last
windows of a shard stay partly open, so padding does not depend on how many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwave.llm.common import slices
from cellwave.llm.tokens import BYTE_BPE, END_ID, encoder

WINDOW = 2048
SHARD_DOCUMENTS = 8192
SLICE_BYTES = 1 << 20


def cut_documents(
    documents: DataFrame, vocabulary: str = BYTE_BPE, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, ids`` of every row; ``ids`` are little-endian 32-bit ids.

    A null text is empty: one piece that holds the end id. All pieces but a document's last have ``window`` ids.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = tool.encode(batch.column(1).to_pylist())
            rows, starts, sizes, totals, ids = [], [], [], [], []
            for k, raw in enumerate(texts):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    part = raw[4 * start : 4 * (start + window)]
                    rows.append(k)
                    starts.append(start)
                    sizes.append(len(part) // 4)
                    totals.append(total)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (starts, sizes, totals)),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        pieces, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    )


class RoomTree:
    """Segment tree over remaining room: the least room of at least some size that an open window has."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int, there: bool) -> None:
        k, any_ = room + self.size, self.any
        any_[k] = there
        while k > 1:
            k //= 2
            now = any_[2 * k] or any_[2 * k + 1]
            if any_[k] == now:
                break
            any_[k] = now

    def add(self, room: int, window: int) -> None:
        if not self.open[room]:
            self._mark(room, True)
        self.open[room].append(window)

    def take(self, least: int) -> tuple[int, int] | None:
        """``(room, window)`` of the tightest open window with ``least`` room or more."""
        k, any_ = least + self.size, self.any
        while not any_[k]:
            while k & 1:  # a right child: go up to where there is something to the right
                k //= 2
            if not k:
                return None
            k += 1
            if k >= 2 * self.size or k & (k - 1) == 0:
                return None
        while k < self.size:
            k = 2 * k if any_[2 * k] else 2 * k + 1
        room = k - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            self._mark(room, False)
        return room, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; ``lengths`` go from long to short."""
    tree, count = RoomTree(window), 0
    windows, offsets = [], []
    for length in lengths:
        found = tree.take(length)
        if found is None:
            room, at = window, count
            count += 1
        else:
            room, at = found
        windows.append(at)
        offsets.append(window - room)
        if room > length:
            tree.add(room - length, at)
    return windows, offsets


def pack_pieces(pieces: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """``pieces`` (``doc_id, start, length`` and any other columns) with ``sequence_id`` and ``offset``.

    Lengths are from 1 to ``window``. Ties go by document and start; repeated rows are pieces of their own.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        shard = key[0].as_py()
        windows, offsets = best_fit(table["length"].to_pylist(), window)
        ids = pa.array(np.array(windows, np.int64) + (shard << 32))
        table = table.drop_columns(["packing_shard"])
        return table.append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    shard = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(shards, 1))).cast("long")
    return pieces.withColumn("packing_shard", shard).groupBy("packing_shard").applyInArrow(packed, schema)


def shard_count(documents: DataFrame) -> int:
    return -(-documents.count() // SHARD_DOCUMENTS)


def pack_documents(documents: DataFrame, vocabulary: str = BYTE_BPE, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its ids, its sequence and its place there."""
    return pack_pieces(cut_documents(documents, vocabulary, window), shard_count(documents), window)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence in order, as 32-bit ids without padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
