"""Token ids in files of fixed-width bit packing.

A file is a run of segments, each followed by a line break (Spark's text writer, which commits whole tasks, writes
them). A segment: ``HEAD``; per document its id, a null mark and its first token; the byte offset of each block;
the blocks. A block packs ``BLOCK`` ids (the last one fewer) with as many bits each as the vocabulary needs, most
significant bit first, and begins at a whole byte, so any range of tokens is read from its blocks alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cellwave.llm.common import slices
from cellwave.llm.tokens import END_ID, WORD_BPE, encoder

MAGIC = b"CWTOKENS"
#: magic, bits an id, ids a block, partition, segment of the partition, documents, tokens, blocks, bytes of all
HEAD = struct.Struct("<8sIIqqqqqq")
BLOCK = 4096
SEGMENT_TOKENS = 1 << 18
SLICE_BYTES = 1 << 20
#: Rows are dealt to files by id and so many characters of their text, so that one id may take many files.
TEXT_KEY = 32


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits one after another, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def unpack_bits(raw: bytes | np.ndarray, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits).reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype=np.uint32)


def segment_bytes(part: int, number: int, docs: list, counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack_bits(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    sizes = np.array([0, *(len(b) for b in blocks)], np.int64)
    table = b"".join([
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.cumsum([0, *counts]).astype("<i8").tobytes(),
        (np.cumsum(sizes)[:-1] if len(blocks) else sizes[:0]).astype("<i8").tobytes(),
    ])
    total = HEAD.size + len(table) + int(sizes.sum())
    return HEAD.pack(MAGIC, bits, BLOCK, part, number, len(docs), len(ids), len(blocks), total) + table + b"".join(blocks)


class Segment:
    """One segment in a byte buffer: its documents, and the ids of any of them."""

    def __init__(self, raw: memoryview) -> None:
        magic, self.bits, self.block, self.part, self.number, docs, self.tokens, blocks, self.bytes = HEAD.unpack_from(raw)
        if magic != MAGIC or len(raw) < self.bytes:
            raise ValueError("not a whole segment of token ids")
        at = HEAD.size
        self.docs = np.frombuffer(raw, "<i8", docs, at)
        self.null = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
        self.starts = np.frombuffer(raw, "<i8", docs + 1, at := at + docs)
        self.offsets = np.frombuffer(raw, "<i8", blocks, at := at + 8 * (docs + 1))
        self.body = raw[at + 8 * blocks : self.bytes]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the tokens ``[start, end)`` of the segment, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            count = min(self.block, self.tokens - k * self.block)
            at = int(self.offsets[k])
            parts.append(unpack_bits(self.body[at : at + -(-count * self.bits // 8)], count, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]


def segments(content: bytes) -> Iterator[Segment]:
    view, at = memoryview(content), 0
    while at < len(view):
        found = Segment(view[at:])
        yield found
        at += found.bytes + 1


def write_tokens(documents: DataFrame, place: str, vocabulary: str = WORD_BPE, end_id: int = END_ID) -> None:
    """Files of the ids of all texts, each with the end id, in ascending ``doc_id``.

    A null text is empty. Rows of one id go by text; null ids come first.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        bits = max(tool.size - 1, end_id, 1).bit_length()
        end = np.array([end_id], "<u4").tobytes()
        docs, raws, held, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), "<u4")
            raw = segment_bytes(part, number, docs, [len(x) // 4 for x in raws], ids, bits)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for batch in slices(batches, "text", SLICE_BYTES):
            for doc, raw in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc)
                raws.append(raw + end)
                held += len(raws[-1]) // 4
                if held >= SEGMENT_TOKENS:
                    yield close()
                    docs, raws, held, number = [], [], 0, number + 1
        if docs:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.left("text", F.lit(TEXT_KEY))).sortWithinPartitions("doc_id", "text")
    # raw bytes as a string: the text writer writes them as they are
    ordered.mapInArrow(encoded, "segment binary").select(F.col("segment").cast("string").alias("value")).write.text(place)


def read_tokens(spark: SparkSession, place: str, columns: Sequence[str | Column] = ("ids",)) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``columns`` of every document: ``start`` counts the ids of all documents before it.

    ``columns`` are made from ``ids`` (little-endian 32-bit ids) before rows move to meet their starts.
    """
    files = spark.read.format("binaryFile").load(place).select("content")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s.part, s.number, s.tokens) for c in batch.column(0) for s in segments(c.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "tokens"), r, strict=True)) for r in rows],
                                             pa.schema([(n, pa.int64()) for n in ("part", "number", "tokens")]))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "number", "doc_id", "local", "n_tokens", "ids"]
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    n = len(s.docs)
                    for a in range(0, n, 1000):
                        b = min(n, a + 1000)
                        cuts = s.starts[a : b + 1]
                        raw = s.ids(int(cuts[0]), int(cuts[-1])).astype("<u4").tobytes()
                        at = ((cuts - cuts[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(b - a, s.part)), pa.array(np.full(b - a, s.number)),
                                pa.array(s.docs[a:b], mask=s.null[a:b].astype(bool)), pa.array(cuts[:-1]),
                                pa.array(np.diff(cuts)), pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary()),
                            ],
                            names,
                        )

    sizes = files.mapInArrow(totals, "part long, number long, tokens long")
    before = W.Window.partitionBy("part").orderBy("number").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # one row per file, so the single window below stays small
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    bases = sizes.join(parts, "part").select("part", "number", (F.col("first") + F.col("inside")).alias("base"))
    rows = files.mapInArrow(documents, "part long, number long, doc_id long, local long, n_tokens long, ids binary")
    rows = rows.select("part", "number", "doc_id", "local", "n_tokens", *columns)
    return rows.join(bases, ["part", "number"]).withColumn("start", F.col("base") + F.col("local")).drop(
        "part", "number", "base", "local"
    )
