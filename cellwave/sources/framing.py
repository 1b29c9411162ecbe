"""Length-prefixed captures in parallel: true record starts without reading a file in order.

A capture can't be cut at a guess: only the header before a record tells where the next one starts.

1. ``read_blocks`` brings a capture in as blocks of fixed size through Spark's own text reader, which splits files and
   reads every store that Spark reads: lines at byte 10 joined again are the bytes. Blocks are written once, with their
   last bytes and with guesses: the ways out that most offsets near the block's end lead to.
2. A block maps an entry (where a header starts) to its exit (where the first header that is not wholly in it or before
   it starts). Each block walks its headers from the few entries that the block before it guessed.
3. The maps are composed in two levels: inside segments of ``SEGMENT`` blocks, then from segment to segment, then
   back inside each segment. If the true chain comes to an entry that nobody guessed, that block is walked from it, and
   maps are composed again. So the result does not rest on guesses, they only save rounds.
4. With its true entry each block cuts its records. A record that reaches beyond its block comes in parts, which are the
   only bytes that are shuffled, and one part a block.

What is kept of a block besides its bytes is a row of some hundred bytes; windows over a file hold those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwave.operators.ordinal import written

BLOCK_BYTES = 4 << 20
LOOK_BYTES = 1 << 19
GUESSES = 8
SEGMENT = 1024
#: The text reader drops these bytes at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
_BLOCK = ["file", "split", "piece"]


@dataclass(frozen=True)
class Framing:
    """How to step over one record: file header size, prefix size, body size of one prefix.

    ``bodies`` gives the body sizes that the prefixes at every offset of a byte array would announce.
    """

    skip: int
    prefix: int
    body: Callable[[bytes], int]
    bodies: Callable[[np.ndarray], np.ndarray]
    pad_short: bool = False

    @property
    def reach(self) -> int:
        """A header belongs to the block that holds this many bytes of it and after it, less one."""
        return max(self.prefix, 1)


def integers(data: np.ndarray, at: int, count: int, big: bool = False) -> np.ndarray:
    """The unsigned 32-bit integers ``at`` bytes after each of the first ``count`` offsets."""
    order = (3, 2, 1, 0) if big else (0, 1, 2, 3)
    return sum(data[at + k : at + k + count].astype(np.int64) << np.int64(8 * shift) for k, shift in zip(range(4), order, strict=True))


def likely_exits(framing: Framing, content: bytes) -> list[int]:
    """Ways out of a block, counted from its end: those that most offsets in its last ``LOOK_BYTES`` lead to, and by most steps."""
    data = np.frombuffer(content, np.uint8)[-LOOK_BYTES:]
    count = len(data) - framing.prefix + 1
    if count <= 0 or not framing.prefix:
        return []
    after = np.arange(count) + framing.prefix + framing.bodies(data)
    jump = np.where(after < count, after, np.arange(count))
    steps = (after < count).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump, steps = further, steps + steps[jump]
    ways, number, votes = np.unique(after[jump], return_inverse=True, return_counts=True)
    most = np.zeros(len(ways), np.int64)
    np.maximum.at(most, number, steps)
    best = np.union1d(np.lexsort((ways, -votes))[:GUESSES], np.lexsort((ways, -votes, -most))[:GUESSES])
    return (ways[best] - len(data)).tolist()


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, length`` of all files under a path; contents are not read, empty files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), "path", "length")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``line, url, split``: all files as byte strings between bytes 10, in order within a split of a file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n")
    url, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return lines.select(F.col("value").cast("binary").alias("line"), url.alias("url"), split.alias("split"))


def heads_of(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``url, head``: the first bytes of every file that has any (without a byte order mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url, head = None, b""
        for batch in batches:
            out = []
            for line, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if own != url:
                    out.append((url, head[:size]))
                    url, head = own, b""
                if len(head) < size:
                    head += line.as_py() + b"\n"
            urls, heads = zip(*[o for o in out if o[0] is not None] or [(None, None)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(heads, pa.binary())], ["url", "head"])
        yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([head[:size]], pa.binary())], ["url", "head"])

    rows = lines_of(spark, path).filter("split = 0").select("line", "url").mapInArrow(run, "url string, head binary")
    return rows.filter("url is not null")


def read_blocks(spark: SparkSession, path: str, framing: Framing, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, split, piece, size, tail, ways, content`` of every block, as a written table.

    ``ways`` are the likely exits, ``tail`` the last bytes. The last block of a file may have a byte 10 too many.
    """
    lines = lines_of(spark, path).select("line", F.xxhash64("url").alias("file"), "split")
    kept = max(framing.reach - 1, 1)

    def row(file: int, split: int, piece: int, content: bytes) -> dict:
        ways = likely_exits(framing, content)
        return {"file": file, "split": split, "piece": piece, "size": len(content), "tail": content[-kept:], "ways": ways, "content": content}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        here, held, piece = None, bytearray(), 0
        for batch in batches:
            file, split = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (split[1:] != split[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(file)], strict=True):
                if (int(file[a]), int(split[a])) != here:
                    if held:
                        yield row(*here, piece, bytes(held))
                    here, held, piece = (int(file[a]), int(split[a])), bytearray(), 0
                held += b"\n".join(batch.column(0).slice(a, b - a).to_pylist()) + b"\n"
                while len(held) >= block_bytes:
                    yield row(*here, piece, bytes(held[:block_bytes]))
                    held, piece = held[block_bytes:], piece + 1
        if held:
            yield row(*here, piece, bytes(held))

    kind = pa.schema([("file", pa.int64()), ("split", pa.int64()), ("piece", pa.int64()), ("size", pa.int64()),
                      ("tail", pa.binary()), ("ways", pa.list_(pa.int64())), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in pieces(batches):
            yield pa.RecordBatch.from_pylist([one], kind)

    schema = "file long, split long, piece long, size long, tail binary, ways array<long>, content binary"
    return written(lines.mapInArrow(run, schema), "capture-blocks")


def locate(blocks: DataFrame, files: DataFrame, framing: Framing) -> DataFrame:
    """``file, split, piece, number, start, size, length, before, ways`` of every block: where it lies in its file.

    ``before`` are the bytes in front of the block that a header may begin in. Blocks whose files changed size between
    listing and reading, or that the text reader decompressed, raise.
    """
    rows = blocks.select(*_BLOCK, "size", "tail", "ways")
    splits = rows.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    in_file = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("base", F.sum("bytes").over(in_file) - F.col("bytes"))
    splits = splits.withColumn("total", F.sum("bytes").over(Window.partitionBy("file"))).join(files.select("file", "length"), "file")
    lost = F.col("length") - F.col("total")
    mark = F.when(lost.isin(0, -1), 0).when(lost.isin(3, 2), 3).otherwise(F.raise_error(F.concat(F.lit("bytes read and file size differ by "), lost)))
    splits = splits.select("file", "split", "length", "base", mark.alias("mark"))
    in_split = Window.partitionBy("file", "split").orderBy("piece")
    rows = rows.withColumn("inside", F.sum("size").over(in_split) - F.col("size")).join(splits, ["file", "split"])
    first = (F.col("base") == 0) & (F.col("inside") == 0)
    start = F.when(first, 0).otherwise(F.col("base") + F.col("inside") + F.col("mark"))
    size = F.col("size") + F.when(first, F.col("mark")).otherwise(0)
    rows = rows.withColumns({"start": start, "size": F.least(size, F.col("length") - start)}).filter("size > 0")
    order = Window.partitionBy("file").orderBy("start")
    kept = max(framing.reach - 1, 1)
    tails = F.collect_list("tail").over(order.rowsBetween(-kept, -1))
    joined = F.aggregate(tails, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    before = F.substring(joined, F.greatest(F.octet_length(joined) - (framing.reach - 2), F.lit(1)), F.lit(framing.reach - 1))
    if framing.reach == 1:
        before = F.lit(b"").cast("binary")
    return rows.select(*_BLOCK, (F.row_number().over(order) - 1).alias("number"), "start", "size", "length", before.alias("before"), "ways")


def content_of(blocks: DataFrame, side: DataFrame) -> DataFrame:
    """The blocks of ``side`` with their bytes: small rows meet the written blocks, Spark broadcasts them where it can."""
    content = F.when((F.col("start") == 0) & (F.octet_length("raw") < F.col("size")), F.concat(F.lit(BYTE_ORDER_MARK), F.col("raw")))
    rows = blocks.select(*_BLOCK, F.col("content").alias("raw")).join(side, _BLOCK)
    return rows.withColumn("content", F.substring(F.coalesce(content, F.col("raw")), F.lit(1), F.col("size").cast("int"))).drop("raw")


def block_of(rows: DataFrame, at: str, side: DataFrame, block_bytes: int) -> DataFrame:
    """The block of ``side`` that holds the byte ``at`` of its file, by equal spans of a block's size."""
    span = F.lit(block_bytes)
    spans = F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("size") - 1) / span))
    blocks = side.select("file", "number", "start", "size", F.explode(spans).alias("span"))
    rows = rows.withColumn("span", F.floor(F.col(at) / span))
    return rows.join(blocks, ["file", "span"]).filter(F.col(at).between(F.col("start"), F.col("start") + F.col("size") - 1))


def walked(blocks: DataFrame, side: DataFrame, entries: DataFrame, framing: Framing) -> DataFrame:
    """``file, number, entry, exit, records``: each block's headers walked from its entries (``file, number, entry``)."""
    wanted = entries.groupBy("file", "number").agg(F.sort_array(F.collect_set("entry")).alias("entries"))
    rows = content_of(blocks, side.join(wanted, ["file", "number"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, number, start, before, entries, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, low = before + content, start - len(before)
                known: dict[int, tuple[int, int]] = {}
                for entry in entries:
                    path, at = [], entry
                    while at not in known:
                        path.append(at)
                        if at - low + framing.reach > len(data):
                            known[at] = (at, 0)
                        else:
                            at += framing.prefix + framing.body(data[at - low : at - low + framing.prefix])
                    last, records = known[at]
                    for k, place in enumerate(reversed([p for p in path if p not in known]), 1):
                        known[place] = (last, records + k)
                    out.append((file, number, entry, *known[entry]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["file", "number", "entry", "exit", "records"])

    rows = rows.select("file", "number", "start", "before", "entries", "content")
    return rows.mapInArrow(run, "file long, number long, entry long, exit long, records long")


_STEP = "file long, segment long, entry long, leaves long, records long, ends boolean"
_ENTRY = "file long, number long, entry long, before_records long, records long"


def _through(rows: pd.DataFrame) -> dict[int, tuple[int, int, bool]]:
    """For the entries of one segment where its records lead out, how many, and whether at an entry not walked yet."""
    end = int(rows["end"].iloc[0])
    reach = int(rows["reach"].iloc[0])
    out: dict[int, tuple[int, int, bool]] = {}
    for entry, exit_, records in sorted(zip(rows["entry"], rows["exit"], rows["records"], strict=True), reverse=True):
        if exit_ in out:
            leaves, more, ends = out[exit_]
            out[entry] = (leaves, records + more, ends)
        else:
            out[entry] = (exit_, records, exit_ + reach <= end)
    return out


def _segments(pdf: pd.DataFrame) -> pd.DataFrame:
    through = _through(pdf)
    rows = [(pdf["file"].iloc[0], pdf["segment"].iloc[0], e, *through[e]) for e, outer in zip(pdf["entry"], pdf["outer"], strict=True) if outer]
    return pd.DataFrame(rows, columns=["file", "segment", "entry", "leaves", "records", "ends"])


def _files(skip: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The entries of the segments on the way from the start of one file, and where it comes to one not walked."""
        steps = {e: (s, x, n, ends) for s, e, x, n, ends in zip(pdf["segment"], pdf["entry"], pdf["leaves"], pdf["records"], pdf["ends"], strict=True)}
        at, total, out = skip, 0, []
        while at in steps:
            segment, leaves, records, ends = steps[at]
            out.append((pdf["file"].iloc[0], segment, at, total, ends, leaves))
            at, total = leaves, total + records
            if ends:
                break
        lost = not (out and out[-1][4]) and at + int(pdf["reach"].iloc[0]) <= int(pdf["length"].iloc[0])
        if lost:
            out.append((pdf["file"].iloc[0], -1, at, total, True, at))
        return pd.DataFrame(out, columns=["file", "segment", "entry", "before_records", "ends", "leaves"])

    return run


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """The true entry of each block of one segment."""
    maps = {e: (n, x, c) for n, e, x, c in zip(pdf["number"], pdf["entry"], pdf["exit"], pdf["records"], strict=True)}
    at, total, out = int(pdf["first"].iloc[0]), int(pdf["before_records"].iloc[0]), []
    while at in maps:
        number, exit_, records = maps[at]
        out.append((pdf["file"].iloc[0], number, at, total, records))
        at, total = exit_, total + records
    return pd.DataFrame(out, columns=["file", "number", "entry", "before_records", "records"])


def true_entries(blocks: DataFrame, side: DataFrame, framing: Framing, block_bytes: int, segment: int = SEGMENT) -> DataFrame:
    """``file, number, entry, before_records, records``: the first true header of each block that has one."""
    part = F.floor(F.col("number") / segment)
    reach = framing.reach
    begins = side.filter("number = 0").select("file", F.lit(-1).cast("long").alias("from"), F.lit(framing.skip).cast("long").alias("entry"))
    ways = side.select("file", F.col("number").alias("from"), F.explode(F.transform("ways", lambda w: w + F.col("start") + F.col("size"))).alias("entry"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("at", F.col("entry") + (reach - 1))
        found = block_of(rows, "at", side, block_bytes).select("file", "number", "entry", "from")
        return written(found.groupBy("file", "number", "entry").agg(F.min("from").alias("from")), "capture-entries")

    entries = placed(begins.unionByName(ways))
    maps = written(walked(blocks, side, entries, framing), "capture-maps")
    ends = side.groupBy("file", part.alias("segment")).agg(F.max(F.col("start") + F.col("size")).alias("end"))
    lengths = side.groupBy("file").agg(F.max("length").alias("length"), F.lit(reach).alias("reach"))
    while True:
        rows = maps.join(entries, ["file", "number", "entry"]).withColumns({
            "segment": part, "outer": F.floor(F.col("from") / segment) != part, "reach": F.lit(reach),
        })
        rows = rows.join(ends, ["file", "segment"]).drop("from")
        steps = rows.groupBy("file", "segment").applyInPandas(_segments, _STEP)
        way = steps.join(lengths, "file").groupBy("file").applyInPandas(
            _files(framing.skip), "file long, segment long, entry long, before_records long, ends boolean, leaves long"
        )
        way = written(way, "capture-way")
        lost = way.filter("ends").select("file", F.lit(-1).cast("long").alias("from"), F.col("leaves").alias("entry"))
        if lost.isEmpty():
            break
        more = placed(lost)
        entries = entries.unionByName(more)
        maps = maps.unionByName(written(walked(blocks, side, more, framing), "capture-maps"))
    first = way.select("file", "segment", F.col("entry").alias("first"), "before_records")
    return rows.drop("reach", "end", "outer").join(first, ["file", "segment"]).groupBy("file", "segment").applyInPandas(_inside, _ENTRY)


def fixed_entries(side: DataFrame, record_bytes: int) -> DataFrame:
    """The same for records of one size, by arithmetic."""
    first = F.ceil(F.col("start") / record_bytes) * record_bytes
    rows = side.filter(first < F.col("start") + F.col("size"))
    records = F.ceil((F.col("start") + F.col("size") - first) / record_bytes)
    return rows.select("file", "number", first.alias("entry"), (first / record_bytes).cast("long").alias("before_records"), records.alias("records"))


def raw_records(blocks: DataFrame, side: DataFrame, entries: DataFrame, framing: Framing) -> DataFrame:
    """``file, record, at, whole, data``: records that lie in one block, and the parts of the others.

    A block's bytes before its first header belong to the record that began last.
    """
    rows = side.select("file", *_BLOCK[1:], "number", "start", "size", "length", "before").join(entries, ["file", "number"], "left")
    order = Window.partitionBy("file").orderBy("number")
    earlier = F.last(F.col("before_records") + F.col("records"), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("entry", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    end = F.col("start") + F.col("size")
    rows = rows.select(
        "file", *_BLOCK[1:], "start", "size", "before", "entry", "length",
        F.coalesce("before_records", earlier).alias("next"), F.least(end, F.coalesce(later, end)).alias("limit"),
    )

    def cut(file: int, start: int, before: bytes, entry: int | None, length: int, next_: int | None, limit: int, content: bytes) -> Iterator[tuple]:
        if next_ and limit > start:
            yield file, next_ - 1, start, False, content[: limit - start]
        if entry is None:
            return
        data, low, at, record = before + content, start - len(before), entry, next_
        while at - low + framing.reach <= len(data):
            size = framing.prefix + framing.body(data[at - low : at - low + framing.prefix])
            own = data[at - low : at - low + size]
            yield file, record, at, len(own) == size or low + len(data) >= length, own
            at, record = at + size, record + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = list(cut(*one)) or [()]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names, kinds = ["file", "record", "at", "whole", "data"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    content = content_of(blocks, rows).select("file", "start", "before", "entry", "length", "next", "limit", "content")
    return content.mapInArrow(run, "file long, record long, at long, whole boolean, data binary")


def joined_records(parts: DataFrame) -> DataFrame:
    """``file, record, at, data`` with the parts of records put together."""
    whole = parts.filter("whole").select("file", "record", "at", "data")
    own = F.sort_array(F.collect_list(F.struct("at", "data")))
    split = parts.filter("not whole").groupBy("file", "record").agg(own.alias("own"), F.min("at").alias("at"))
    data = F.aggregate("own.data", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return whole.unionByName(split.select("file", "record", "at", data.alias("data")))


def framed_records(spark: SparkSession, path: str, framing: Framing, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """``path, record, at, data``: every record of the captures under a path, header and body, numbered by its file.

    A body that the file's end cuts short is as long as it is; a last header that is cut short is no record.
    """
    files = files_of(spark, path)
    blocks = read_blocks(spark, path, framing, block_bytes)
    side = written(locate(blocks, files, framing), "capture-side")
    entries = written(true_entries(blocks, side, framing, block_bytes, segment), "capture-true")
    rows = joined_records(raw_records(blocks, side, entries, framing))
    return rows.join(files.select("file", "path"), "file").select("path", "record", "at", "data")


def fixed_records(spark: SparkSession, path: str, record_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, record, at, data`` of captures of equal-size records; a last part of a record is left out."""
    framing = Framing(0, 0, lambda _: record_bytes, lambda data: np.full(len(data), record_bytes))
    files = files_of(spark, path)
    blocks = read_blocks(spark, path, framing, block_bytes)
    side = written(locate(blocks, files, framing), "capture-side")
    rows = joined_records(raw_records(blocks, side, fixed_entries(side, record_bytes), framing))
    rows = rows.filter(F.octet_length("data") == record_bytes)
    return rows.join(files.select("file", "path"), "file").select("path", "record", "at", "data")
