"""WARC archives: pages to records and back, long records in segments, payloads in chunked transfer framing.

Archives are gzip files that Spark's text writer commits per task (a record ends in a line break). Reading takes
records by their Content-Length, brings the segments of a record together by its origin id, orders them by segment
number, holds their length against the stated total and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.llm.common import slices

SEGMENT = 16 << 10
CHUNK = 4 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
READ_STEP = SLICE_BYTES = 1 << 20
RECORDS = (
    "record_id string, type string, page_id long, refers_to long, digest string, payload_length long, "
    "origin string, number long, total long, block binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of a whole HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("a response without the end of its head")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(row: dict, name: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: one response or revisit, or a response and its continuations."""
    payload, first = row["payload"] or b"", row["refers_to"]
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    common = [
        ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-Id", row["page_id"]),
        ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", profile), *common], b"")
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Segment-Number", 1), *common], block[:segment])
    for k in range(segment, len(block), segment):
        number = k // segment + 1
        yield record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}-{number}>"), ("WARC-Date", DATE),
                ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", len(block) if k + segment >= len(block) else None),
            ],
            block[k : k + segment],
        )


def records_in(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(fields, block)`` of each record of a plain or gzip archive, decompressed as it is read."""
    raw, held, at = memoryview(content), bytearray(), 0
    packed = bytes(raw[:2]) == b"\x1f\x8b"
    tool = zlib.decompressobj(31) if packed else None

    def more() -> bool:
        nonlocal at, tool
        if at >= len(raw):
            return False
        if not packed:
            held.extend(raw[at : at + READ_STEP])
            at += READ_STEP
            return True
        piece = bytes(raw[at : at + READ_STEP])
        at += len(piece)
        while piece:
            held.extend(tool.decompress(piece))
            piece = tool.unused_data
            if piece:  # the next member
                tool = zlib.decompressobj(31)
        return True

    start = 0
    while True:
        while (end := held.find(b"\r\n\r\n", start)) < 0:
            if not more():
                if bytes(held[start:]).strip():
                    raise ValueError("an archive ends inside a record's head")
                return
        lines = bytes(held[start:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        start = end + 8 + size
        if start >= READ_STEP:
            del held[:start]
            start = 0


def assign_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads the smallest page id is stored, others refer to it.

    A null html is an empty payload. Payloads under ``least_bytes`` are all stored, and so are rows without an id
    or with the id that the others refer to.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
    ).withColumn("hash", F.sha2("payload", 256))
    first = rows.groupBy("hash").agg(F.min("page_id").alias("first"))
    other = (F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= least_bytes)
    return rows.join(first, "hash").select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, place: str, segment: int = SEGMENT) -> None:
    """Archives of ``assign_revisits`` rows under ``place``."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "payload", SLICE_BYTES):
            out = []
            for row in batch.to_pylist():
                count += 1
                # the fragment keeps rows with one id apart
                out += page_records(row, f"urn:page:{row['page_id']}#{part}-{count}", segment)
            # the writer adds the last line break
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], ["record"])

    rows = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(built, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").text(place)


def _number(text: str | None) -> int | None:
    return int(text) if text and text != "None" else None


def read_records(spark: SparkSession, place: str, segmented: bool | None = None) -> DataFrame:
    """A row per record of all archives under ``place``, with its own block; of segmented records or of others only if asked.

    Others alone come with ``payload`` and ``decoded_digest`` of responses instead of a block: one worker a task reads
    and decodes.
    """
    decode = segmented is False
    names = RECORDS + (", payload binary, decoded_digest string" if decode else "")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in names.split(", ")])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in records_in(content.as_py()):
                    refers = re.match(r"<urn:page:(-?\d+)", f.get("warc-refers-to", ""))
                    number = _number(f.get("warc-segment-number"))
                    if segmented is not None and segmented != (number is not None):
                        continue
                    extra = ()
                    if decode:
                        extra = (None, None)
                        if f["warc-type"] == "response":
                            payload = payload_of(block)
                            extra, block = (payload, digest(payload)), None
                    rows.append((
                        f["warc-record-id"], f["warc-type"], _number(f.get("x-page-id")), refers and int(refers[1]),
                        f.get("warc-payload-digest", "").removeprefix("sha1:"), _number(f.get("x-payload-length")),
                        f.get("warc-segment-origin-id"), number, _number(f.get("warc-segment-total-length")), block, *extra,
                    ))
                    held += len(block if block is not None else extra[0])
                    if len(rows) >= 1000 or held >= SLICE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(place).select("content").mapInArrow(parsed, names)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses and revisits, the segments of each in one ``block``; raises where one is missing or too many."""
    whole = records.filter("number is null").drop("origin", "number", "total")
    return whole.unionByName(joined_segments(records))


def joined_segments(records: DataFrame) -> DataFrame:
    """The responses that lie in more than one record."""
    parts = records.filter("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    rows = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest", "payload_length")),
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b["block"]))
    rows = rows.withColumn("block", joined)
    gapless = F.forall(F.transform("parts", lambda p, k: p["number"] == k + 1), lambda x: x)
    right = gapless & (F.octet_length("block") == F.col("total"))
    problem = F.raise_error(F.concat(F.lit("segments don't add up: "), F.col("origin"))).cast("binary")
    rows = rows.withColumn("block", F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(problem))
    return rows.withColumnRenamed("origin", "record_id").drop("parts", "total")


def read_pages(spark: SparkSession, place: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload, payload_bytes, payload_digest``; a revisit's payload is null.

    Lengths and digests of responses are those of the decoded payload; a revisit states its own.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block", SLICE_BYTES):
            payloads = [payload_of(b) if k == "response" else None for k, b in zip(*(batch.column(i).to_pylist() for i in (0, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(payloads, pa.binary()), pa.array([None if p is None else digest(p) for p in payloads], pa.string())],
                [*batch.schema.names[:5], "payload", "decoded_digest"],
            )

    kept = ["type", "page_id", "refers_to", "digest", "payload_length"]
    both = "payload binary, decoded_digest string"
    kinds = "type string, page_id long, refers_to long, digest string, payload_length long"
    segmented = joined_segments(read_records(spark, place, True)).select(*kept, "block").mapInArrow(decoded, f"{kinds}, {both}")
    single = read_records(spark, place, False).select(*kept, "payload", "decoded_digest")
    rows = single.unionByName(segmented)
    return rows.select(
        "page_id", F.col("type").alias("record_type"), "refers_to", "payload",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce("decoded_digest", "digest").alias("payload_digest"),
    )
