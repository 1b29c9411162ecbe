"""Binary capture sources: framed packets, radar records, point clouds.

Captures come as records that ``framing`` finds in parallel, in any store that
Spark reads. Small files can come as a binaryFile table instead.
"""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cellwave.sources.framing import BLOCK_BYTES, Framing, fixed_records, framed_records, integers

# Packet layouts.
PACKET_LENGTHS = struct.Struct(">19sIII")
PACKET_HEADER = struct.Struct("<I4xI34xBBxB2xI4xII6s2xB11xII")
PCAP_HEADER = struct.Struct("<IIII")
PCAP_FILE_HEADER_BYTES = 24

PACKET_SCHEMA = (
    "path string, packet_idx bigint, ts_ns bigint, n_subc int, n_tx int, n_rx int, rssi_a bigint, "
    "rssi_b bigint, mac_src string, seq int, rate_flags bigint, re array<double>, im array<double>"
)
PCAP_SCHEMA = "path string, frame_idx bigint, ts double, incl_len bigint, payload binary"


def _packet_body(prefix: bytes) -> int:
    _, header, _, data = PACKET_LENGTHS.unpack(prefix)
    return header + data


def _pcap_body(prefix: bytes) -> int:
    return PCAP_HEADER.unpack(prefix)[2]


def _packet_bodies(data: np.ndarray) -> np.ndarray:
    count = len(data) - PACKET_LENGTHS.size + 1
    return integers(data, 19, count, True) + integers(data, 27, count, True)


def _pcap_bodies(data: np.ndarray) -> np.ndarray:
    return integers(data, 8, len(data) - PCAP_HEADER.size + 1)


PACKETS = Framing(0, PACKET_LENGTHS.size, _packet_body, _packet_bodies)
PCAP = Framing(PCAP_FILE_HEADER_BYTES, PCAP_HEADER.size, _pcap_body, _pcap_bodies, True)


def _whole(framing: Framing, at: int, prefix: bytes, body: bytes) -> bytes | None:
    """The body of a record that the file's end may cut short; None where that leaves no record."""
    size = framing.body(prefix)
    if len(body) >= size:
        return body
    if framing.pad_short:
        return body + b"\x00" * (size - len(body)) if body else None
    if len(body) < PACKET_LENGTHS.unpack(prefix)[1]:
        return None
    raise ValueError(f"truncated packet payload at byte {at}: expected {size}, got {len(body)}")


def _records(framing: Framing, read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """``(prefix, body)`` of each record that starts in [start, end)."""
    at = start
    while at < end:
        prefix = read(at, framing.prefix)
        if len(prefix) < framing.prefix:
            return
        size = framing.body(prefix)
        body = _whole(framing, at, prefix, read(at + framing.prefix, size))
        if body is None:
            return
        yield prefix, body
        at += framing.prefix + size


def _decode(framing: Framing, parse: Callable, read, path, start, end, first) -> Iterator[tuple]:
    for i, (prefix, body) in enumerate(_records(framing, read, start, end)):
        row = parse(prefix, body)
        if row is not None:
            yield (path, first + i, *row)


def _columns(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(", ")]


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 512) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=_columns(schema))
            held = []
    if held:
        yield pd.DataFrame(held, columns=_columns(schema))


def decode_records(records: DataFrame, framing: Framing, parse: Callable, schema: str) -> DataFrame:
    """Decode records ``(path, record, at, data)``, header and body in one."""

    def run(batches):
        for batch in batches:
            yield from _in_batches(rows(batch), schema)

    def rows(batch):
        for path, record, at, data in zip(batch["path"], batch["record"], batch["at"], batch["data"]):
            prefix = data[: framing.prefix]
            body = _whole(framing, at, prefix, data[framing.prefix :])
            row = None if body is None else parse(prefix, body)
            if row is not None:
                yield (path, record, *row)

    return records.select("path", "record", "at", "data").mapInPandas(run, schema)


def decode_files(files: DataFrame, framing: Framing, parse: Callable, schema: str) -> DataFrame:
    """Decode a binaryFile table ``(path, content)``, one file per row."""

    def run(batches):
        for batch in batches:
            yield from _in_batches(rows(batch), schema)

    def rows(batch):
        for path, content in zip(batch["path"], batch["content"]):
            data = bytes(content)

            def read(at, n, data=data):
                return data[at : at + n]

            yield from _decode(framing, parse, read, path, framing.skip, len(data), 0)

    return files.select("path", "content").mapInPandas(run, schema)


def parse_packet(prefix: bytes, body: bytes):
    """Packet fields and CSI in (subc, tx, rx) order; None if the payload is short."""
    stamp, header_len, _, _ = PACKET_LENGTHS.unpack(prefix)
    if header_len < PACKET_HEADER.size:
        return None
    fields = PACKET_HEADER.unpack(body[: PACKET_HEADER.size])
    n_rx, n_tx, n_subc, rssi_a, rssi_b, mac, seq, flags = (
        fields[2], fields[3], fields[5], fields[6], fields[7], fields[8], fields[9], fields[11]
    )
    data = body[header_len:]
    iq = np.frombuffer(data[: len(data) // 4 * 4], dtype="<i2").reshape(-1, 2)
    wanted = n_tx * n_rx * n_subc
    if len(iq) < wanted:
        return None
    cube = iq[:wanted].reshape(n_tx, n_rx, n_subc, 2).transpose(2, 0, 1, 3).reshape(-1, 2).astype(float)
    text = stamp.strip(b"\x00")
    ts = int(text) if text.isdigit() else 0
    address = ":".join(f"{b:02x}" for b in mac)
    return ts, n_subc, n_tx, n_rx, rssi_a, rssi_b, address, seq, flags, cube[:, 0], cube[:, 1]


def parse_pcap_frame(prefix: bytes, body: bytes):
    seconds, micros, size, _ = PCAP_HEADER.unpack(prefix)
    return seconds + micros / 1e6, size, body


def read_packets(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Length-prefixed CSI packets of all files under a path."""
    return decode_records(framed_records(spark, path, PACKETS, block_bytes), PACKETS, parse_packet, PACKET_SCHEMA)


def read_pcap(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return decode_records(framed_records(spark, path, PCAP, block_bytes), PCAP, parse_pcap_frame, PCAP_SCHEMA)


def packet_cells(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packed packet payloads to cells ``(keys, subc, tx, rx, re, im)``."""
    zipped = F.arrays_zip("re", "im")
    rows = packets.select(*keys, "n_tx", "n_rx", F.posexplode(zipped).alias("_i", "_c"))
    i, tx, rx = F.col("_i").cast("bigint"), F.col("n_tx"), F.col("n_rx")
    return rows.select(
        *keys, F.floor(i / (tx * rx)).alias("subc"), F.pmod(F.floor(i / rx), tx.cast("bigint")).alias("tx"),
        F.pmod(i, rx.cast("bigint")).alias("rx"), "_c.re", "_c.im",
    )


def read_fixed_records(spark: SparkSession, path: str, record_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(path, record, content)`` of captures of equal-size records, many to a block."""
    if record_bytes <= 0:
        raise ValueError("record size must be positive")
    rows = fixed_records(spark, path, record_bytes, block_bytes)
    return rows.select("path", "record", F.col("data").alias("content"))


def record_size_problems(listing: DataFrame, record_bytes: int) -> DataFrame:
    """Files whose size is not a whole number of records."""
    return listing.where(F.col("length") % record_bytes != 0)


def _blocks(fn: Callable[[np.ndarray], np.ndarray]):
    """Decode int16 records of one size to complex arrays."""

    @pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(content: pd.Series) -> pd.DataFrame:
        decoded = [fn(np.frombuffer(bytes(c), dtype="<i2").astype(float)).reshape(-1) for c in content]
        return pd.DataFrame({"re": [d.real for d in decoded], "im": [d.imag for d in decoded]})

    return run


def _cells(df: DataFrame, keys: list[str], axes: dict[str, int]) -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.arrays_zip(F.col("_y.re").alias("re"), F.col("_y.im").alias("im"))).alias("_i", "_c"))
    rest, columns = F.col("_i").cast("bigint"), {}
    for name, size in reversed(list(axes.items())):
        columns[name] = F.pmod(rest, F.lit(size))
        rest = F.floor(rest / F.lit(size))
    return rows.select(*keys, *(columns[a].alias(a) for a in axes), "_c.re", "_c.im")


def radar_frame_bytes(num_chirps: int, num_tx: int, num_rx: int, num_adc: int) -> int:
    return num_chirps * num_tx * num_rx * num_adc * 4


def decode_radar_frames(
    records: DataFrame, keys: list[str], num_chirps: int, num_tx: int, num_rx: int, num_adc: int
) -> DataFrame:
    """One frame per record to cells ``(keys, chirp, adc, ant)``.

    Every ADC sample stores all I then all Q values; transmitters alternate
    per chirp and join the receivers as virtual antennas.
    """

    def frame(ints):
        iq = ints.reshape(num_chirps, num_tx, num_adc, 2, num_rx)
        return (iq[:, :, :, 0] + 1j * iq[:, :, :, 1]).transpose(0, 2, 1, 3)

    done = records.withColumn("_y", _blocks(frame)("content"))
    return _cells(done, keys, {"chirp": num_chirps, "adc": num_adc, "ant": num_tx * num_rx})


def decode_lane_chirps(
    records: DataFrame, keys: list[str], num_adc: int, num_rx: int = 4,
    chirp: str = "record", chirp_start: int = 0, chirp_count: int | None = None,
) -> DataFrame:
    """One two-lane LVDS chirp per record to cells ``(keys, chirp, rx, adc)``.

    Groups of four integers hold two real parts and two imaginary parts.
    """
    kept = records.where(F.col(chirp) >= chirp_start)
    if chirp_count is not None:
        kept = kept.where(F.col(chirp) < chirp_start + chirp_count)
    kept = kept.withColumn("chirp", F.col(chirp) - chirp_start)

    def one(ints):
        lanes = ints.reshape(-1, 2, 2)
        return (lanes[:, 0] + 1j * lanes[:, 1]).reshape(num_rx, num_adc)

    done = kept.withColumn("_y", _blocks(one)("content"))
    return _cells(done, [*keys, "chirp"], {"rx": num_rx, "adc": num_adc})


def decode_point_frames(files: DataFrame, keys: list[str], max_points: int | None = None, width: int = 5) -> DataFrame:
    """Frame files of float64 tuples to rows ``(keys, point, f0..)``.

    The optional cap keeps the first points of a frame; frames stay ragged.
    """

    @pandas_udf("array<array<double>>")
    def unpack(content: pd.Series) -> pd.Series:
        return pd.Series([list(np.frombuffer(bytes(c), dtype="<f8").reshape(-1, width)) for c in content])

    rows = files.select(*keys, F.posexplode(unpack("content")).alias("point", "_p"))
    if max_points is not None:
        rows = rows.where(F.col("point") < max_points)
    return rows.select(
        *keys, F.col("point").cast("bigint").alias("point"), *(F.col("_p")[i].alias(f"f{i}") for i in range(width))
    )


def point_counts(files: DataFrame, keys: list[str], max_points: int | None = None, width: int = 5) -> DataFrame:
    """Points per frame, empty frames included, from the file size alone."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content").cast("bigint")
    count = F.floor(size / F.lit(8 * width))
    if max_points is not None:
        count = F.least(count, F.lit(max_points).cast("bigint"))
    return files.select(*keys, count.alias("points"))
