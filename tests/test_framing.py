"""Captures in blocks against a scan of the whole file."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cellwave.sources import binary, framing, tabular


def records_of(frame, data):
    """``(number, offset, bytes)`` of a whole file, header by header."""
    at, out = frame.skip, []
    while at + frame.prefix <= len(data):
        size = frame.prefix + frame.body(data[at : at + frame.prefix])
        out.append((len(out), at, data[at : at + size]))
        at += size
    return out


def capture(seed, kind, count, most):
    pick = random.Random(seed)
    body = b"".join(_frame(pick, kind, pick.randint(0, most)) for _ in range(count))
    return b"\0" * 24 + body


def _frame(pick, kind, size):
    fill = {
        "random": lambda: pick.randbytes(size), "zero": lambda: bytes(size), "lines": lambda: b"\n" * size,
        "small": lambda: bytes(pick.choice((0, 0, 0, 3, 10, 255)) for _ in range(size)),
    }[kind]()
    return binary.PCAP_HEADER.pack(pick.randint(0, 9), 0, size, size) + fill


FILES = {
    "a/random": capture(1, "random", 400, 300),
    "a/zero": capture(2, "zero", 300, 200),
    "b c/lines": capture(3, "lines", 300, 100),
    "b c/small": capture(4, "small", 500, 120),
    "long": capture(5, "small", 3, 200) + _frame(random.Random(6), "small", 30000) + capture(7, "zero", 20, 5000)[24:],
    "cut-body": capture(8, "random", 20, 300)[:-7],
    "cut-head": capture(9, "random", 20, 30) + b"\n" * 9,
    "mark": b"\xef\xbb\xbf" + b"\0" * 21 + capture(10, "random", 60, 100)[24:],
    "tiny": b"\0\n",
    "header": b"\0" * 24,
    "newline": capture(11, "random", 9, 20) + _frame(random.Random(1), "lines", 3),
}


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    place = tmp_path_factory.mktemp("captures")
    for name, data in FILES.items():
        (place / name).parent.mkdir(exist_ok=True)
        (place / name).write_bytes(data)
    (place / "empty").write_bytes(b"")
    return str(place)


@pytest.mark.parametrize("block_bytes, split, segment, guesses", [(4096, None, 1024, 8), (300, 5000, 4, 8), (1500, None, 2, 0)])
def test_blocks_give_the_records_of_a_scan(spark, captures, monkeypatch, block_bytes, split, segment, guesses):
    monkeypatch.setattr(framing, "GUESSES", guesses)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    if guesses == 0:
        names, place = ["newline", "mark"], captures + "/{newline,mark}"
    else:
        names, place = list(FILES), captures
    try:
        if split:
            for key in keys:
                spark.conf.set(key, str(split))
        got = {}
        for r in framing.framed_records(spark, place, binary.PCAP, block_bytes, segment).collect():
            got.setdefault(r.path.split(captures)[1][1:], []).append((r.record, r.at, bytes(r.data)))
    finally:
        for key in keys:
            spark.conf.unset(key)
    for name in names:
        assert sorted(got.get(name, [])) == records_of(binary.PCAP, FILES[name]), name


def test_small_blocks_of_fixed_records(spark, tmp_path):
    data = random.Random(3).randbytes(1000)
    (tmp_path / "x").write_bytes(data)
    for size, block in ((7, 64), (300, 64), (64, 64), (1001, 100)):
        rows = framing.fixed_records(spark, str(tmp_path), size, block).collect()
        assert sorted((r.record, bytes(r.data)) for r in rows) == [(k, data[k * size : (k + 1) * size]) for k in range(1000 // size)]


def test_guesses_lead_to_the_true_exit():
    for name in ("a/random", "a/zero", "b c/small"):
        data = FILES[name]
        for end in range(3000, len(data) - 400, 997):
            nexts = [at for _, at, _ in records_of(binary.PCAP, data) if at + 16 > end]
            assert nexts[0] - end in framing.likely_exits(binary.PCAP, data[end - 2500 : end]), (name, end)


def test_listing_and_heads(spark, captures):
    rows = {r.path.split(captures)[1][1:]: r for r in tabular.read_heads(spark, captures).collect()}
    assert set(rows) == {*FILES, "empty"}
    for name, data in FILES.items():
        assert rows[name].length == len(data)
        if name != "mark":
            assert bytes(rows[name].head) == data[:3]
    assert rows["empty"].length == 0 and rows["empty"].head is None


def test_packets_of_many_blocks_equal_whole_files(spark, tmp_path):
    from test_sources import packet

    pick = random.Random(4)
    for name in "ab":
        parts = [packet(k, 1, 2, pick.randint(1, 9), k % 256, [pick.randint(-9, 9) for _ in range(36)]) for k in range(150)]
        (tmp_path / name).write_bytes(b"".join(parts) + b"\n")
    whole = binary.decode_files(spark.read.format("binaryFile").load(str(tmp_path)), binary.PACKETS, binary.parse_packet, binary.PACKET_SCHEMA)
    blocks = binary.read_packets(spark, str(tmp_path), block_bytes=2048)
    assert whole.count() == 300
    assert blocks.exceptAll(whole).isEmpty() and whole.exceptAll(blocks).isEmpty()


def test_records_never_travel_whole(spark, captures):
    """Only parts of records at block ends are shuffled; whole ones come straight from their block."""
    files = framing.files_of(spark, captures + "/a")
    blocks = framing.read_blocks(spark, captures + "/a", binary.PCAP, 4096)
    side = framing.locate(blocks, files, binary.PCAP)
    entries = framing.true_entries(blocks, side, binary.PCAP, 4096)
    parts = framing.raw_records(blocks, side, entries, binary.PCAP)
    assert parts.filter("not whole").count() <= 2 * blocks.count()
    assert struct.calcsize("<IIII") == binary.PCAP.prefix
    assert parts.filter("whole").select(F.min("record")).first()[0] == 0
