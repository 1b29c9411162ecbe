"""Capture files on disk, truncated and odd ones included."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.operators import artifacts, audit
from cellwave.sources import binary, tabular


def packet(stamp, n_rx, n_tx, n_subc, seq, ints):
    header = binary.PACKET_HEADER.pack(0, 0, n_rx, n_tx, 1, n_subc, 30, 31, bytes(range(6)), seq, 0, 5)
    data = np.asarray(ints, dtype="<i2").tobytes()
    return binary.PACKET_LENGTHS.pack(str(stamp).encode().ljust(19, b"\0"), len(header), 0, len(data)) + header + data


def test_packet_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {}
    for name, count in (("a", 40), ("b", 3)):
        values[name] = rng.integers(-500, 500, (count, 2, 2, 4, 2))
        # the last packet is too short for its shape and is left out
        body = b"".join(packet(100 + i, 2, 2, 4, i % 256, v.ravel()) for i, v in enumerate(values[name]))
        (tmp_path / f"{name}.dat").write_bytes(body + packet(999, 3, 3, 9, 0, [1, 2]))
    rows = binary.read_packets(spark, str(tmp_path), block_bytes=1000).collect()
    assert len(rows) == 43
    for r in rows:
        name = r.path.split("/")[-1][0]
        want = values[name][r.packet_idx].transpose(2, 0, 1, 3).reshape(-1, 2)
        np.testing.assert_array_equal(np.stack([r.re, r.im], 1), want)
        assert r.ts_ns == 100 + r.packet_idx and r.mac_src == "00:01:02:03:04:05"
    whole = spark.read.format("binaryFile").load(str(tmp_path))
    again = binary.decode_files(whole, binary.PACKETS, binary.parse_packet, binary.PACKET_SCHEMA)
    assert {(r.path[-5:], r.packet_idx, r.ts_ns) for r in again.collect()} == {(r.path[-5:], r.packet_idx, r.ts_ns) for r in rows}
    cells = binary.packet_cells(again.where("n_subc = 4"), ["path", "packet_idx"])
    assert cells.count() == 43 * 16


def test_truncated_payload_is_an_error(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(packet(1, 1, 1, 4, 0, range(8))[:-3])
    with pytest.raises(Exception, match="truncated packet payload"):
        binary.read_packets(spark, str(tmp_path)).collect()


def test_pcap_pads_the_last_frame(spark, tmp_path):
    frames = [(5, 250000, b"abcdefgh"), (6, 0, b"xy")]
    body = b"\0" * 24 + b"".join(binary.PCAP_HEADER.pack(s, u, 8, 8) + p for s, u, p in frames)
    (tmp_path / "t.pcap").write_bytes(body)
    rows = binary.read_pcap(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.ts, bytes(r.payload)) for r in rows] == [(5.25, b"abcdefgh"), (6.0, b"xy" + b"\0" * 6)]


def test_fixed_records(spark, tmp_path):
    shape = (7, 3, 2, 4, 2, 2)  # frame, chirp, tx, adc, iq, rx
    ints = np.random.default_rng(2).integers(-99, 99, shape)
    path = tmp_path / "radar.bin"
    path.write_bytes(ints.astype("<i2").tobytes())
    size = binary.radar_frame_bytes(3, 2, 2, 4)
    records = binary.read_fixed_records(spark, str(path), size)
    assert [r.record for r in records.orderBy("record").collect()] == list(range(7))
    cells = binary.decode_radar_frames(records, ["record"], 3, 2, 2, 4).collect()
    assert len(cells) == 7 * 3 * 4 * 4
    for c in cells:
        iq = ints[c.record, c.chirp, c.ant // 2, c.adc, :, c.ant % 2]
        assert (c.re, c.im) == tuple(iq)
    listing = tabular.list_captures(spark, str(tmp_path))
    assert binary.record_size_problems(listing, size).count() == 0
    assert binary.record_size_problems(listing, size + 1).count() == 1


def test_lane_chirps(spark):
    adc = 4
    stream = np.arange(4 * adc) + 1j * (100 + np.arange(4 * adc))
    pairs = stream.reshape(-1, 2)
    ints = np.concatenate([pairs.real, pairs.imag], axis=1).ravel().astype("<i2")
    df = spark.createDataFrame([(i, bytearray(ints.tobytes())) for i in range(3)], "record bigint, content binary")
    rows = binary.decode_lane_chirps(df, [], adc, chirp_start=1, chirp_count=1).collect()
    assert len(rows) == 16
    assert all(r.chirp == 0 and complex(r.re, r.im) == stream[r.rx * adc + r.adc] for r in rows)


def test_point_frames(spark, tmp_path):
    points = np.random.default_rng(3).normal(size=(6, 5))
    (tmp_path / "frame1.bin").write_bytes(points.astype("<f8").tobytes())
    (tmp_path / "frame2.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = binary.decode_point_frames(files, ["path"], max_points=4).orderBy("point").collect()
    np.testing.assert_allclose([[r[f"f{i}"] for i in range(5)] for r in rows], points[:4])
    listing = tabular.walk_captures(spark, str(tmp_path))
    counts = {r.path[-5]: r.points for r in binary.point_counts(listing, ["path"], 4).collect()}
    assert counts == {"1": 4, "2": 0}


def test_csv_packets(spark, tmp_path):
    good = "[" + ",".join(map(str, range(128))) + "]"
    lines = ["type,id,mac,rssi,channel,local_timestamp,data"]
    for i, (kind, data) in enumerate([("CSI_DATA", good), ("OTHER", good), ("CSI_DATA", "[1,2]"), ("CSI_DATA", "[1,")]):
        lines.append(f'{kind},{i},aa,-40,6,{i},"{data}"')
    (tmp_path / "c.csv").write_text("\n".join(lines))
    raw = tabular.read_csv_csi(spark, str(tmp_path))
    rows = tabular.parse_csv_csi(raw).collect()
    assert len(rows) == 1 and rows[0].re == [float(x) for x in range(0, 128, 2)] and rows[0].im[1] == 3.0
    assert {(r.id, r.reason) for r in tabular.csv_csi_problems(raw).collect()} == {
        ("2", "unknown_length"), ("3", "invalid_json")
    }
    (tmp_path / "c.csv").write_text("type,id\nCSI_DATA,1\n")
    with pytest.raises(ValueError, match="missing required"):
        tabular.read_csv_csi(spark, str(tmp_path))


def test_file_names(spark):
    names = ["user3-1-2-4-r5.dat", "user3-1-2-3-4-r6.dat", "user3-1-2.dat", "userx-1-2-4-r5.dat", "user3-1-x-4-r5.dat"]
    df = spark.createDataFrame([(f"d/{n}",) for n in names], "name string")
    rows = {r.sample_id: r for r in tabular.parse_capture_names(df).collect()}
    assert set(rows) == {"user3-1-2-4-r5", "user3-1-2-3-4-r6"}
    five, six = rows["user3-1-2-4-r5"], rows["user3-1-2-3-4-r6"]
    assert (five.user_id, five.gesture_id, five.orientation, five.trial, five.rx_id) == (3, 1, 2, 4, 5)
    assert (six.location_id, six.orientation_id, six.repeat_id, six.rx_id, six.trial) == (2, 3, 4, 6, None)


def test_capture_problems_from_heads(spark, tmp_path):
    (tmp_path / "ok").write_bytes(struct.pack(">HB", 4, 0xBB) + b"abc")
    (tmp_path / "short").write_bytes(b"\0\4")
    (tmp_path / "code").write_bytes(struct.pack(">HB", 4, 0xAA) + b"abc")
    (tmp_path / "cut").write_bytes(struct.pack(">HB", 9, 0xBB) + b"abc")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "empty").write_bytes(b"")
    listing = tabular.read_heads(spark, str(tmp_path)).withColumn(
        "path", F.element_at(F.split("path", "/"), -1)
    )
    names = ["ok", "short", "code", "cut", "empty", "absent"]
    manifest = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.reason for r in audit.capture_problems(manifest, listing).collect()}
    assert got == {"ok": None, "short": "too_short", "code": "bad_code", "cut": "incomplete_packet", "empty": "too_short", "absent": "missing"}


def test_binding_rules(spark):
    df = spark.createDataFrame([(1, True, "x")], "a int, flag boolean, other string")
    out = audit.apply_binding(df, [audit.Binding("a", "alpha", scale=2.0)], keep_unmapped=True)
    assert out.columns == ["alpha", "flag", "other"] and out.first().alpha == 2.0
    with pytest.raises(ValueError, match="boolean"):
        audit.apply_binding(df, [audit.Binding("flag", "f", scale=2.0)])
    with pytest.raises(ValueError, match="one canonical"):
        audit.apply_binding(df, [audit.Binding("a", "z"), audit.Binding("flag", "z")])


def test_dominant_shape_tie(spark):
    rows = [("c", 1, 4), ("c", 2, 2), ("c", 1, 4), ("c", 2, 2), ("d", 1, 1)]
    df = spark.createDataFrame(rows, "capture string, tx int, rx int")
    got = {(r.capture, r.tx, r.rx, r.dropped) for r in audit.dominant_shape(df, "capture", ["tx", "rx"]).collect()}
    assert got == {("c", 2, 2, 2), ("d", 1, 1, 0)}
    assert audit.mixed_shapes(df, "capture", ["tx", "rx"]).count() == 2


def test_digest_ignores_order_and_layout(spark):
    df = spark.createDataFrame([(i % 7, f"n{i}") for i in range(100)], "a int, b string")
    one = artifacts.dataset_digest(df).first()
    two = artifacts.dataset_digest(df.select("b", "a").orderBy(F.desc("b")).repartition(9)).first()
    assert one == two
    changed = artifacts.dataset_digest(df.withColumn("a", F.when(F.col("b") == "n3", 9).otherwise(F.col("a")))).first()
    assert changed.digest != one.digest


def test_report_text():
    text = artifacts.markdown_report({"run_id": "r1"}, {"accuracy": 0.5}, protocol={"name": "classification"})
    assert text.startswith("# Benchmark Report") and "- accuracy: 0.5" in text and "## Protocol" in text
