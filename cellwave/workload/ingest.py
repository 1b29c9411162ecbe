"""Source, packet-stream and audit queries on data Spark derives from the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cellwave.functions.columns import seconds
from cellwave.model import KEY
from cellwave.operators import audit
from cellwave.operators.ordinal import shared_folder
from cellwave.sources import binary, tabular
from cellwave.workload.elementwise import lineitem_signal
from cellwave.workload.registry import query
from cellwave.workload.views import sample_table

DAY = 86400


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{t.spark.sparkContext.applicationId}"


def int16(value):
    """Little-endian hex of a 16-bit integer column."""
    text = F.lpad(F.hex(value.cast("bigint").bitwiseAND(65535)), 4, "0")
    return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))


def int32(value, big: bool = False):
    text = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    if big:
        return text
    return F.concat(*(F.substring(text, i, 2) for i in (7, 5, 3, 1)))


def scaled_ints(name: str = "embedding"):
    return F.transform(name, lambda v: F.round(v.cast("double") * 1000).cast("int"))


INTS_SQL = "i AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 1000) AS INT)) AS v FROM embeddings)"


def joined_hex(array):
    return F.array_join(F.transform(array, int16), "")


@query("csv_csi_packets", f"""WITH {INTS_SQL}
SELECT vec_id AS id, k AS subc, CAST(v[(2 * k) % 64 + 1] AS DOUBLE) AS re, CAST(v[(2 * k + 1) % 64 + 1] AS DOUBLE) AS im
FROM i, range(64) q(k) WHERE vec_id % 5 < 3""")
def _(t):
    ints = scaled_ints()
    payload = F.to_json(F.concat(ints, ints))
    kind = F.col("vec_id") % 5
    rows = t.embeddings.select(
        F.when(kind == 3, "OTHER").otherwise("CSI_DATA").alias("type"),
        F.col("vec_id").alias("id"), F.lit("aa:bb").alias("mac"), F.lit(-40).alias("rssi"),
        F.lit(6).alias("channel"), (F.col("vec_id") * 1000).alias("local_timestamp"),
        F.when(kind == 4, F.lit("[1, 2")).otherwise(payload).alias("data"),
    )
    path = folder(t, "csi-csv")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    packets = tabular.parse_csv_csi(tabular.read_csv_csi(t.spark, path))
    cells = packets.select(F.col("id").cast("bigint").alias("id"), F.posexplode(F.arrays_zip("re", "im")).alias("subc", "c"))
    return cells.select("id", F.col("subc").cast("bigint").alias("subc"), "c.re", "c.im")


@query("csv_csi_problems", """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'invalid_json' WHEN vec_id % 3 = 1 THEN 'unknown_length' ELSE 'too_few_values' END AS reason FROM embeddings""")
def _(t):
    kind = F.col("vec_id") % 3
    ints = scaled_ints()
    short = F.slice(F.concat(ints, ints), 1, 106)
    raw = t.embeddings.select(
        F.lit("CSI_DATA").alias("type"), F.col("vec_id").alias("id"), F.lit(6).alias("channel"),
        F.when(kind == 0, F.lit("[1, 2")).when(kind == 1, F.to_json(ints)).otherwise(F.to_json(short)).alias("data"),
    )
    return tabular.csv_csi_problems(raw).select("id", "reason")


def packet_hex():
    """Two packets of 16 complex values for each embedding, shapes by id; one spare byte 10 ends a packet's data.

    The second packet of every fourth file is (tx 1, rx 2, subc 8), the other
    packets are (tx 2, rx 2, subc 4).
    """
    odd = F.col("vec_id") % 4 == 0

    def packet(index: int, n_tx, n_subc):
        stamp = F.concat(
            F.hex(F.encode((F.col("vec_id") * 10 + index).cast("string"), "UTF-8")), F.repeat(F.lit("00"), F.lit(19))
        )
        header = F.concat(
            int32(F.lit(64)), F.repeat(F.lit("00"), F.lit(4)), int32(F.lit(7)), F.repeat(F.lit("00"), F.lit(34)),
            F.lit("02"), F.lpad(F.hex(n_tx), 2, "0"), F.repeat(F.lit("00"), F.lit(2)), F.lit("01"), F.lit("00"),
            int32(n_subc), F.repeat(F.lit("00"), F.lit(4)), int32(F.lit(50)), int32(F.lit(60)),
            F.lit("AABBCCDDEEFF"), F.repeat(F.lit("00"), F.lit(2)), F.lpad(F.hex(F.lit(index)), 2, "0"),
            F.repeat(F.lit("00"), F.lit(11)), int32(F.col("vec_id")), int32(F.lit(9)),
        )
        size = binary.PACKET_HEADER.size
        lengths = F.concat(int32(F.lit(size), True), int32(F.lit(0), True), int32(F.lit(65), True))
        data = F.concat(joined_hex(F.slice(scaled_ints(), 32 * index + 1, 32)), F.lit("0A"))
        return F.concat(F.substring(stamp, 1, 38), lengths, header, data)

    return packet(0, F.lit(2), F.lit(4)), packet(1, F.when(odd, 1).otherwise(2), F.when(odd, 8).otherwise(4))


def packet_files(t):
    """One file per embedding, two packets in each."""
    first, second = packet_hex()
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("path"), F.unhex(F.concat(first, second)).alias("content")
    )


PACKETS_SQL = f"""{INTS_SQL},
 p AS (SELECT vec_id, k AS packet_idx, CASE WHEN k = 1 AND vec_id % 4 = 0 THEN 1 ELSE 2 END AS n_tx, 2 AS n_rx,
   CASE WHEN k = 1 AND vec_id % 4 = 0 THEN 8 ELSE 4 END AS n_subc, v FROM i, range(2) q(k))"""


@query("framed_packets", f"""WITH {PACKETS_SQL}
SELECT CAST(vec_id AS VARCHAR) AS path, packet_idx, vec_id * 10 + packet_idx AS ts_ns, n_tx, n_rx, n_subc, 50 AS rssi_a, 60 AS rssi_b,
 'aa:bb:cc:dd:ee:ff' AS mac_src, packet_idx AS seq FROM p""")
def _(t):
    packets = binary.decode_files(packet_files(t), binary.PACKETS, binary.parse_packet, binary.PACKET_SCHEMA)
    return packets.select(
        "path", "packet_idx", "ts_ns", "n_tx", "n_rx", "n_subc", "rssi_a", "rssi_b", "mac_src", "seq"
    )


@query("packet_cells", f"""WITH {PACKETS_SQL},
 x AS (SELECT *, (t.tx * n_rx + r.rx) * n_subc + s.subc AS j FROM p, range(2) t(tx), range(2) r(rx), range(8) s(subc) WHERE tx < n_tx AND rx < n_rx AND subc < n_subc)
SELECT CAST(vec_id AS VARCHAR) AS path, packet_idx, subc, tx, rx, CAST(v[32 * packet_idx + 2 * j + 1] AS DOUBLE) AS re, CAST(v[32 * packet_idx + 2 * j + 2] AS DOUBLE) AS im FROM x""")
def _(t):
    packets = binary.decode_files(packet_files(t), binary.PACKETS, binary.parse_packet, binary.PACKET_SCHEMA)
    return binary.packet_cells(packets, ["path", "packet_idx"])


def written_captures(t, name: str, records) -> str:
    """Files of 64 embeddings each, of the given hex records one after another; each record ends in a byte 10.

    Spark's text writer puts that byte after a line, so lines without it make the very bytes.
    """
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 64).alias("capture"), "vec_id", F.posexplode(F.array(*records)).alias("k", "hex"))
    line = F.unhex(F.substring("hex", F.lit(1), F.length("hex") - 2)).cast("string")
    rows = rows.repartition("capture").sortWithinPartitions("capture", "vec_id", "k").select(line.alias("value"), "capture")
    path = folder(t, name)
    rows.write.mode("overwrite").partitionBy("capture").text(path)
    return path


def capture_of(column: str = "path"):
    return F.regexp_extract(column, "capture=([0-9]+)", 1).cast("bigint").alias("capture")


@query("packet_captures", f"""WITH {PACKETS_SQL}
SELECT vec_id // 64 AS capture, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id, packet_idx) - 1 AS packet_idx,
 vec_id * 10 + packet_idx AS ts_ns, n_tx, n_rx, n_subc, packet_idx AS seq,
 CAST(list_sum(list_transform(range(16), lambda j: v[32 * packet_idx + 2 * j + 1] * CASE WHEN n_tx = 2 THEN 1 ELSE 2 END)) AS DOUBLE) AS re_sum FROM p""")
def _(t):
    path = written_captures(t, "packet-captures", packet_hex())
    packets = binary.read_packets(t.spark, path, block_bytes=4096)
    total = F.aggregate("re", F.lit(0.0), lambda a, x: a + x) * F.when(F.col("n_tx") == 2, 1).otherwise(2)
    return packets.select(capture_of(), "packet_idx", "ts_ns", "n_tx", "n_rx", "n_subc", "seq", total.alias("re_sum"))


@query("pcap_captures", f"""WITH {INTS_SQL}
SELECT vec_id // 64 AS capture, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id, k) - 1 AS frame_idx, vec_id + 0.25 AS ts,
 CAST(33 AS BIGINT) AS incl_len, v[16 * k + 1] & 255 AS first_byte, 10 AS last_byte FROM i, range(4) q(k)""")
def _(t):
    # the first frame of a capture follows the file header
    ints, begins = scaled_ints(), F.when(F.col("vec_id") % 64 == 0, F.repeat(F.lit("00"), F.lit(24))).otherwise(F.lit(""))
    head = F.concat(int32(F.col("vec_id")), int32(F.lit(250000)), int32(F.lit(33)), int32(F.lit(33)))
    frames = [F.concat(head, joined_hex(F.slice(ints, 16 * k + 1, 16)), F.lit("0A")) for k in range(4)]
    path = written_captures(t, "pcap-captures", [F.concat(begins, frames[0]), *frames[1:]])
    frames = binary.read_pcap(t.spark, path, block_bytes=4096)

    def byte(at: int):
        return F.conv(F.hex(F.substring("payload", at, 1)), 16, 10).cast("bigint")

    return frames.select(capture_of(), "frame_idx", "ts", "incl_len", byte(1).alias("first_byte"), byte(33).alias("last_byte"))


@query("radar_captures", f"""WITH {INTS_SQL}, w AS (SELECT vec_id, list_concat(v[1:63], [2560 + (v[64] & 255)]) AS v FROM i),
 x AS (SELECT vec_id, chirp, adc, tx * 2 + rx AS ant, ((chirp * 2 + tx) * 4 + adc) * 4 + rx AS j, v FROM w, range(2) c(chirp), range(2) t(tx), range(4) a(adc), range(2) r(rx))
SELECT vec_id // 64 AS capture, vec_id % 64 AS record, chirp, adc, ant, CAST(v[j + 1] AS DOUBLE) AS re, CAST(v[j + 3] AS DOUBLE) AS im FROM x""")
def _(t):
    ints = scaled_ints()
    last = (F.get(ints, F.lit(63)).bitwiseAND(255) + 2560).cast("int")
    path = written_captures(t, "radar-captures", [joined_hex(F.concat(F.slice(ints, 1, 63), F.array(last)))])
    records = binary.read_fixed_records(t.spark, path, binary.radar_frame_bytes(2, 2, 2, 4), block_bytes=1000)
    records = records.select(capture_of(), "record", "content")
    return binary.decode_radar_frames(records, ["capture", "record"], num_chirps=2, num_tx=2, num_rx=2, num_adc=4)


def radar_records(t):
    return t.embeddings.select(F.col("vec_id").alias("record"), F.unhex(joined_hex(scaled_ints())).alias("content"))


@query("radar_frames", f"""WITH {INTS_SQL},
 x AS (SELECT vec_id, chirp, adc, tx * 2 + rx AS ant, ((chirp * 2 + tx) * 4 + adc) * 4 + rx AS j, v FROM i, range(2) c(chirp), range(2) t(tx), range(4) a(adc), range(2) r(rx))
SELECT vec_id AS frame, chirp, adc, ant, CAST(v[j + 1] AS DOUBLE) AS re, CAST(v[j + 3] AS DOUBLE) AS im FROM x""")
def _(t):
    frames = radar_records(t).withColumnRenamed("record", "frame")
    return binary.decode_radar_frames(frames, ["frame"], num_chirps=2, num_tx=2, num_rx=2, num_adc=4)


@query("lane_chirps", f"""WITH {INTS_SQL},
 x AS (SELECT vec_id, rx, adc, rx * 8 + adc AS s, v FROM i, range(4) r(rx), range(8) a(adc) WHERE vec_id >= 10)
SELECT vec_id - 10 AS chirp, rx, adc, CAST(v[4 * (s // 2) + s % 2 + 1] AS DOUBLE) AS re, CAST(v[4 * (s // 2) + s % 2 + 3] AS DOUBLE) AS im FROM x""")
def _(t):
    return binary.decode_lane_chirps(radar_records(t), [], num_adc=8, chirp_start=10)


@query("pcap_frames", f"""WITH {INTS_SQL}
SELECT CAST(vec_id AS VARCHAR) AS path, k AS frame_idx, vec_id + 0.25 AS ts, CAST(32 AS BIGINT) AS incl_len,
 CASE WHEN k < 3 THEN 32 ELSE 16 END AS n_set, v[16 * k + 1] & 255 AS first_byte FROM i, range(4) q(k)""")
def _(t):
    # the last frame announces 32 bytes but holds 16: it is zero-padded
    ints = scaled_ints()

    def frame(k: int, size: int):
        head = F.concat(int32(F.col("vec_id")), int32(F.lit(250000)), int32(F.lit(32)), int32(F.lit(32)))
        return F.concat(head, joined_hex(F.slice(ints, 16 * k + 1, size)))

    body = F.concat(F.repeat(F.lit("00"), F.lit(24)), *(frame(k, 16 if k < 3 else 8) for k in range(4)))
    files = t.embeddings.select(F.col("vec_id").cast("string").alias("path"), F.unhex(body).alias("content"))
    frames = binary.decode_files(files, binary.PCAP, binary.parse_pcap_frame, binary.PCAP_SCHEMA)
    # the padded half must be zero
    padding = F.when(F.hex(F.substring("payload", 17, 16)) == "0" * 32, 16).otherwise(32)
    return frames.select(
        "path", "frame_idx", "ts", "incl_len", padding.alias("n_set"),
        F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("bigint").alias("first_byte"),
    )


@query("delimited_metadata", """SELECT CAST(s_suppkey AS VARCHAR) AS file, s_name AS room, CAST(s_nationkey AS VARCHAR) AS "user" FROM supplier""")
def _(t):
    rows = t.supplier.select(
        F.concat(F.lit(" "), F.col("s_suppkey")).alias(" file "), F.concat(F.col("s_name"), F.lit("  ")).alias("room "),
        F.col("s_nationkey").alias(" user"),
    )
    path = folder(t, "metas")
    rows.write.mode("overwrite").option("header", True).option("sep", "|").csv(path)
    return tabular.read_delimited(t.spark, path, "|")


@query("gesture_metas", """SELECT CAST(s_suppkey AS VARCHAR) AS date, CAST(s_nationkey AS BIGINT) AS room, s_suppkey % 7 AS first_user, 3 AS n_users,
 'Sweep' || s_suppkey AS gesture_2, CAST(20 AS BIGINT) AS sample_num FROM supplier""")
def _(t):
    rows = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("file"), F.col("s_nationkey").cast("string").alias("room"),
        F.concat(F.lit("1: Push&Pull; 2: Sweep"), F.col("s_suppkey"), F.lit("; ")).alias("gesture_list"),
        F.concat(F.lit("User"), F.col("s_suppkey") % 7, F.lit(",8, 9")).alias("user"), F.lit("20").alias("sample_num"),
    )
    out = tabular.parse_gesture_metas(rows)
    return out.select(
        "date", "room", F.col("users")[0].alias("first_user"), F.size("users").alias("n_users"),
        F.col("gesture_map")[F.lit(2).cast("bigint")].alias("gesture_2"), "sample_num",
    )


@query("capture_names", """SELECT event_id, user_id, event_id % 6 AS gesture_id, event_id % 3 AS rx_id,
 CASE WHEN event_id % 4 = 0 THEN 'canonical' ELSE 'capture' END AS filename_variant,
 CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS orientation, CASE WHEN event_id % 4 = 1 THEN event_id % 9 END AS repeat_id
FROM events WHERE event_id % 4 IN (0, 1)""")
def _(t):
    e = F.col("event_id")
    head = F.concat(F.lit("d1/user"), F.col("user_id"), F.lit("-"), e % 6, F.lit("-"))
    tail = F.concat(F.lit("-r"), e % 3, F.lit(".dat"))
    name = (
        F.when(e % 4 == 0, F.concat(head, e % 5, F.lit("-2"), tail))
        .when(e % 4 == 1, F.concat(head, F.lit("1-2-"), e % 9, tail))
        .when(e % 4 == 2, F.concat(head, F.lit("x-2"), tail))
        .otherwise(F.concat(head, F.lit("readme")))
    )
    out = tabular.parse_capture_names(t.events.select("event_id", name.alias("name")))
    return out.select("event_id", "user_id", "gesture_id", "rx_id", "filename_variant", "orientation", "repeat_id")


@query("field_binding", """SELECT event_id AS seq, round(value * 1e-6, 9) AS timestamp_start, upper(event_type) AS device, user_id FROM events""")
def _(t):
    bindings = [
        audit.Binding("event_id", "seq"),
        audit.Binding("value", "timestamp_start", scale=1e-6),
        audit.Binding("event_type", "device", via=F.upper),
    ]
    out = audit.apply_binding(t.events, bindings, known=["user_id"])
    return out.withColumn("timestamp_start", F.round("timestamp_start", 9))


@query("capture_problems", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 OR octet_length(encode(text)) < 3 THEN 'too_short' WHEN doc_id % 5 = 2 THEN 'bad_code'
 WHEN octet_length(encode(text)) - 3 < 300 - 1 THEN 'incomplete_packet' END AS reason FROM documents""")
def _(t):
    kind = F.col("doc_id") % 5
    head = F.when(kind == 2, F.unhex(F.lit("012CAA"))).otherwise(F.unhex(F.lit("012CBB")))
    length = F.when(kind == 1, F.lit(2)).otherwise(F.octet_length("text"))
    # an id may be null or occur twice; each text is a file of its own
    name = F.to_json(F.struct("doc_id", F.sha2("text", 256).alias("text"))).alias("path")
    listing = t.documents.where(~kind.eqNullSafe(0)).select(name, length.cast("bigint").alias("length"), head.alias("head")).distinct()
    return audit.capture_problems(t.documents.select("doc_id", name), listing).select("doc_id", "reason")


@query("coordinate_length_problems", """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS sample_id, 'point' AS axis, n AS cells, CAST(4 AS BIGINT) AS coords FROM n WHERE n <> 4""")
def _(t):
    sig = lineitem_signal(t)
    ids = sig.cells.select(KEY).distinct()
    coords = ids.select(KEY, F.lit("point").alias("axis"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    return audit.coordinate_length_problems(sig.cells, coords, ["point"])


@query("metadata_problems", """SELECT vec_id AS sample_id, 'physical' AS kind, 'bandwidth' AS field FROM embeddings WHERE vec_id % 7 = 0
UNION ALL SELECT vec_id, 'physical', 'subcarrier_spacing' FROM embeddings WHERE vec_id % 11 = 0
UNION ALL SELECT vec_id, 'physical', 'chirp_period' FROM embeddings
UNION ALL SELECT vec_id, 'coord_unit', 'time' FROM embeddings WHERE vec_id % 2 = 1
UNION ALL SELECT vec_id, 'extra', 'antenna_positions' FROM embeddings WHERE vec_id % 3 <> 0""")
def _(t):
    extra = F.when(F.col(KEY) % 3 == 0, F.create_map(F.lit("antenna_positions"), F.lit("[]"))).otherwise(
        F.create_map(F.lit("note"), F.lit("x"))
    )
    samples = sample_table(t).withColumn("extra", extra)
    coords = samples.select(
        KEY, F.lit("time").alias("axis"), F.lit(0).alias("idx"), F.lit(0.0).alias("value"),
        F.when(F.col(KEY) % 2 == 0, "s").otherwise("ms").alias("unit"),
    )
    return audit.metadata_problems(
        samples, ("bandwidth", "subcarrier_spacing", "center_freq", "chirp_period"), {"time": "s"},
        ("antenna_positions",), coords,
    )


def packets(t):
    """Event stream as packets: the user's device is the capture."""
    return t.events.select(
        F.col("user_id").alias("capture"), F.col("event_id").alias("packet_idx"), seconds("ts").alias("ts"),
        F.col("event_type").alias("src_mac"), (F.col("event_id") % 3).alias("n_rx"), "value",
    )


TS_SQL = "p AS (SELECT user_id AS capture, event_id AS packet_idx, epoch_us(ts) / 1e6 AS ts, event_type AS src_mac, event_id % 3 AS n_rx, value FROM events)"


@query("merge_packets", f"""WITH {TS_SQL}
SELECT capture, packet_idx, row_number() OVER w - 1 AS time, round(ts - first(ts) OVER w, 6) AS time_s FROM p WINDOW w AS (PARTITION BY capture ORDER BY packet_idx)""")
def _(t):
    bucket = F.floor(F.col("packet_idx") / 4096)
    out = audit.merge_packets(packets(t), "capture", "packet_idx", "ts", bucket)
    return out.select("capture", "packet_idx", "time", F.round("time_s", 6).alias("time_s"))


@query("short_captures", "SELECT l_orderkey AS capture, CAST(count(*) AS BIGINT) AS packets FROM lineitem GROUP BY 1 HAVING count(*) < 2")
def _(t):
    return audit.short_captures(t.lineitem.select(F.col("l_orderkey").alias("capture")), "capture")


RATE_SQL = f"""{TS_SQL}, d AS (SELECT capture, ts - lag(ts) OVER (PARTITION BY capture ORDER BY packet_idx) AS d FROM p),
 r AS (SELECT capture, 1 / quantile_disc(d, 0.5) AS rate FROM d WHERE d > 0 GROUP BY 1)"""


def capture_rates(t):
    return audit.sample_rates(packets(t), "capture", "packet_idx", "ts", F.floor(F.col("packet_idx") / 512))


@query("sample_rates", f"WITH {RATE_SQL} SELECT DISTINCT capture, round(rate, 9) AS sample_rate FROM p LEFT JOIN r USING (capture)")
def _(t):
    return capture_rates(t).withColumn("sample_rate", F.round("sample_rate", 9))


@query("probe_sample_rate", f"WITH {RATE_SQL} SELECT round(avg(rate), 9) AS estimated_rate FROM r WHERE capture < 10")
def _(t):
    return audit.probe_sample_rate(capture_rates(t), "capture").withColumn(
        "estimated_rate", F.round("estimated_rate", 9)
    )


@query("resolved_sample_rates", f"""WITH {TS_SQL}, d AS (SELECT capture, ts - lag(ts) OVER (PARTITION BY capture ORDER BY packet_idx) AS d FROM p),
 r AS (SELECT capture, 1 / median(d) AS rate FROM d WHERE d > 0 GROUP BY 1)
SELECT DISTINCT p.capture AS sample_id, round(CASE p.capture % 4 WHEN 0 THEN 100.0 ELSE rate END, 9) AS sample_rate FROM p LEFT JOIN r USING (capture)""")
def _(t):
    rows = packets(t)
    coords = rows.select(
        F.col("capture").alias(KEY), F.lit("time").alias("axis"), F.col("packet_idx").alias("idx"), F.col("ts").alias("value")
    )
    kind = F.col("capture") % 4
    declared = F.when(kind == 0, F.lit(100.0)).when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(-5.0))
    samples = rows.select("capture").distinct().select(F.col("capture").alias(KEY), declared.alias("sample_rate"))
    out = audit.resolved_sample_rates(samples, coords, F.floor(F.col("idx") / 512))
    return out.withColumn("sample_rate", F.round("sample_rate", 9))


@query("select_packet_class", f"""WITH {TS_SQL}, f AS (SELECT capture, min_by(n_rx, packet_idx) AS n_rx FROM p WHERE src_mac = 'click' GROUP BY 1)
SELECT p.capture, packet_idx FROM p JOIN f ON p.capture = f.capture AND p.n_rx = f.n_rx WHERE src_mac = 'click'""")
def _(t):
    out = audit.select_packet_class(packets(t), "capture", "packet_idx", ["src_mac", "n_rx"], src_mac="click", n_rx=None)
    return out.select("capture", "packet_idx")


SHAPE_SQL = f"{TS_SQL}, s AS (SELECT capture, src_mac, n_rx, count(*) AS packets FROM p GROUP BY 1, 2, 3)"


@query("mixed_shapes", f"WITH {SHAPE_SQL} SELECT * FROM s WHERE capture IN (SELECT capture FROM s GROUP BY 1 HAVING count(*) > 1)")
def _(t):
    return audit.mixed_shapes(packets(t), "capture", ["src_mac", "n_rx"])


@query("dominant_shape", f"""WITH {SHAPE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY packets DESC, src_mac DESC, n_rx DESC) AS o, sum(packets) OVER (PARTITION BY capture) AS total FROM s)
SELECT capture, src_mac, n_rx, CAST(total - packets AS BIGINT) AS dropped FROM k WHERE o = 1""")
def _(t):
    return audit.dominant_shape(packets(t), "capture", ["src_mac", "n_rx"])


@query("keep_dominant_shape", f"""WITH {SHAPE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY packets DESC, src_mac DESC, n_rx DESC) AS o FROM s)
SELECT p.capture, packet_idx FROM p JOIN k ON p.capture = k.capture AND p.src_mac = k.src_mac AND p.n_rx = k.n_rx AND o = 1""")
def _(t):
    return audit.keep_dominant_shape(packets(t), "capture", ["src_mac", "n_rx"]).select("capture", "packet_idx")


def point_files(t):
    """Float64 frames packed from embeddings: 12 points of 5 values, every seventh frame empty."""
    @pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v[:60], dtype="<f8").tobytes() for v in values])

    empty = F.col("vec_id") % 7 == 0
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 10).alias("sample"), (F.col("vec_id") % 10).alias("frame"),
        F.when(empty, F.lit(b"")).otherwise(pack("embedding")).alias("content"),
    )


@query("point_frames", """SELECT vec_id // 10 AS sample, vec_id % 10 AS frame, k AS point, CAST(embedding[5 * k + 1] AS DOUBLE) AS f0, CAST(embedding[5 * k + 2] AS DOUBLE) AS f1,
 CAST(embedding[5 * k + 3] AS DOUBLE) AS f2, CAST(embedding[5 * k + 4] AS DOUBLE) AS f3, CAST(embedding[5 * k + 5] AS DOUBLE) AS f4 FROM embeddings, range(8) q(k) WHERE vec_id % 7 <> 0""")
def _(t):
    return binary.decode_point_frames(point_files(t), ["sample", "frame"], max_points=8)


@query("point_counts", "SELECT vec_id // 10 AS sample, vec_id % 10 AS frame, CAST(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 8 END AS BIGINT) AS points FROM embeddings")
def _(t):
    return binary.point_counts(point_files(t), ["sample", "frame"], max_points=8)
