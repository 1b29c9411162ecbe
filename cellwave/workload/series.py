"""CSI, UWB, BLE and frame-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.functions.columns import seconds
from cellwave.model import KEY, Signal
from cellwave.operators import normalize, ordinal, series, splits
from cellwave.workload.registry import query
from cellwave.workload.views import complex_signal, complex_sql, long_signal, real_signal, real_sql, rounded, sample_table

TSR = dict(time=4, subc=4, rx=2)

EVENT_SERIES_SQL = """e AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS time, value, event_type, event_id FROM events)"""


def event_series(t) -> Signal:
    """Event values per user in time order; quarter-hour buckets keep a hot user splittable."""
    rows = t.events.select(F.col("user_id").alias(KEY), seconds("ts").alias("_ts"), "value", "event_id", "event_type")
    numbered = ordinal.bucketed_ordinal(rows, [KEY], ["_ts"], F.floor(F.col("_ts") / 900), "time")
    return Signal(numbered, ("time",))


def hampel_sql(half: int, source: str, keys: str, out: str, mag: str, cell: str, axis: str) -> str:
    return f"""w AS (SELECT *, {mag} AS mag, list({cell}) OVER (PARTITION BY {keys} ORDER BY {axis} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS l FROM {source}),
 s AS (SELECT *, list_sort(l) AS q, len(l) AS n FROM w),
 m AS (SELECT *, q[(n + 1) // 2].mag AS med FROM s),
 d AS (SELECT *, list_sort(list_transform(q, lambda x: abs(x.mag - med)))[(n + 1) // 2] AS mad FROM m)"""


@query("hampel_filter", f"""WITH {EVENT_SERIES_SQL},
 {hampel_sql(5, 'e', 'sample_id', '', 'abs(value)', "{'mag': abs(value), 'value': value}", 'time')}
SELECT sample_id, time, round(CASE WHEN abs(mag - med) > 3.0 * 1.4826 * mad THEN q[n // 2 + 1].value ELSE value END, 6) AS value FROM d""")
def _(t):
    return rounded(series.hampel_filter(event_series(t), "time", 11, 3.0, chunk=32))


@query("hampel_filter_complex", f"""WITH {complex_sql(time=16, rx=2)},
 {hampel_sql(2, 'c', 'sample_id, rx', '', 'sqrt(re * re + im * im)', "{'mag': sqrt(re * re + im * im), 're': re, 'im': im}", 'time')}
SELECT sample_id, time, rx, round(CASE WHEN abs(mag - med) > 1.0 * 1.4826 * mad THEN q[n // 2 + 1].re ELSE re END, 6) + 0.0 AS re,
 round(CASE WHEN abs(mag - med) > 1.0 * 1.4826 * mad THEN q[n // 2 + 1].im ELSE im END, 6) + 0.0 AS im FROM d""")
def _(t):
    return rounded(series.hampel_filter(complex_signal(t, time=16, rx=2), "time", 5, 1.0))


UNWRAP_SQL = """p AS (SELECT *, {phase} AS ph FROM {source}),
 s AS (SELECT *, ph - lag(ph) OVER w AS st FROM p WINDOW w AS (PARTITION BY {keys} ORDER BY {axis})),
 f AS (SELECT *, (st + pi()) - floor((st + pi()) / (2 * pi())) * 2 * pi() - pi() AS fo FROM s),
 u AS (SELECT *, ph + sum(coalesce(CASE WHEN fo = -pi() AND st > 0 THEN pi() ELSE fo END - st, 0)) OVER (PARTITION BY {keys} ORDER BY {axis}) AS un FROM f)"""


@query("phase_unwrap", f"""WITH {complex_sql(subc=16, rx=2)}, {UNWRAP_SQL.format(phase='atan2(im, re)', source='c', keys='sample_id, rx', axis='subc')}
SELECT sample_id, subc, rx, round(un, 6) + 0.0 AS value FROM u""")
def _(t):
    return rounded(series.phase_unwrap(complex_signal(t, subc=16, rx=2), "subc"))


@query("phase_unwrap_time", f"""WITH {EVENT_SERIES_SQL}, {UNWRAP_SQL.format(phase='value', source='e', keys='sample_id', axis='time')}
SELECT sample_id, time, round(un, 5) + 0.0 AS value FROM u""")
def _(t):
    return rounded(series.phase_unwrap(event_series(t), "time", chunk=16), 5)


@query("phase_calibration", f"""WITH {complex_sql(subc=16, rx=2)}, {UNWRAP_SQL.format(phase='atan2(im, re)', source='c', keys='sample_id, rx', axis='subc')},
 g AS (SELECT sample_id, rx, regr_slope(un, subc) AS a, regr_intercept(un, subc) AS b FROM u GROUP BY 1, 2)
SELECT sample_id, subc, rx, round(re * cos(a * subc + b) + im * sin(a * subc + b), 6) + 0.0 AS re,
 round(im * cos(a * subc + b) - re * sin(a * subc + b), 6) + 0.0 AS im FROM c JOIN g USING (sample_id, rx)""")
def _(t):
    return rounded(series.phase_calibration(complex_signal(t, subc=16, rx=2)))


@query("csi_ratio", f"""WITH {complex_sql(**TSR)}
SELECT a.sample_id, a.time, a.subc, round((a.re * b.re + a.im * b.im) / (b.re * b.re + b.im * b.im), 4) + 0.0 AS re,
 round((a.im * b.re - a.re * b.im) / (b.re * b.re + b.im * b.im), 4) + 0.0 AS im
FROM c a JOIN c b USING (sample_id, time, subc) WHERE a.rx = 0 AND b.rx = 1""")
def _(t):
    return rounded(series.csi_ratio(complex_signal(t, **TSR), 0, 1), 4)


@query("adjacent_rx_conjugate", f"""WITH {complex_sql(time=2, subc=4, rx=4)}
SELECT a.sample_id, a.time, a.subc, a.rx, round(a.re * b.re + a.im * b.im, 6) + 0.0 AS re, round(a.im * b.re - a.re * b.im, 6) + 0.0 AS im
FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.time = b.time AND a.subc = b.subc AND b.rx = (a.rx + 1) % 4""")
def _(t):
    return rounded(series.adjacent_rx_conjugate(complex_signal(t, time=2, subc=4, rx=4)))


@query("adjacent_rx_conjugate_pair", f"""WITH {complex_sql(**TSR)}
SELECT a.sample_id, a.time, a.subc, a.rx, round(a.re * b.re + a.im * b.im, 6) + 0.0 AS re, round(a.im * b.re - a.re * b.im, 6) + 0.0 AS im
FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.time = b.time AND a.subc = b.subc AND a.rx = 0 AND b.rx = 1""")
def _(t):
    return rounded(series.adjacent_rx_conjugate(complex_signal(t, **TSR)))


@query("reference_rx_conjugate", f"""WITH {complex_sql(**TSR)}
SELECT a.sample_id, a.time, a.subc AS conj_subc, a.rx, round(a.re * b.re + a.im * b.im, 6) + 0.0 AS re, round(a.im * b.re - a.re * b.im, 6) + 0.0 AS im
FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.time = b.time AND a.subc = b.subc AND b.rx = 1""")
def _(t):
    return rounded(series.reference_rx_conjugate(complex_signal(t, **TSR), 1))


FILTER = dict(sample_rate=1000, lowpass_hz=60.0, highpass_hz=2.0, lowpass_order=4, highpass_order=3)


@query("temporal_filter")
def _(t):
    return rounded(series.temporal_filter(complex_signal(t, time=32), **FILTER))


@query("wifi_preprocess")
def _(t):
    args = {"lowpass_hz": 60.0, "highpass_hz": 2.0, "lowpass_order": 6, "highpass_order": 3}
    return rounded(series.wifi_preprocess(long_signal(t), ["reader1"], sample_rate=1000, **args))


# weights of subcarriers 0, 5, 6 and 15 of 16 from their known neighbours
LINEAR_SQL = "w(t, s, w) AS (VALUES (0, 1, 2.0), (0, 2, -1.0), (5, 4, 2 / 3.0), (5, 7, 1 / 3.0), (6, 4, 1 / 3.0), (6, 7, 2 / 3.0), (15, 13, -1.0), (15, 14, 2.0))"


@query("pilot_interpolate", f"""WITH {LINEAR_SQL}
SELECT vec_id AS sample_id, q.time, CAST(t AS BIGINT) AS subc, round(sum(w * CAST(embedding[16 * q.time + s + 1] AS DOUBLE)), 6) + 0.0 AS value
FROM embeddings, range(4) q(time), w GROUP BY 1, 2, 3
UNION ALL SELECT vec_id, q.time, k.subc, round(CAST(embedding[16 * q.time + k.subc + 1] AS DOUBLE), 6) + 0.0
FROM embeddings, range(4) q(time), range(16) k(subc) WHERE k.subc NOT IN (0, 5, 6, 15)""")
def _(t):
    return rounded(series.pilot_interpolate(real_signal(t, time=4, subc=16), [0, 5, 6, 15], 16))


@query("pilot_interpolate_complex", f"""WITH {complex_sql(rx=2, subc=16)}, {UNWRAP_SQL.format(phase='atan2(im, re)', source='c', keys='sample_id, rx', axis='subc')}, {LINEAR_SQL},
 i AS (SELECT sample_id, rx, t, sum(w * sqrt(re * re + im * im)) AS m, sum(w * un) AS p FROM u JOIN w ON s = subc GROUP BY 1, 2, 3)
SELECT sample_id, rx, CAST(t AS BIGINT) AS subc, round(m * cos(p), 6) + 0.0 AS re, round(m * sin(p), 6) + 0.0 AS im FROM i
UNION ALL SELECT sample_id, rx, subc, round(re, 6) + 0.0, round(im, 6) + 0.0 FROM c WHERE subc NOT IN (0, 5, 6, 15)""")
def _(t):
    return rounded(series.pilot_interpolate(complex_signal(t, rx=2, subc=16), [0, 5, 6, 15], 16))


EDGE_SQL = f"""{complex_sql(time=2, tap=16)}, x AS (SELECT *, re * re + im * im AS pw, max(re * re + im * im) OVER (PARTITION BY sample_id, time) AS pk FROM c),
 h AS (SELECT *, min(CASE WHEN pw >= 0.5 * pk THEN tap END) OVER (PARTITION BY sample_id, time) AS hit FROM x)"""


@query("leading_edge", f"""WITH {EDGE_SQL}
SELECT sample_id, time, tap, round(CASE WHEN tap >= hit THEN re ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN tap >= hit THEN im ELSE 0 END, 6) + 0.0 AS im FROM h""")
def _(t):
    return rounded(series.leading_edge(complex_signal(t, time=2, tap=16), 0.5))


@query("time_of_arrival", f"""WITH {EDGE_SQL}, g AS (SELECT sample_id, time, CAST(min(hit) AS BIGINT) AS tap_index FROM h GROUP BY 1, 2)
SELECT sample_id, time, tap_index, round(CASE WHEN sample_id % 7 <> 0 THEN tap_index / 2e7 * 1e9 END, 4) AS toa_ns,
 round(CASE WHEN sample_id % 7 <> 0 THEN 299792458.0 * (tap_index / 2e7) / 2 END, 4) AS range_m FROM g""")
def _(t):
    out = series.time_of_arrival(complex_signal(t, samples=sample_table(t), time=2, tap=16), 0.5)
    return out.select(
        KEY, "time", "tap_index", F.round(F.col("toa") * 1e9, 4).alias("toa_ns"), F.round("range_m", 4).alias("range_m")
    )


@query("channel_hop_reorder", f"""WITH {real_sql(channel=64)}, o AS (SELECT channel, CASE WHEN channel < 37 THEN (channel * 31) % 37 ELSE channel END AS place FROM range(64) r(channel))
SELECT sample_id, place AS channel, round(value, 6) + 0.0 AS value FROM c JOIN o USING (channel)""")
def _(t):
    return rounded(series.channel_hop_reorder(real_signal(t, channel=64)))


@query("extract_segments", f"""WITH {EVENT_SERIES_SQL},
 g AS (SELECT c_custkey % 150 AS sample_id, c_custkey AS segment, c_custkey % 40 AS a, c_custkey % 40 + c_nationkey - 2 AS b FROM customer)
SELECT e.sample_id, segment, time - a AS time, round(value, 6) AS value FROM e JOIN g ON e.sample_id = g.sample_id AND time >= a AND time < b""")
def _(t):
    notes = t.customer.select(
        (F.col("c_custkey") % 150).alias(KEY), F.col("c_custkey").alias("segment"),
        (F.col("c_custkey") % 40).alias("start"),
        (F.col("c_custkey") % 40 + F.col("c_nationkey") - 2).alias("end"),
    )
    return rounded(series.extract_segments(event_series(t), notes, span=16))


@query("frame_groups", f"""WITH {real_sql(frame=16, bin=4)}
SELECT c.sample_id, k AS frame, g AS "group", bin, round(value, 6) + 0.0 AS value
FROM range(16) a(k), range(8) b(g) JOIN c ON c.frame = greatest(0, least(15, k - 4 + g))""")
def _(t):
    return rounded(series.frame_groups(real_signal(t, frame=16, bin=4), 8))


@query("center_frames", f"""WITH {real_sql(proc_chirp=16, bin=4)} SELECT sample_id, proc_chirp - 6 AS frame, bin, round(value, 6) + 0.0 AS value FROM c WHERE proc_chirp BETWEEN 6 AND 9""")
def _(t):
    return rounded(series.center_frames(real_signal(t, proc_chirp=16, bin=4), 4))


@query("select_view_center_group", f"""WITH {real_sql(view=2, group=8, bin=4)} SELECT sample_id, bin, round(value, 6) + 0.0 AS value FROM c WHERE view = 1 AND "group" = 4""")
def _(t):
    sig = real_signal(t, view=2, group=8, bin=4)
    return rounded(series.center_group(series.select_view(sig, "vertical", {"horizontal": 0, "vertical": 1})))


@query("remove_static_clutter", f"""WITH {complex_sql(chirp=8, adc=4)}
SELECT sample_id, chirp, adc, round(re - avg(re) OVER w, 6) + 0.0 AS re, round(im - avg(im) OVER w, 6) + 0.0 AS im FROM c WINDOW w AS (PARTITION BY sample_id, adc)""")
def _(t):
    return rounded(series.remove_static_clutter(complex_signal(t, chirp=8, adc=4)))


FLAGSHIP_SQL = f"""WITH {EVENT_SERIES_SQL},
 k AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('41|' || event_id), event_id) - 1 AS o, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 cut AS (SELECT event_id, CASE WHEN n = 1 OR o < greatest(1, least(n - 1, round_even(n * 0.8, 0))) THEN 'train' ELSE 'val' END AS split FROM k),
 {hampel_sql(5, 'e', 'sample_id', '', 'abs(value)', "{'mag': abs(value), 'value': value}", 'time')},
 h AS (SELECT sample_id, time, event_id, event_type, CASE WHEN abs(mag - med) > 3.0 * 1.4826 * mad THEN q[n // 2 + 1].value ELSE value END AS value FROM d),
 r AS (SELECT sample_id, min(value) AS lo, max(value) AS hi FROM h GROUP BY 1)
SELECT split, event_type, CAST(count(*) AS BIGINT) AS n, round(avg((value - lo) / (hi - lo + 1e-8)), 6) AS mean_value
FROM h JOIN r USING (sample_id) JOIN cut USING (event_id) GROUP BY 1, 2"""


@query("clean_and_split", FLAGSHIP_SQL)
def clean_and_split(t):
    """Stratified split of the events, Hampel and min-max per user, split summary."""
    raw = event_series(t)
    clean = normalize.minmax(series.hampel_filter(raw, "time", 11, 3.0))
    manifest = splits.stratified_train_val(
        t.events.select(F.col("event_id").alias(KEY), F.col("event_type").alias("label")), "label", 0.8, 41
    ).withColumnRenamed(KEY, "event_id")
    ids = raw.cells.select(KEY, "time", "event_id")
    joined = clean.cells.join(ids, on=[KEY, "time"]).join(manifest, on="event_id")
    return joined.groupBy("split", F.col("label").alias("event_type")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    )
