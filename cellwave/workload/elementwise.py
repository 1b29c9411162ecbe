"""Element-wise and normaliser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.model import KEY, Signal
from cellwave.operators import normalize
from cellwave.operators.ordinal import bucketed_ordinal
from cellwave.workload.registry import query
from cellwave.workload.views import complex_signal, complex_sql, real_signal, real_sql, rounded, sample_table

TSR = dict(time=8, subc=2, rx=2)
TS = dict(time=16, subc=4)
ITEM_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
ITEMS_SQL = f"""c AS (SELECT l_orderkey AS sample_id,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) - 1 AS point, l_quantity AS value FROM lineitem)"""


def lineitem_signal(t) -> Signal:
    """Order lines as a ragged series; the bucket keeps a huge order splittable."""
    rows = t.lineitem.select(F.col("l_orderkey").alias(KEY), *ITEM_ORDER)
    bucket = F.col("l_linenumber") * (1 << 40) + F.floor(F.col("l_partkey") / 1024)
    numbered = bucketed_ordinal(rows, [KEY], ITEM_ORDER, bucket, "point")
    return Signal(numbered.select(KEY, "point", F.col("l_quantity").alias("value")), ("point",))


@query("magnitude", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, subc, rx, round(sqrt(re * re + im * im), 6) AS value FROM c""")
def _(t):
    return rounded(normalize.magnitude(complex_signal(t, **TSR)))


@query("amplitude_phase", f"""WITH {complex_sql(**TSR)}
SELECT sample_id, time, subc, rx, f AS feature, round(CASE f WHEN 0 THEN sqrt(re * re + im * im) ELSE atan2(im, re) END, 6) + 0.0 AS value
FROM c, range(2) q(f)""")
def _(t):
    return rounded(normalize.amplitude_phase(complex_signal(t, **TSR)))


@query("minmax", f"""WITH {ITEMS_SQL}, s AS (SELECT sample_id, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1)
SELECT sample_id, point, round((value - lo) / (hi - lo + 1e-8) * 2 - 1, 6) + 0.0 AS value FROM c JOIN s USING (sample_id)""")
def _(t):
    return rounded(normalize.normalize(lineitem_signal(t), "minmax", (-1.0, 1.0)))


@query("zscore_real", f"""WITH {ITEMS_SQL}, s AS (SELECT sample_id, avg(value) AS m, stddev_samp(value) AS d FROM c GROUP BY 1)
SELECT sample_id, point, round((value - m) / (CASE WHEN d IS NOT NULL THEN greatest(d, 1e-8) END), 5) + 0.0 AS value FROM c JOIN s USING (sample_id)""")
def _(t):
    return rounded(normalize.normalize(lineitem_signal(t), "zscore"), 5)


@query("zscore_complex", f"""WITH {complex_sql(**TSR)},
 s AS (SELECT sample_id, avg(re) AS mr, avg(im) AS mi FROM c GROUP BY 1),
 d AS (SELECT sample_id, sqrt(sum((re - mr) * (re - mr) + (im - mi) * (im - mi)) / (count(*) - 1)) AS d FROM c JOIN s USING (sample_id) GROUP BY 1)
SELECT sample_id, time, subc, rx, round((re - mr) / d, 5) + 0.0 AS re, round((im - mi) / d, 5) + 0.0 AS im FROM c JOIN s USING (sample_id) JOIN d USING (sample_id)""")
def _(t):
    return rounded(normalize.zscore(complex_signal(t, **TSR)), 5)


@query("l2", f"""WITH {ITEMS_SQL} SELECT sample_id, point, round(value / greatest(sqrt(sum(value * value) OVER (PARTITION BY sample_id)), 1e-8), 6) AS value FROM c""")
def _(t):
    return rounded(normalize.normalize(lineitem_signal(t), "l2"))


@query("axis_l2", f"""WITH {complex_sql(**TSR)}, n AS (SELECT *, greatest(sqrt(sum(re * re + im * im) OVER (PARTITION BY sample_id, time, rx)), 1e-8) AS n FROM c)
SELECT sample_id, time, subc, rx, round(re / n, 6) + 0.0 AS re, round(im / n, 6) + 0.0 AS im FROM n""")
def _(t):
    return rounded(normalize.axis_normalize(complex_signal(t, **TSR), "subc", "l2"))


@query("axis_zscore", f"""WITH {real_sql(**TS)}, n AS (SELECT *, avg(value) OVER w AS m, greatest(stddev_samp(value) OVER w, 1e-8) AS d FROM c WINDOW w AS (PARTITION BY sample_id, subc))
SELECT sample_id, time, subc, round((value - m) / d, 5) + 0.0 AS value FROM n""")
def _(t):
    return rounded(normalize.axis_normalize(real_signal(t, **TS), "time", "zscore"), 5)


@query("sample_zscore", f"""WITH {real_sql(time=8, subc=4, rx=2)}, n AS (SELECT *, avg(value) OVER w AS m, greatest(stddev_samp(value) OVER w, 1e-8) AS d FROM c WINDOW w AS (PARTITION BY sample_id, rx))
SELECT sample_id, time, subc, rx, round((value - m) / d, 5) + 0.0 AS value FROM n""")
def _(t):
    return rounded(normalize.sample_zscore(real_signal(t, time=8, subc=4, rx=2), ["rx"]), 5)


@query("subcarrier_l1", f"""WITH {complex_sql(time=4, subc=4, rx=2)}, n AS (SELECT *, CASE WHEN sample_id % 3 = 1 THEN 1 ELSE sum(sqrt(re * re + im * im)) OVER (PARTITION BY sample_id, time, rx) END AS n FROM c)
SELECT sample_id, time, subc, rx, round(re / n, 6) + 0.0 AS re, round(im / n, 6) + 0.0 AS im FROM n""")
def _(t):
    sig = complex_signal(t, samples=sample_table(t), time=4, subc=4, rx=2)
    return rounded(normalize.subcarrier_l1(sig, skip_reader_ids=["reader1"]))


@query("spatial_channels", f"""WITH {real_sql(channel=2, h=4, w=8)},
 a AS (SELECT *, value - min(value) OVER (PARTITION BY sample_id, channel) AS z FROM c),
 b AS (SELECT *, z / greatest(max(z) OVER (PARTITION BY sample_id, channel), 1e-8) AS u FROM a)
SELECT sample_id, channel, h, w, round((u - avg(u) OVER p) / greatest(stddev_samp(u) OVER p, 1e-8), 5) + 0.0 AS value FROM b WINDOW p AS (PARTITION BY sample_id, channel)""")
def _(t):
    return rounded(normalize.spatial_channels(real_signal(t, channel=2, h=4, w=8)), 5)


@query("rssi_normalize", """SELECT user_id AS sample_id, event_id AS time, round(greatest(0, least(1, (-value + 100) / 90)), 6) + 0.0 AS value FROM events""")
def _(t):
    cells = t.events.select(F.col("user_id").alias(KEY), F.col("event_id").alias("time"), (-F.col("value")).alias("value"))
    return rounded(normalize.rssi_normalize(Signal(cells, ("time",)), -100.0, -10.0))


@query("cir_normalize", f"""WITH {complex_sql(time=2, tap=16)}, n AS (SELECT *, greatest(max(sqrt(re * re + im * im)) OVER (PARTITION BY sample_id, time), 1e-12) AS n FROM c)
SELECT sample_id, time, tap, round(re / n, 6) + 0.0 AS re, round(im / n, 6) + 0.0 AS im FROM n""")
def _(t):
    return rounded(normalize.cir_normalize(complex_signal(t, time=2, tap=16)))


@query("split_complex", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, subc, rx, CAST(k AS BIGINT) AS ri, round(CASE k WHEN 0 THEN re ELSE im END, 6) + 0.0 AS value FROM c, range(2) q(k)""")
def _(t):
    return rounded(normalize.split_complex(complex_signal(t, **TSR)))


@query("polar_projection", f"""WITH {real_sql(time_bin=4, freq_bin=4, subc=2, link=2)},
 p AS (SELECT *, (((link * 10 + subc * 3) * 4 + freq_bin) * 4 + time_bin) * pi() / 479 AS ph FROM c)
SELECT sample_id, time_bin, freq_bin, subc, link, round(abs(value) * cos(ph), 6) + 0.0 AS re, round(abs(value) * sin(ph), 6) + 0.0 AS im FROM p""")
def _(t):
    sig = real_signal(t, time_bin=4, freq_bin=4, subc=2, link=2).with_parts(value=F.abs("value"))
    totals = {"link": 3, "subcarrier": 10, "freq": 4, "time": 4}
    return rounded(normalize.polar_projection(sig, totals, {"subcarrier": [0, 3]}))


@query("convert_subcarriers", """WITH s AS (SELECT vec_id, j, 5.18e9 + (vec_id % 4) * 6e5 AS cf, CASE WHEN vec_id % 11 <> 0 THEN 312500.0 END AS sp FROM embeddings, range(-4, 5) r(j))
SELECT vec_id AS sample_id, CAST(j AS BIGINT) AS idx, round(j * sp / 1e6, 6) AS offset_mhz, round((cf + j * sp) / 1e6, 6) AS freq_mhz,
 round((cf + j * sp - cf) / sp, 4) + 0.0 AS back FROM s""")
def _(t):
    steps = F.sequence(F.lit(-4).cast("bigint"), F.lit(4).cast("bigint"))
    rows = sample_table(t).withColumn("idx", F.explode(steps))
    spacing, center = F.col("subcarrier_spacing"), F.col("center_freq")
    mhz = normalize.convert_subcarriers(F.col("idx"), "index", "freq_mhz", spacing, center)
    hz = normalize.convert_subcarriers(F.col("idx"), "index", "freq_hz", spacing, center)
    return rows.select(
        KEY, "idx",
        F.round(normalize.convert_subcarriers(F.col("idx"), "", "MHz", spacing, center), 6).alias("offset_mhz"),
        F.round(mhz, 6).alias("freq_mhz"),
        (F.round(normalize.convert_subcarriers(hz, "freq_hz", "index", spacing, center), 4) + F.lit(0.0)).alias("back"),
    )


@query("wifi_profile", """SELECT p_partkey AS sample_id,
 CAST(CASE WHEN p_size % 2 = 0 AND 3 - p_size // 2 >= 0 THEN 4 - p_size // 2 ELSE 3 - p_size // 2 END AS BIGINT) AS subcarrier,
 CASE WHEN p_size = 14 THEN 2484e6 WHEN p_size <= 13 THEN (2407 + 5 * p_size) * 1e6 WHEN p_size IN (36, 40, 44, 48) THEN (5000 + 5 * p_size) * 1e6 END AS freq,
 CASE WHEN p_size <= 20 THEN 2e7 WHEN p_size <= 35 THEN 4e7 ELSE 8e7 END AS bandwidth FROM part""")
def _(t):
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias(KEY),
        normalize.centered_subcarrier(F.lit(3), size).cast("bigint").alias("subcarrier"),
        normalize.channel_frequency(size).alias("freq"),
        normalize.bandwidth_from_count(size, {20: 2e7, 35: 4e7, 64: 8e7}).alias("bandwidth"),
    )


@query("radar_scalars", """WITH s AS (SELECT p_partkey AS sample_id, 77e9 + p_size * 1e8 AS f, (p_size + 1) * 1e8 AS b, 1e-4 AS cp, 64 * (1 + p_size % 4) AS na, 32 AS nc, p_size AS nf FROM part)
SELECT sample_id, round(299792458.0 / f * 1000, 6) AS wavelength_mm, round(299792458.0 / (2 * b), 6) AS range_resolution,
 round(299792458.0 / (2 * b) * na / 2, 6) AS max_range, round(299792458.0 / f / (2 * nc * cp), 6) AS doppler_resolution,
 round(299792458.0 / f / (2 * nc * cp) * nc / 2, 6) AS max_velocity, CAST(nf * nc * 3 * 4 * na * 4 AS BIGINT) AS file_bytes FROM s""")
def _(t):
    size = F.col("p_size")
    config = t.part.select(
        F.col("p_partkey").alias(KEY), (77e9 + size * 1e8).alias("center_freq"),
        ((size + 1) * 1e8).alias("bandwidth"), F.lit(1e-4).alias("chirp_period"),
        (64 * (1 + size % 4)).alias("num_adc_samples"), F.lit(32).alias("num_chirps"),
        F.lit(3).alias("num_tx"), F.lit(4).alias("num_rx"), size.alias("num_frames"),
    )
    out = normalize.radar_scalars(config).withColumn("wavelength_mm", F.col("wavelength") * 1000)
    names = ["wavelength_mm", "range_resolution", "max_range", "doppler_resolution", "max_velocity"]
    return out.select(KEY, *(F.round(n, 6).alias(n) for n in names), "file_bytes")
