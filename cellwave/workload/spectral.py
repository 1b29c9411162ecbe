"""Spectral and radar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.model import KEY, Signal
from cellwave.operators import radar, spectral
from cellwave.workload.registry import query
from cellwave.workload.series import EVENT_SERIES_SQL, event_series
from cellwave.workload.views import complex_signal, complex_sql, real_signal, real_sql, rounded, sample_table


def dft_sql(source: str, keys: str, axis: str, n: int, scale: str, sign: int = -1, bins: int | None = None, weight: str = "1") -> str:
    """Rows (keys, k, re, im) of a plain DFT over one axis."""
    w = f"{sign} * 2 * pi() * k * {axis} / {bins or n}"
    return f"""SELECT {keys}, k, {scale} * sum({weight} * (re * cos({w}) - im * sin({w}))) AS re,
   {scale} * sum({weight} * (re * sin({w}) + im * cos({w}))) AS im FROM {source}, range({bins or n}) q(k) GROUP BY ALL"""


HANN = "(0.5 - 0.5 * cos(2 * pi() * {axis} / {n}))"
ROUND = "round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im"


@query("fft", f"""WITH {complex_sql(time=16, rx=2)}, d AS ({dft_sql('c', 'sample_id, rx', 'time', 16, '0.25')})
SELECT sample_id, k AS freq, rx, {ROUND} FROM d""")
def _(t):
    return rounded(spectral.fft(complex_signal(t, time=16, rx=2)), 5)


@query("inverse_fft", f"""WITH {complex_sql(freq=16, rx=2)}, d AS ({dft_sql('c', 'sample_id, rx', 'freq', 16, '1 / 16.0', 1)})
SELECT sample_id, k AS time, rx, {ROUND} FROM d""")
def _(t):
    return rounded(spectral.inverse_fft(complex_signal(t, freq=16, rx=2), norm="backward"), 5)


@query("frequency_coordinates", """SELECT vec_id AS sample_id, CAST(k AS BIGINT) AS idx, round(CASE WHEN k < 5 THEN k ELSE k - 9 END * 1000 / 9.0, 4) + 0.0 AS value FROM embeddings, range(9) r(k)""")
def _(t):
    sig = complex_signal(t, samples=sample_table(t), freq=16, rx=2)
    out = spectral.frequency_coordinates(sig, 9)
    return out.select(KEY, "idx", (F.round("value", 4) + F.lit(0.0)).alias("value"))


STFT_SQL = f"""{real_sql(time=64)}, x AS (SELECT *, value AS re, 0.0 AS im FROM c),
 g AS (SELECT f, o, abs(f * 4 + o - 8) AS q FROM range(17) a(f), range(16) b(o)),
 p AS (SELECT sample_id, f, o, re, im FROM g JOIN x ON time = CASE WHEN q > 63 THEN 126 - q ELSE q END),
 d AS ({dft_sql('p', 'sample_id, f', 'o', 16, '1', weight=HANN.format(axis='o', n=16))})"""


@query("stft", f"""WITH {STFT_SQL} SELECT sample_id, k AS freq, f AS frame, {ROUND} FROM d WHERE k <= 8""")
def _(t):
    return rounded(spectral.stft(real_signal(t, time=64), n_fft=16, span=32), 5)


@query("acoustic_stft", f"""WITH {real_sql(time=2, sample=32)},
 p AS (SELECT sample_id, time, f, o, value AS re, 0.0 AS im FROM range(5) a(f), range(16) b(o), c WHERE sample = f * 4 + o),
 d AS ({dft_sql('p', 'sample_id, time, f', 'o', 16, '0.25', weight=HANN.format(axis='o', n=16))})
SELECT sample_id, time, k AS freq, f AS frame, {ROUND} FROM d WHERE k <= 8""")
def _(t):
    sig = real_signal(t, time=2, sample=32)
    return rounded(spectral.acoustic_stft(sig, n_fft=16, center=False, normalized=True), 5)


DOPPLER = dict(sample_rate=8, window_size=6, window_step=2, nfft=8, max_doppler_hz=2)
DOPPLER_SQL = f"""{complex_sql(time=8, subc=2, tx=1, rx=2)},
 z AS (SELECT sample_id, time, subc, rx, re - avg(re) OVER w AS re, im - avg(im) OVER w AS im FROM c WINDOW w AS (PARTITION BY sample_id, subc, rx)),
 p AS (SELECT sample_id, subc, rx, f, o, re, im, exp(-0.5 * power((o - 1 - 3) / 6.0, 2)) AS w FROM range(5) a(f), range(1, 7) b(o), z WHERE time = f * 2 + o - 4),
 ws AS (SELECT sum(exp(-0.5 * power((o - 3) / 6.0, 2))) AS total FROM range(6) b(o)),
 d AS ({dft_sql('p', 'sample_id, subc, rx, f', 'o', 8, '1', weight='w')}),
 r AS (SELECT sample_id, f AS time_bin, (k + 2) % 8 AS freq_bin, subc, rx AS link, sqrt(re * re + im * im) / total AS value FROM d, ws WHERE (k + 2) % 8 < 5)"""


@query("dense_doppler", f"""WITH {DOPPLER_SQL} SELECT sample_id, time_bin, freq_bin, subc, link, round(value, 5) + 0.0 AS value FROM r""")
def _(t):
    return rounded(spectral.dense_doppler(complex_signal(t, time=8, subc=2, tx=1, rx=2), **DOPPLER), 5)


@query("dense_doppler_cropped", f"""WITH {DOPPLER_SQL} SELECT sample_id, time_bin - 1 AS time_bin, freq_bin, subc, link, round(value, 5) + 0.0 AS value FROM r WHERE time_bin BETWEEN 1 AND 3""")
def _(t):
    sig = complex_signal(t, time=8, subc=2, tx=1, rx=2)
    return rounded(spectral.dense_doppler(sig, **DOPPLER, target_time_bins=3, span=2), 5)


@query("autocorrelation", f"""WITH {EVENT_SERIES_SQL},
 a AS (SELECT x.sample_id, lag, sum(x.value * y.value) AS v FROM e x, range(6) q(lag), e y WHERE y.sample_id = x.sample_id AND y.time = x.time + lag GROUP BY 1, 2)
SELECT a.sample_id, a.lag, round(a.v / greatest(z.v, 1e-8), 5) + 0.0 AS value FROM a JOIN a z ON z.sample_id = a.sample_id AND z.lag = 0""")
def _(t):
    return rounded(spectral.autocorrelation(event_series(t), max_lag=5, chunk=16), 5)


@query("autocorrelation_full", f"""WITH {complex_sql(time=16, rx=2)}, m AS (SELECT *, sqrt(re * re + im * im) AS v FROM c)
SELECT x.sample_id, x.rx, y.time - x.time AS lag, round(sum(x.v * y.v), 5) + 0.0 AS value FROM m x JOIN m y ON x.sample_id = y.sample_id AND x.rx = y.rx AND y.time >= x.time GROUP BY 1, 2, 3""")
def _(t):
    return rounded(spectral.autocorrelation(complex_signal(t, time=16, rx=2), normalized=False, value="magnitude"), 5)


@query("wavelet_scalogram", f"""WITH {EVENT_SERIES_SQL},
 f AS (SELECT i, 5 * power(10, i / 3.0) AS f, 3 / (2 * pi() * 5 * power(10, i / 3.0)) AS s FROM range(4) q(i)),
 k AS (SELECT i, o, cos(2 * pi() * f * o / 100) * exp(-0.5 * power(o / 100 / s, 2)) AS c, sin(2 * pi() * f * o / 100) * exp(-0.5 * power(o / 100 / s, 2)) AS d
   FROM f, range(-40, 41) q(o) WHERE abs(o) <= greatest(1, round_even(4 * s * 100, 0))),
 n AS (SELECT i, o, c / greatest(sum(abs(c)) OVER (PARTITION BY i), 1e-8) AS c, d / greatest(sum(abs(d)) OVER (PARTITION BY i), 1e-8) AS d FROM k),
 r AS (SELECT x.sample_id, i, x.time, sum(y.value * c) AS a, sum(y.value * d) AS b FROM e x, n, e y WHERE y.sample_id = x.sample_id AND y.time = x.time + o GROUP BY 1, 2, 3)
SELECT sample_id, i AS pseudo_freq, time AS frame, round(sqrt(a * a + b * b), 4) + 0.0 AS value FROM r""")
def _(t):
    out = spectral.wavelet_scalogram(event_series(t), 100.0, num_frequencies=4, min_hz=5.0, cycles=3.0, chunk=48)
    return rounded(out, 4)


CUBE = dict(chirp=4, adc=4, ant=2)


@query("range_fft", f"""WITH {complex_sql(**CUBE)}, d AS ({dft_sql('c', 'sample_id, chirp, ant', 'adc', 4, '0.5', weight=HANN.format(axis='adc', n=4))})
SELECT sample_id, chirp, k AS range, ant, {ROUND} FROM d""")
def _(t):
    return rounded(radar.range_fft(complex_signal(t, **CUBE)), 5)


@query("doppler_fft", f"""WITH {complex_sql(**CUBE)}, d AS ({dft_sql('c', 'sample_id, adc, ant', 'chirp', 4, '0.5', weight=HANN.format(axis='chirp', n=4))})
SELECT sample_id, (k + 2) % 4 AS doppler, adc, ant, {ROUND} FROM d""")
def _(t):
    return rounded(radar.doppler_fft(complex_signal(t, **CUBE)), 5)


@query("angle_fft", f"""WITH {complex_sql(**CUBE)}, d AS ({dft_sql('c', 'sample_id, chirp, adc', 'ant', 2, '1 / sqrt(8)', bins=8)})
SELECT sample_id, chirp, adc, (k + 4) % 8 AS angle, {ROUND} FROM d""")
def _(t):
    return rounded(radar.angle_fft(complex_signal(t, **CUBE), num_bins=8), 5)


CUBE_SQL = f"""{complex_sql(**CUBE)},
 r AS ({dft_sql('c', 'sample_id, chirp, ant', 'adc', 4, '0.5', weight=HANN.format(axis='adc', n=4))}),
 r2 AS (SELECT sample_id, chirp, ant, k AS r, re, im FROM r),
 v AS ({dft_sql('r2', 'sample_id, r, ant', 'chirp', 4, '0.5', weight=HANN.format(axis='chirp', n=4))}),
 v2 AS (SELECT sample_id, r, ant, (k + 2) % 4 AS v, re, im FROM v),
 a AS ({dft_sql('v2', 'sample_id, r, v', 'ant', 2, '0.5', bins=4)}),
 cube AS (SELECT sample_id, v AS doppler, r AS range, (k + 2) % 4 AS angle, re, im FROM a)"""


@query("radar_cube", f"WITH {CUBE_SQL} SELECT sample_id, doppler, range, angle, {ROUND} FROM cube")
def _(t):
    return rounded(radar.radar_cube(complex_signal(t, **CUBE), 4), 5)


@query("range_doppler", f"""WITH {CUBE_SQL} SELECT sample_id, doppler, range, round(sum(re * re + im * im), 6) + 0.0 AS value FROM cube GROUP BY ALL""")
def _(t):
    return rounded(radar.range_doppler(radar.radar_cube(complex_signal(t, **CUBE), 4)))


@query("range_angle_db", f"""WITH {complex_sql(doppler=4, range=4, angle=2)} SELECT sample_id, range, angle, round(10 * log10(greatest(max(re * re + im * im), 1e-20)), 5) + 0.0 AS value FROM c GROUP BY ALL""")
def _(t):
    sig = complex_signal(t, doppler=4, range=4, angle=2)
    return rounded(radar.range_angle(sig, "max", to_db=True), 5)


@query("spatial_covariance", f"""WITH {complex_sql(snapshot=8, sensor=4)}
SELECT a.sample_id, a.sensor AS i, b.sensor AS j, round(avg(a.re * b.re + a.im * b.im), 6) + 0.0 AS re, round(avg(a.im * b.re - a.re * b.im), 6) + 0.0 AS im, 8.0 AS snapshots
FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.snapshot = b.snapshot GROUP BY 1, 2, 3""")
def _(t):
    out = radar.spatial_covariance(complex_signal(t, snapshot=8, sensor=4), "sensor", "snapshot", chunk=4)
    return out.withColumns({p: F.round(p, 6) + F.lit(0.0) for p in ("re", "im")})


@query("music_aoa")
def _(t):
    return rounded(radar.music_spectrum(
        complex_signal(t, snapshot=8, sensor=4), "aoa", "sensor", "snapshot", 1, num_bins=37,
        positions=[0.0, 0.03, 0.06, 0.09], center_freq=5.0e9,
    ), 4)


@query("music_tof")
def _(t):
    return rounded(radar.music_spectrum(
        complex_signal(t, time=4, subc=8), "tof", "subc", "time", 2, num_bins=21, scan=(0.0, 2e-7),
        subcarrier_indices=[-4, -3, -2, -1, 1, 2, 3, 4], subcarrier_spacing=312500.0,
    ), 4)


def radar_frames(t) -> Signal:
    """Twelve embeddings per frame (ant 4, chirp 6, adc 16); a short last frame is zero-filled."""
    flat = complex_signal(t, cell=32).cells
    cells = flat.select(
        F.floor(F.col(KEY) / 12).alias(KEY), (F.col(KEY) % 12 * 32 + F.col("cell")).alias("i"), "re", "im"
    )
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(383).cast("bigint"))
    grid = cells.select(KEY).distinct().select(KEY, F.explode(slots).alias("i"))
    full = grid.join(cells, on=[KEY, "i"], how="left").fillna(0.0, ["re", "im"])
    i = F.col("i")
    return Signal(
        full.select(
            KEY, F.floor(i / 96).alias("ant"), F.pmod(F.floor(i / 16), F.lit(6)).alias("chirp"),
            F.pmod(i, F.lit(16)).alias("adc"), "re", "im",
        ),
        ("ant", "chirp", "adc"),
    )


@query("elevation_azimuth_heatmap")
def _(t):
    out = radar.elevation_azimuth_heatmap(
        radar_frames(t), azimuth_bins=8, elevation_bins=4, range_bins=range(10, 2, -1), group_chirps=1
    )
    return rounded(out, 5)


@query("beamform", f"""WITH {real_sql(sample=16, mic=4)},
 y AS (SELECT sample_id, mic, k, sum(value * cos(2 * pi() * k * sample / 16)) AS re, -sum(value * sin(2 * pi() * k * sample / 16)) AS im FROM c, range(9) q(k) GROUP BY 1, 2, 3),
 s AS (SELECT *, 2 * pi() * k * (16000 / 16) * mic * 0.05 * sin(radians(a * 30 - 30)) / 343.0 AS ph FROM y, range(3) r(a)),
 z AS (SELECT sample_id, a, k, sum(re * cos(ph) + im * sin(ph)) AS re, sum(im * cos(ph) - re * sin(ph)) AS im FROM s GROUP BY 1, 2, 3)
SELECT sample_id, n AS sample, a AS angle, round(sum(CASE WHEN k = 0 OR k = 8 THEN re * cos(pi() * k * n / 8) ELSE 2 * (re * cos(pi() * k * n / 8) - im * sin(pi() * k * n / 8)) END) / 16, 5) + 0.0 AS value
FROM z, range(16) q(n) GROUP BY 1, 2, 3""")
def _(t):
    return rounded(spectral.beamform(real_signal(t, sample=16, mic=4), 16000.0, [-30.0, 0.0, 30.0], 0.05), 5)


@query("fmcw_demod", f"""WITH {real_sql(time=2, sample=32)},
 m AS (SELECT sample_id, time, sample, 2 * pi() * (100.0 * sample / 16000 + 0.5 * (2000.0 / (32 / 16000.0)) * power(sample / 16000.0, 2)) AS ph, value FROM c),
 x AS (SELECT sample_id, time, sample, value * cos(ph) AS re, -value * sin(ph) AS im FROM m),
 d AS ({dft_sql('x', 'sample_id, time', 'sample', 32, '1', weight=HANN.format(axis='sample', n=32))})
SELECT sample_id, time, k AS range, {ROUND} FROM d""")
def _(t):
    return rounded(spectral.fmcw_demod(real_signal(t, time=2, sample=32), 16000.0, 100.0, 2000.0), 5)


@query("radar_coordinates", """SELECT vec_id AS sample_id, CAST(k AS BIGINT) AS idx, round(CASE WHEN vec_id % 7 <> 0 THEN k * 299792458.0 / (2 * 2e7) END, 4) AS range_m,
 round((k - 4) * (299792458.0 / (5.18e9 + (vec_id % 4) * 6e5)) / (2 * 8 * 1e-4), 6) + 0.0 AS velocity, round(degrees(asin(k * 2 / 7.0 - 1)), 6) + 0.0 AS angle_deg
FROM embeddings, range(8) r(k)""")
def _(t):
    rows = sample_table(t).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    k = F.col("idx")
    return rows.select(
        KEY, "idx", F.round(radar.range_coordinate(k, F.col("bandwidth")), 4).alias("range_m"),
        (F.round(radar.doppler_coordinate(k, 8, F.col("center_freq"), F.lit(1e-4)), 6) + F.lit(0.0)).alias("velocity"),
        (F.round(radar.angle_coordinate(k, 8), 6) + F.lit(0.0)).alias("angle_deg"),
    )


@query("fft_long", f"""WITH {EVENT_SERIES_SQL}, n AS (SELECT sample_id, count(*) AS n FROM e GROUP BY 1),
 d AS (SELECT sample_id, k, sum(value * cos(2 * pi() * ((k * time) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * time) % n) / n)) AS im
  FROM e JOIN n USING (sample_id) JOIN range(200) q(k) ON k < n GROUP BY 1, 2, n)
SELECT sample_id, k AS freq, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM d""")
def _(t):
    return rounded(spectral.fft_long(event_series(t), norm="backward", max_group=16), 4)
