"""Model-input, point-set, composition and preset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.model import KEY
from cellwave.operators import adapters, normalize
from cellwave.plans import compose, presets, templates
from cellwave.workload.elementwise import lineitem_signal
from cellwave.workload.registry import query
from cellwave.workload.spectral import CUBE, CUBE_SQL, ROUND
from cellwave.workload.views import complex_signal, complex_sql, long_signal, real_signal, real_sql, rounded, sample_table

TSR = dict(time=8, subc=2, rx=2)


@query("to_sequence", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, subc * 2 + rx AS feature, round(sqrt(re * re + im * im), 6) + 0.0 AS value FROM c""")
def _(t):
    return rounded(adapters.to_sequence(complex_signal(t, **TSR), ["subc", "rx"]))


@query("feature_arrays", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, CAST(count(*) AS INT) AS width, round(sum((subc * 2 + rx + 1) * re), 6) + 0.0 AS weighted FROM c GROUP BY 1, 2""")
def _(t):
    seq = adapters.to_sequence(complex_signal(t, **TSR), ["subc", "rx"], value="real")
    rows = adapters.feature_arrays(seq)
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return rows.select(KEY, "time", F.size("features").alias("width"), (F.round(weighted, 6) + F.lit(0.0)).alias("weighted"))


@query("to_image", f"""WITH {real_sql(rx=2, freq=8, tx=2, frame=2)} SELECT sample_id, rx * 2 + tx AS channel, freq, frame, round(value, 6) + 0.0 AS value FROM c""")
def _(t):
    return rounded(adapters.to_image(real_signal(t, rx=2, freq=8, tx=2, frame=2), "freq", "frame", stack_other=True))


@query("auto_align_sequence", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, subc * 2 + rx AS feature, round(sqrt(re * re + im * im), 6) + 0.0 AS value FROM c""")
def _(t):
    contract = adapters.InputContract(("time", "feature"))
    return rounded(adapters.auto_align(complex_signal(t, **TSR), contract))


@query("auto_align_image", f"""WITH {complex_sql(time=4, subc=4, rx=2)} SELECT sample_id, rx AS channel, subc AS height, time AS width, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM c""")
def _(t):
    contract = adapters.InputContract(("channel", "height", "width"), "complex")
    sig = complex_signal(t, time=4, subc=4, rx=2)
    return rounded(adapters.auto_align(sig, contract, axis_map={"height": "subc"}, width_axis="time"))


@query("auto_align_vector", f"""WITH {real_sql(time=16, subc=4)} SELECT sample_id, time * 4 + subc AS feature, round(value, 6) + 0.0 AS value FROM c""")
def _(t):
    contract = adapters.InputContract(("feature",))
    return rounded(adapters.auto_align(real_signal(t, time=16, subc=4), contract, value="identity"))


@query("contract_problems", """SELECT l_orderkey AS sample_id, 'point' AS axis, CAST(4 AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS actual FROM lineitem GROUP BY 1 HAVING count(*) <> 4""")
def _(t):
    contract = adapters.InputContract(("point",), fixed_sizes={"point": 4})
    return adapters.contract_problems(lineitem_signal(t), contract)


@query("point_statistics", """SELECT o_orderkey AS sample_id, round(coalesce(avg(l_quantity), 0), 5) AS mean_qty, round(coalesce(avg(l_extendedprice), 0), 5) AS mean_price,
 coalesce(max(l_quantity), 0) AS max_qty, coalesce(max(l_extendedprice), 0) AS max_price, round(coalesce(stddev_pop(l_quantity), 0), 5) AS std_qty, round(coalesce(stddev_pop(l_extendedprice), 0), 4) AS std_price
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def _(t):
    points = t.lineitem.select(
        F.col("l_orderkey").alias(KEY), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")
    )
    frames = t.orders.select(F.col("o_orderkey").alias(KEY))
    out = adapters.point_statistics(points, [KEY], ["qty", "price"], frames=frames)
    digits = {"mean_qty": 5, "mean_price": 5, "std_qty": 5, "std_price": 4}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


POINTS_SQL = f"""{complex_sql(range=8, doppler=4)}, m AS (SELECT *, sqrt(re * re + im * im) AS v FROM c), k AS (SELECT *, max(v) OVER (PARTITION BY sample_id) AS peak FROM m)"""


@query("to_pointset", f"""WITH {POINTS_SQL} SELECT sample_id, range, doppler, round(v, 6) AS value FROM k WHERE v > 0.7 * peak""")
def _(t):
    points = adapters.to_pointset(complex_signal(t, range=8, doppler=4), 0.7)
    return points.withColumn("value", F.round("value", 6))


@query("batch_pointsets", f"""WITH {POINTS_SQL}, n AS (SELECT count(*) FILTER (v > 0.7 * peak) AS a, count(*) FILTER (v > 0.9 * peak) AS b FROM k)
SELECT 0 AS batch, CAST(a AS BIGINT) AS length, CAST(0 AS BIGINT) AS "offset" FROM n UNION ALL SELECT 1, b, a FROM n""")
def _(t):
    sig = complex_signal(t, range=8, doppler=4)
    points = adapters.batch_pointsets([adapters.to_pointset(sig, 0.7), adapters.to_pointset(sig, 0.9)])
    return adapters.batch_layout(points)


@query("compose_steps", f"""WITH {complex_sql(**TSR)}, m AS (SELECT *, sqrt(re * re + im * im) AS v FROM c),
 s AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM m WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, time, subc * 2 + rx AS feature, round((v - lo) / (hi - lo + 1e-8), 6) + 0.0 AS value FROM s""")
def _(t):
    chain = compose.compose(
        compose.step(normalize.magnitude), compose.step(normalize.minmax),
        compose.step(adapters.to_sequence, flatten_axes=["subc", "rx"]),
    )
    return rounded(chain(complex_signal(t, **TSR)))


@query("provenance", """SELECT vec_id AS sample_id, unnest(['magnitude', 'minmax', 'to_sequence']) AS name, unnest(['', 'high=2.0', 'flatten_axes=[''subc'', ''rx'']']) AS params,
 unnest(['', '', 'rx,subc']) AS consumed, unnest(['', '', 'feature']) AS produced FROM embeddings""")
def _(t):
    chain = compose.compose(
        compose.step(normalize.magnitude), compose.step(normalize.minmax, high=2.0),
        compose.step(adapters.to_sequence, flatten_axes=["subc", "rx"]),
    )
    samples = chain(complex_signal(t, samples=sample_table(t), **TSR)).samples
    rows = samples.select(KEY, F.explode("transforms").alias("r"))
    return rows.select(
        KEY, "r.name", "r.params", F.array_join("r.consumed", ",").alias("consumed"),
        F.array_join("r.produced", ",").alias("produced"),
    )


@query("keyed_steps", f"""WITH {complex_sql(**TSR)}, {real_sql(time=16, subc=4).replace('c AS', 'd AS', 1)}
SELECT 'wifi' AS modality, sample_id, round(max(sqrt(re * re + im * im)), 6) AS peak FROM c GROUP BY 2
UNION ALL SELECT 'radar', sample_id, round(max(value), 6) FROM d GROUP BY 2""")
def _(t):
    from cellwave.operators.axes import reduce_axes

    wifi, radar_sig = complex_signal(t, **TSR), real_signal(t, time=16, subc=4)
    peak = compose.keyed(lambda s: reduce_axes(s, [], "max"), ["wifi", "radar"])
    out = peak({"wifi": wifi, "radar": radar_sig})
    parts = [
        s.cells.select(F.lit(name).alias("modality"), KEY, F.round("value", 6).alias("peak")) for name, s in out.items()
    ]
    return parts[0].unionByName(parts[1])


@query("radar_cube_preset", f"WITH {CUBE_SQL} SELECT sample_id, doppler, range, angle, {ROUND} FROM cube")
def _(t):
    return rounded(presets.radar_cube(num_bins=4)(complex_signal(t, **CUBE)), 5)


@query("csi_sequence_preset")
def _(t):
    return rounded(presets.csi_sequence(sample_zscore=True)(long_signal(t)), 5)


@query("csi_sequence_template")
def _(t):
    done = templates.build(templates.CSI_SEQUENCE, skip_reader_ids=("reader1",), sample_zscore=True)(long_signal(t))
    return rounded(done, 5)


SPECTRUM = dict(window_size=16, window_step=4, nfft=40, max_doppler_hz=6, sample_rate=40, band_pass={
    "lowpass_hz": 8.0, "highpass_hz": 1.0, "lowpass_order": 6, "highpass_order": 3})


@query("dense_spectrum_template")
def _(t):
    lattice = {"totals": {"link": 2, "subcarrier": 9, "freq": 13, "time": 5000}, "kept": {"link": [1], "subcarrier": [1, 2, 5, 8]}}
    done = templates.build(templates.DENSE_SPECTRUM, templates.COMPLEX_IMAGE, lattice=lattice, **SPECTRUM)(long_signal(t))
    return rounded(done, 5)


@query("radar_cube_template", f"WITH {CUBE_SQL} SELECT sample_id, doppler, range, angle, {ROUND} FROM cube")
def _(t):
    return rounded(templates.build(templates.RADAR_CUBE, num_bins=4)(complex_signal(t, **CUBE)), 5)
