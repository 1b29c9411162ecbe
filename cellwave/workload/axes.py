"""Axis algebra queries over embedding cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.model import KEY
from cellwave.operators import axes
from cellwave.workload.registry import query
from cellwave.workload.views import complex_signal, complex_sql, real_signal, real_sql, rounded, sample_table

TSR = dict(time=8, subc=2, rx=2)
TS = dict(time=16, subc=4)


def time_coords(t, n=8, step=0.001):
    rows = t.embeddings.select(
        F.col("vec_id").alias(KEY), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    )
    return rows.select(
        KEY, F.lit("time").alias("axis"), F.col("i").cast("bigint").alias("idx"),
        (F.col("i") * step).alias("value"), F.lit("s").alias("unit"),
    )


@query("select_index", f"""WITH {complex_sql(**TSR)}
SELECT sample_id, (time - 2) // 2 AS time, subc, round(re, 6) AS re, round(im, 6) AS im FROM c
WHERE time >= 2 AND time < 7 AND (time - 2) % 2 = 0 AND rx = 1""")
def _(t):
    return rounded(axes.select_index(complex_signal(t, **TSR), time=slice(2, -1, 2), rx=-1))


@query("select_index_time_shift", """SELECT vec_id AS sample_id, 1.7e9 + vec_id + 0.003 AS timestamp_start FROM embeddings""")
def _(t):
    sig = complex_signal(t, samples=sample_table(t), **TSR)
    return axes.select_index(sig, time=slice(3, None)).samples.select(KEY, "timestamp_start")


@query("index_bounds_problems", "SELECT l_orderkey AS sample_id, CAST(count(*) AS BIGINT) AS _len_point FROM lineitem GROUP BY 1 HAVING count(*) < 4")
def _(t):
    from cellwave.workload.elementwise import lineitem_signal

    return axes.index_bounds_problems(lineitem_signal(t), "point", 3)


@query("coordinate_values", """SELECT vec_id AS sample_id, i - 4 AS idx, round(i * 0.001, 6) AS value, 's' AS unit FROM embeddings, range(4, 8) r(i)""")
def _(t):
    sig = complex_signal(t, coords=time_coords(t), **TSR)
    out = axes.coordinate_values(axes.select_index(sig, time=slice(4, None)), "time")
    return out.withColumn("value", F.round("value", 6))


@query("concat", f"""WITH {complex_sql(**TSR)}
SELECT sample_id, time, subc, rx, round(re, 6) AS re FROM c WHERE time < 3
UNION ALL SELECT sample_id, time + 3, subc, rx, round(-re, 6) + 0.0 FROM c""")
def _(t):
    sig = complex_signal(t, **TSR)
    flipped = sig.with_parts(re=-F.col("re"), im=F.col("im"))
    out = axes.concat([axes.select_index(sig, time=slice(0, 3)), flipped], "time")
    return rounded(out).drop("im")


@query("concat_problems", """SELECT vec_id AS sample_id, 1 AS part, 'center_freq' AS field FROM embeddings WHERE vec_id % 4 >= 2""")
def _(t):
    first = sample_table(t).withColumn("center_freq", F.lit(5.18e9))
    return axes.concat_problems([first, sample_table(t)])


@query("permute", f"""WITH {real_sql(**TS)} SELECT sample_id, subc, time, round(value, 6) AS value FROM c""")
def _(t):
    return rounded(axes.permute(real_signal(t, **TS), "subc", "time"))


@query("merge_axes", f"""WITH {complex_sql(**TSR)}
SELECT sample_id, time, subc * 2 + rx AS feature, round(re, 6) AS re, round(im, 6) AS im FROM c""")
def _(t):
    return rounded(axes.merge_axes(complex_signal(t, **TSR), ["subc", "rx"], "feature"))


@query("rearrange", f"""WITH {real_sql(time=16, subc=4)}
SELECT sample_id, time % 4 AS b, subc * 4 + time // 4 AS subc_a, round(value, 6) AS value FROM c""")
def _(t):
    return rounded(axes.rearrange(real_signal(t, **TS), "(a b) subc -> b (subc a)", a=4, b=4))


@query("reduce_axes", f"""WITH {complex_sql(**TSR)}
SELECT sample_id, rx, round(avg(sqrt(re * re + im * im)), 6) AS value FROM c GROUP BY 1, 2""")
def _(t):
    return rounded(axes.reduce_axes(complex_signal(t, **TSR), ["rx"], "mean"))


@query("reduce_axes_product", f"""WITH {real_sql(**TS)}
SELECT sample_id, time, round(product(value + 1), 6) AS value FROM c GROUP BY 1, 2""")
def _(t):
    sig = real_signal(t, **TS)
    return rounded(axes.reduce_axes(sig.with_parts(value=F.col("value") + 1), ["time"], "prod"))


@query("repeat", f"""WITH {real_sql(**TS)}
SELECT sample_id, time, subc, k AS copy, round(value, 6) AS value FROM c, range(3) q(k)""")
def _(t):
    return rounded(axes.repeat(real_signal(t, **TS), "copy", 3))


@query("resize_axis_crop", f"""WITH {real_sql(**TS)}
SELECT sample_id, time - 3 AS time, subc, round(value, 6) AS value FROM c WHERE time BETWEEN 3 AND 12""")
def _(t):
    return rounded(axes.resize_axis(real_signal(t, **TS), "time", 10, crop="center"))


@query("resize_axis_pad", f"""WITH {real_sql(**TS)}
SELECT sample_id, time, subc, round(value, 6) AS value FROM c
UNION ALL SELECT DISTINCT sample_id, k, subc, 0.0 FROM c, range(16, 20) q(k)""")
def _(t):
    return rounded(axes.resize_axis(real_signal(t, **TS), "time", 20))


@query("resize_axis_coordinates", """SELECT vec_id AS sample_id, CAST(i AS BIGINT) AS idx, round(i * 0.001, 6) AS value FROM embeddings, range(12) r(i)""")
def _(t):
    sig = complex_signal(t, samples=sample_table(t), coords=time_coords(t), **TSR)
    out = axes.resize_axis(sig, "time", 12).coords
    return out.select(KEY, "idx", F.round("value", 6).alias("value"))


@query("temporal_resize_linear", f"""WITH {complex_sql(time=8, subc=4)},
 g AS (SELECT k, greatest(0, least(7, (k + 0.5) * 8 / 11.0 - 0.5)) AS s FROM range(11) q(k)),
 h AS (SELECT k, CAST(floor(s) AS BIGINT) AS i, s - floor(s) AS w FROM g)
SELECT a.sample_id, h.k AS time, a.subc, round(a.re * (1 - w) + b.re * w, 6) + 0.0 AS re, round(a.im * (1 - w) + b.im * w, 6) + 0.0 AS im
FROM h JOIN c a ON a.time = h.i JOIN c b ON b.time = least(7, h.i + 1) AND b.sample_id = a.sample_id AND b.subc = a.subc""")
def _(t):
    return rounded(axes.temporal_resize(complex_signal(t, time=8, subc=4), "time", 11))


@query("temporal_resize_corners", """WITH h AS (SELECT k, CAST(floor(k * 15 / 5.0) AS INT) AS i, k * 15 / 5.0 - floor(k * 15 / 5.0) AS w FROM range(6) q(k))
SELECT vec_id AS sample_id, h.k AS time, s.subc,
 round(CAST(embedding[4 * i + s.subc + 1] AS DOUBLE) * (1 - w) + CAST(embedding[4 * least(15, i + 1) + s.subc + 1] AS DOUBLE) * w, 6) + 0.0 AS value
FROM embeddings, h, range(4) s(subc)""")
def _(t):
    return rounded(axes.temporal_resize(real_signal(t, **TS), "time", 6, align_corners=True))


@query("temporal_resize_nearest", f"""WITH {real_sql(**TS)}
SELECT sample_id, k AS time, subc, round(value, 6) AS value FROM c JOIN range(23) q(k) ON time = floor(k * 16 / 23.0)""")
def _(t):
    return rounded(axes.temporal_resize(real_signal(t, **TS), "time", 23, mode="nearest"))


@query("resized_coordinates", """SELECT vec_id AS sample_id, CAST(i AS BIGINT) AS idx, round(i * 0.007 / 4, 6) AS value FROM embeddings, range(5) r(i)""")
def _(t):
    sig = complex_signal(t, coords=time_coords(t), **TSR)
    return axes.resized_coordinates(sig, "time", 5).select(KEY, "idx", F.round("value", 6).alias("value"))


@query("pack_unpack_series", f"""WITH {complex_sql(**TSR)} SELECT sample_id, time, rx, subc, round(re, 6) AS re, round(im, 6) AS im FROM c""")
def _(t):
    sig = complex_signal(t, **TSR)
    packed = axes.pack_series(sig, "subc")
    return rounded(sig.with_cells(axes.unpack_series(packed, sig.keys("subc"), "subc", sig.parts)))


@query("unbatch", f"""WITH {real_sql(batch=4, time=16)}
SELECT sample_id || '/' || batch AS sample_id, time, round(value, 6) AS value FROM c""")
def _(t):
    return rounded(axes.unbatch(real_signal(t, batch=4, time=16)))


@query("stack", f"""WITH {real_sql(**TS)}
SELECT sample_id, CAST(0 AS BIGINT) AS view, time, subc, round(value, 6) AS value FROM c
UNION ALL SELECT sample_id, 1, time, subc, round(value * 2, 6) FROM c""")
def _(t):
    sig = real_signal(t, **TS)
    return rounded(axes.stack([sig, sig.with_parts(value=F.col("value") * 2)]))
