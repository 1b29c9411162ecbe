"""Sampling, scoring and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.operators import evaluate, sampling, scoring
from cellwave.workload.registry import query


def predictions(t):
    """Labels against a deterministic pseudo-prediction, split by id."""
    split = F.when(F.col("vec_id") % 3 == 0, "test").otherwise("val")
    return t.embeddings.select(
        F.col("vec_id").alias("sample_id"),
        split.alias("split"),
        F.when(F.col("vec_id") % 4 == 0, F.col("vec_id") * 7 % 10)
        .otherwise(F.col("label")).cast("bigint").alias("pred"),
        F.col("label").cast("bigint").alias("target"),
        F.slice("embedding", 1, 10).cast("array<double>").alias("logits"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


P_SQL = """p AS (SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'val' END AS split,
  CAST(CASE WHEN vec_id % 4 = 0 THEN vec_id * 7 % 10 ELSE label END AS BIGINT) AS pred,
  CAST(label AS BIGINT) AS target, CAST(embedding[1:10] AS DOUBLE[]) AS logits, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings)"""

F1_SQL = """l AS (SELECT split, pred AS k FROM p UNION SELECT split, target FROM p),
 f AS (SELECT l.split, l.k,
   (SELECT count(*) FROM p WHERE p.split = l.split AND pred = k AND target = k) AS tp,
   (SELECT count(*) FROM p WHERE p.split = l.split AND pred = k) AS said,
   (SELECT count(*) FROM p WHERE p.split = l.split AND target = k) AS real FROM l),
 g AS (SELECT split, tp / greatest(said, 1) AS pr, tp / greatest(real, 1) AS rc FROM f),
 c AS (SELECT a.split, accuracy, macro_f1, correct, "count" FROM
  (SELECT split, avg(CASE WHEN pred = target THEN 1.0 ELSE 0 END) AS accuracy,
    CAST(count(*) FILTER (pred = target) AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS "count"
   FROM p GROUP BY 1) a JOIN
  (SELECT split, avg(2 * pr * rc / greatest(pr + rc, 1e-12)) AS macro_f1 FROM g GROUP BY 1) b USING (split))"""


@query("shuffled_order", """SELECT event_id, CAST(row_number() OVER (ORDER BY md5('5|' || event_id), event_id) - 1 AS BIGINT) AS "order"
FROM events""")
def _(t):
    return sampling.shuffled_order(t.events.select("event_id"), "event_id", 5)


@query("weighted_resample", """WITH e AS (SELECT event_id, value, sum(value) OVER (ORDER BY event_id) AS upto,
   sum(value) OVER () AS total FROM events WHERE value > 0),
 d AS (SELECT event_id AS draw, CAST('0x' || substr(md5('draw9|' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM events)
SELECT d.draw, e.event_id FROM d ASOF JOIN
  (SELECT event_id, (upto - value) / total AS low FROM e) e ON d.u >= e.low""")
def _(t):
    rows = t.events.select("event_id", F.col("event_id").alias("pos"), "value")
    return sampling.weighted_resample(rows, "value", 9).select("draw", "event_id")


@query("alias_resample")
def _(t):
    rows = t.events.select("event_id", F.col("event_id").alias("pos"), "value")
    return sampling.alias_resample(rows, "value", 9).select("draw", "event_id")


@query("weight_count_problem", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(nullif(o_orderstatus, 'P')) AS BIGINT) AS weights FROM orders""")
def _(t):
    rows = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("w"))
    return sampling.weight_count_problem(rows, "w")


@query("batches", """SELECT vec_id // 32 AS batch, CAST(count(*) AS INT) AS n, string_agg(label, ',' ORDER BY vec_id) AS targets
FROM embeddings GROUP BY 1""")
def _(t):
    out = sampling.batches(t.embeddings, 32, "vec_id", ["label"])
    return out.select("batch", "n", F.array_join(F.col("label").cast("array<string>"), ",").alias("targets"))


@query("structured_batches", """SELECT o_orderkey // 64 AS batch, CAST(count(*) AS INT) AS n,
 string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS pose, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_orderkey) AS bbox
FROM orders GROUP BY 1""")
def _(t):
    target = F.create_map(
        F.lit("pose"), F.col("o_orderstatus"), F.lit("bbox"), F.col("o_custkey").cast("string")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("pos"), target.alias("target"))
    out = sampling.structured_batches(rows, 64, "pos", ["pose", "bbox"])
    return out.select(
        "batch", "n", F.array_join("pose", ",").alias("pose"), F.array_join("bbox", ",").alias("bbox")
    )


@query("key_set_counts", """SELECT CASE WHEN o_orderstatus = 'P' THEN 'bbox,pose' ELSE 'pose' END AS keys,
 CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def _(t):
    pose = F.create_map(F.lit("pose"), F.lit("x"))
    both = F.create_map(F.lit("pose"), F.lit("x"), F.lit("bbox"), F.lit("y"))
    rows = t.orders.select(F.when(F.col("o_orderstatus") == "P", both).otherwise(pose).alias("target"))
    return sampling.key_set_counts(rows)


@query("balanced_head", """WITH k AS (SELECT event_id, event_type,
  CASE WHEN event_id = min(event_id) OVER (PARTITION BY event_type) THEN 0 ELSE 1 END AS rest FROM events)
SELECT event_id, event_type FROM k ORDER BY rest, event_type, event_id LIMIT 64""")
def _(t):
    return sampling.balanced_head(t.events, "event_type", 64, "event_id").select("event_id", "event_type")


@query("top_predictions", f"""WITH {P_SQL},
 z AS (SELECT sample_id, i AS "index", logits[i + 1] AS z FROM p, range(10) r(i)),
 s AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY sample_id) AS score,
   row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, "index") - 1 AS rank FROM z)
SELECT sample_id, CAST(rank AS INT) AS rank, CAST("index" AS INT) AS "index", round(score, 6) AS score,
 CASE "index" WHEN 0 THEN 'push' WHEN 1 THEN 'sweep' END AS label FROM s WHERE rank < 3""")
def _(t):
    top = evaluate.top_predictions(
        predictions(t).select("sample_id", "logits"), "logits", 3, {0: "push", 1: "sweep"}
    )
    return top.select("sample_id", "rank", "index", F.round("score", 6).alias("score"), "label")


@query("classification_metrics", f"""WITH {P_SQL}, {F1_SQL}
SELECT split, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, correct, "count" FROM c""")
def _(t):
    out = evaluate.classification_metrics(predictions(t), by=["split"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


@query("classification_argmax", f"""WITH {P_SQL},
 a AS (SELECT list_position(logits, list_max(logits)) - 1 = target AS hit FROM p)
SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS accuracy,
 CAST(count(*) FILTER (hit) AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS "count" FROM a""")
def _(t):
    out = evaluate.classification_metrics(predictions(t), "logits", "target")
    return out.select(F.round("accuracy", 6).alias("accuracy"), "correct", "count")


@query("regression_metrics", f"""WITH {P_SQL},
 e AS (SELECT split, unnest(x) * 0.9 + 0.01 - unnest(x) AS e FROM p)
SELECT split, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, CAST(count(*) AS DOUBLE) AS "count"
FROM e GROUP BY 1""")
def _(t):
    guess = F.transform("x", lambda v: v * 0.9 + 0.01)
    out = evaluate.regression_metrics(predictions(t).withColumn("pred", guess), "pred", "x", ["split"])
    return out.select("split", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "count")


@query("pose_metrics", f"""WITH {P_SQL},
 j AS (SELECT split, sqrt(power(x[2*i+1] - x[2*i+29], 2) + power(x[2*i+2] - x[2*i+30], 2)) AS d FROM p, range(14) r(i))
SELECT split, round(avg(d), 6) AS mpjpe, round(sqrt(sum(d * d) / (2 * count(*))), 6) AS rmse,
 CAST(count(*) AS DOUBLE) AS "count" FROM j GROUP BY 1""")
def _(t):
    def joints(start):
        return F.transform(
            F.sequence(F.lit(0), F.lit(13)),
            lambda i: F.slice("x", i * 2 + F.lit(start + 1), F.lit(2)),
        )

    rows = predictions(t).withColumns({"pred": joints(0), "target": joints(28)})
    out = evaluate.pose_metrics(rows, by=["split"])
    return out.select("split", F.round("mpjpe", 6).alias("mpjpe"), F.round("rmse", 6).alias("rmse"), "count")


@query("evaluate_by_task", f"""WITH {P_SQL}, {F1_SQL}
SELECT split, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, correct, "count",
 'accuracy' AS primary_metric FROM c""")
def _(t):
    rows = predictions(t).withColumnsRenamed({"pred": "predictions", "target": "identity_label"})
    out = evaluate.evaluate(rows, "gait", by=["split"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


@query("evaluate_splits", f"""WITH {P_SQL}, {F1_SQL},
 u AS (SELECT split, 'accuracy' AS n, accuracy AS v FROM c UNION ALL SELECT split, 'macro_f1', macro_f1 FROM c
   UNION ALL SELECT split, 'correct', correct FROM c UNION ALL SELECT split, 'count', "count" FROM c)
SELECT split || '_' || n AS metric, round(v, 6) AS value, 'evaluated' AS status FROM u
UNION ALL SELECT unnest(['accuracy', 'primary_metric_value']), round(accuracy, 6), 'evaluated' FROM c WHERE split = 'val'
UNION ALL SELECT 'test_metric_value', round(accuracy, 6), 'evaluated' FROM c WHERE split = 'test'
UNION ALL SELECT 'ood', NULL, 'skipped'""")
def _(t):
    rows = predictions(t).withColumnsRenamed({"pred": "predictions", "target": "class_label"})
    out = evaluate.evaluate_splits(rows, "classification", splits=("val", "test", "ood"))
    return out.withColumn("value", F.round("value", 6))


@query("batch_mean_loss", f"""WITH {P_SQL},
 r AS (SELECT split, sample_id // 48 AS batch,
   ln(list_sum(list_transform(logits, lambda z: exp(z)))) - logits[target + 1] AS loss FROM p),
 b AS (SELECT split, batch, avg(loss) AS m, count(*) AS n FROM r GROUP BY 1, 2)
SELECT split, round(avg(m), 6) AS loss, CAST(count(*) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS samples FROM b GROUP BY 1""")
def _(t):
    rows = predictions(t).withColumn("batch", F.floor(F.col("sample_id") / 48))
    loss = evaluate.row_loss("cross_entropy")("logits", "target")
    out = evaluate.mean_of_batch_means(rows, loss, by=["split"])
    return out.withColumn("loss", F.round("loss", 6))


@query("row_losses", f"""WITH {P_SQL}, e AS (SELECT sample_id, unnest(x) * 30 - 1 AS e FROM p)
SELECT sample_id, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS l1,
 round(avg(CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 6) AS smooth_l1 FROM e GROUP BY 1""")
def _(t):
    rows = predictions(t).select(
        "sample_id", F.transform("x", lambda v: v * 30).alias("p"), F.transform("x", lambda v: v * 0 + 1).alias("t")
    )
    names = {"mse": "mse", "l1": "l1", "smooth_l1": "smooth_l1"}
    return rows.select(
        "sample_id", *(F.round(evaluate.row_loss(v)("p", "t"), 6).alias(k) for k, v in names.items())
    )


@query("row_losses_with_params", f"""WITH {P_SQL},
 e AS (SELECT sample_id, unnest(x) * 30 - 1 AS e, unnest(x) AS z, target % 2 AS y FROM p),
 m AS (SELECT sample_id, avg(CASE WHEN abs(e) < 0.5 THEN e * e ELSE abs(e) - 0.25 END) AS smooth_l1,
   avg(CASE WHEN abs(e) <= 2 THEN 0.5 * e * e ELSE 2 * (abs(e) - 1) END) AS huber,
   avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS bce_logits,
   avg(-(y * ln(1 / (1 + exp(-z))) + (1 - y) * ln(1 - 1 / (1 + exp(-z))))) AS bce FROM e GROUP BY 1),
 c AS (SELECT sample_id, target, logits, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS total, x FROM p),
 d AS (SELECT sample_id, 0.9 * (1 + target % 3) * (total - x[target + 1])
   + 0.1 * list_avg(list_transform(range(len(x)), lambda k: (1 + k % 3) * (total - x[k + 1]))) AS smoothed,
   (1 + target % 3) * (total - x[target + 1]) AS nll FROM c)
SELECT sample_id, round(smooth_l1, 6) AS smooth_l1, round(huber, 6) AS huber, round(bce_logits, 6) AS bce_logits,
 round(bce, 6) AS bce, round(smoothed, 6) AS smoothed, round(nll, 6) AS nll FROM m JOIN d USING (sample_id)""")
def _(t):
    loss, x = evaluate.row_loss, F.col("x")
    scaled, ones = F.transform(x, lambda v: v * 30), F.transform(x, lambda v: v * 0 + 1)
    flags = F.transform(x, lambda v: v * 0 + F.col("target") % 2)
    weight = [1.0 + k % 3 for k in range(64)]
    log_probs = F.transform(x, lambda v: v - F.log(F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y))))
    parts = {
        "smooth_l1": loss("smooth_l1", beta=0.5)(scaled, ones), "huber": loss("huber_loss", delta=2.0)(scaled, ones),
        "bce_logits": loss("binary_cross_entropy_with_logits")(x, flags),
        "bce": loss("binary_cross_entropy")(F.transform(x, lambda v: 1 / (1 + F.exp(-v))), flags),
        "smoothed": loss("cross_entropy", label_smoothing=0.1, weight=weight)(x, F.col("target")),
        "nll": loss("nll", weight=weight)(log_probs, F.col("target")),
    }
    return predictions(t).select("sample_id", *(F.round(v, 6).alias(k) for k, v in parts.items()))


def load_linear_model():
    """Ten fixed class weight vectors, as a user's model loader would return them."""
    import numpy as np

    c, i = np.meshgrid(np.arange(10), np.arange(64), indexing="ij")
    weights = ((c * 7 + i) % 11 - 5) / 10.0

    def forward(batch):
        return batch.astype("float64") @ weights.T

    return forward


@query("score_batches", """WITH z AS (SELECT vec_id AS sample_id, c, sum(CAST(embedding[i + 1] AS DOUBLE) * ((c * 7 + i) % 11 - 5) / 10.0) AS z
  FROM embeddings, range(10) a(c), range(64) b(i) GROUP BY 1, 2)
SELECT sample_id, CAST(c AS INT) AS class, round(z, 5) + 0.0 AS logit FROM z""")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("sample_id"), "embedding")
    scored = scoring.score_batches(rows, "embedding", load_linear_model, 64)
    return scored.select("sample_id", F.posexplode("logits").alias("class", "logit")).withColumn(
        "logit", F.round("logit", 5) + F.lit(0.0)
    )


@query("mlp_baseline")
def _(t):
    rows = t.embeddings.select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("bigint").alias("target"), "embedding",
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    model = scoring.fit_mlp(rows.where("split = 'train'"), "embedding", "target", [64, 32, 10])
    scored = scoring.predict_mlp(model, rows, "embedding")
    return evaluate.classification_metrics(scored, by=["split"])
