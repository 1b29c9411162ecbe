"""Digest, log and leaderboard queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellwave.operators import artifacts, ordinal
from cellwave.operators.ordinal import shared_folder
from cellwave.workload.registry import query

LANES = " || ',' || ".join(
    f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)
)


@query("dataset_digest", f"""WITH r AS (SELECT sha256('{{"label":"' || event_type || '","sample_id":' || event_id || ',"user_id":' || user_id || '}}') AS h FROM events)
SELECT sha256(CAST(count(*) AS VARCHAR) || ',' || {LANES}) AS digest, CAST(count(*) AS BIGINT) AS n FROM r""")
def _(t):
    rows = t.events.select(
        "user_id", F.col("event_type").alias("label"), F.col("event_id").alias("sample_id")
    )
    return artifacts.dataset_digest(rows)


def event_rows(t, changed: bool = False):
    """Events as manifest rows; the changed ones lack every 97th, have every 89th twice as much and a few more."""
    rows = t.events.select("user_id", F.col("event_type").alias("label"), F.col("event_id").alias("sample_id"))
    if not changed:
        return rows
    more = rows.where("sample_id % 101 = 0").withColumn("sample_id", -F.col("sample_id") - 1)
    kept = rows.where("sample_id % 97 <> 0").withColumn("user_id", F.when(F.col("sample_id") % 89 == 0, F.col("user_id") * 2 + 1).otherwise(F.col("user_id")))
    return kept.unionByName(more)


@query("merkle_tree", f"""WITH r AS (SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 4) AS bucket,
   sha256('{{"label":"' || event_type || '","sample_id":' || event_id || ',"user_id":' || user_id || '}}') AS h FROM events),
 l AS (SELECT bucket, sha256(CAST(count(*) AS VARCHAR) || ',' || {LANES}) AS digest, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1),
 g AS (SELECT substr(bucket, 1, 2) AS bucket, sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1)
SELECT 2 AS level, * FROM l UNION ALL SELECT 1, * FROM g
UNION ALL SELECT 0, '', sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)), CAST(sum(n) AS BIGINT) FROM g""")
def _(t):
    return artifacts.merkle_tree(event_rows(t), "sample_id")


@query("digest_diff", """SELECT event_id AS sample_id, CASE WHEN event_id % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM events
WHERE event_id % 97 = 0 OR (event_id % 89 = 0 AND user_id * 2 + 1 <> user_id)
UNION ALL SELECT -event_id - 1, 'added' FROM events WHERE event_id % 101 = 0""")
def _(t):
    old, new = event_rows(t), event_rows(t, True)
    trees = [ordinal.written(artifacts.merkle_tree(rows, "sample_id"), "merkle") for rows in (old, new)]
    return artifacts.digest_diff(old, new, "sample_id", *trees)


def document_files(t):
    return t.documents.select(
        F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query("file_checksums", "SELECT 'corpus/' || source || '/' || doc_id AS path, sha256(text) AS digest FROM documents")
def _(t):
    return artifacts.file_checksums(document_files(t))


@query("data_version", f"""WITH r AS (SELECT sha256(doc_id || '|' || sha256(text)) AS h FROM documents)
SELECT sha256(CAST(count(*) AS VARCHAR) || ',' || {LANES}) AS data_version, CAST(count(*) AS BIGINT) AS n FROM r""")
def _(t):
    return artifacts.data_version(document_files(t))


@query("verify_checksums", """SELECT state, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT CASE WHEN l.doc_id IS NULL THEN 'unlisted' WHEN l.quality = 1 THEN 'ok' ELSE 'mismatch' END AS state
 FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def _(t):
    found = artifacts.file_checksums(document_files(t))
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("stale"))
    listed = t.documents.join(t.labels, "doc_id").select(
        F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2(text, 256).alias("expected"),
    )
    return artifacts.verify_checksums(found, listed).groupBy("state").agg(F.count("*").alias("n"))


def run_events(t):
    """One run per user, one epoch per event; error events are split markers."""
    marker = F.col("event_type") == "error"
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.when(marker, "split_end").when(F.col("event_type") == "view", F.lit(None)).otherwise("epoch_end").alias("event"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("train_loss"),
        (F.col("value") / 2).alias("val_loss"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("epoch_duration_sec"),
        F.when(marker & (F.col("event_id") % 4 != 0), "test").alias("split"),
    )


@query("epoch_history", """SELECT user_id AS run_id, CAST(event_id AS DOUBLE) AS epoch, value AS train_loss, value / 2 AS val_loss,
 CASE WHEN event_id % 10 <> 0 THEN value END AS epoch_duration_sec FROM events WHERE event_type NOT IN ('error', 'view')""")
def _(t):
    return artifacts.epoch_history(run_events(t), ["run_id"])


@query("trace_problems", """WITH e AS (SELECT user_id AS run_id, CAST(event_id AS DOUBLE) AS epoch, * FROM events),
 n AS (SELECT * FROM e WHERE event_type NOT IN ('error', 'view'))
SELECT run_id, epoch, 'missing_event' AS problem FROM e WHERE event_type = 'view'
UNION ALL SELECT run_id, epoch, 'missing_field' FROM n WHERE event_id % 10 = 0
UNION ALL SELECT run_id, epoch, 'missing_split' FROM e WHERE event_type = 'error' AND event_id % 4 = 0
UNION ALL SELECT run_id, epoch, 'not_in_history' FROM n WHERE event_id % 7 = 0
UNION ALL SELECT run_id, epoch + 0.5, 'not_in_trace' FROM n WHERE event_id % 7 = 1""")
def _(t):
    events = run_events(t)
    history = artifacts.epoch_history(events, ["run_id"])
    kept = history.where("epoch % 7 <> 0")
    invented = history.where("epoch % 7 = 1").withColumn("epoch", F.col("epoch") + 0.5)
    return artifacts.trace_problems(kept.unionByName(invented), events)


@query("leaderboard", """WITH r AS (SELECT user_id, count(*) AS n, round(avg(value), 8) AS a FROM events GROUP BY 1)
SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'mae' ELSE 'accuracy' END AS primary_metric,
 CASE WHEN user_id % 5 <> 0 AND user_id % 3 <> 0 THEN CAST(CAST(CAST(a AS VARCHAR) AS DECIMAL(38, 4)) AS DOUBLE) END AS value,
 CASE WHEN user_id % 5 = 0 THEN 'not_completed' WHEN user_id % 3 = 0 THEN 'missing_primary_metric' END AS problem FROM r""")
def _(t):
    board = artifacts.leaderboard(logged_runs(t))
    return board.withColumn("value", F.round("value", 4))


def logged_runs(t):
    """Runs written as JSON lines in the shared folder and read back."""
    # the order of a sum shows in its last bits, and would decide between two roundings of a half
    stats = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.round(F.avg("value"), 8).alias("a"))
    runs = stats.select(
        "run_id",
        F.when(F.col("run_id") % 5 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("run_id") % 3 == 0, "mae").otherwise("accuracy").alias("primary_metric"),
        F.create_map(F.lit("accuracy"), F.col("a"), F.lit("rmse"), F.col("a") * 2).alias("metrics"),
    )
    path = f"{shared_folder(t.spark)}/runs-{t.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    artifacts.write_runs(runs, path)
    schema = "run_id bigint, status string, primary_metric string, metrics map<string,double>"
    return artifacts.read_runs(t.spark, path, schema)


@query("run_reports", """WITH r AS (SELECT user_id, round(avg(value), 8) AS a FROM events GROUP BY 1)
SELECT user_id AS run_id, '# Benchmark Report' || chr(10) || chr(10) || '## Run Manifest' || chr(10) || '- run_id: ' || user_id || chr(10)
 || '- status: ' || CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'completed' END || chr(10)
 || '- primary_metric: ' || CASE WHEN user_id % 3 = 0 THEN 'mae' ELSE 'accuracy' END || chr(10) || chr(10) || '## Metrics' || chr(10)
 || '- accuracy: ' || CAST(CAST(a AS VARCHAR) AS DECIMAL(38, 4)) || chr(10) || '- rmse: ' || CAST(CAST(a * 2 AS VARCHAR) AS DECIMAL(38, 4)) || chr(10) AS report FROM r""")
def _(t):
    return artifacts.run_reports(logged_runs(t))


@query("inspect", """SELECT 'users' AS field, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events
UNION ALL SELECT 'sample_count', count(*) FROM events
UNION ALL SELECT 'label/' || (event_id % 3) || '/' || event_type, count(*) FROM events GROUP BY 1""")
def _(t):
    rows = t.events.select(
        F.col("event_id").alias("sample_id"), "user_id", F.col("event_type").alias("label"),
        (F.col("event_id") % 3).cast("string").alias("split"),
    )
    return artifacts.inspect(rows)
