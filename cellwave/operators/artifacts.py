"""Run logs, digests, reports and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_FIELDS = ("epoch", "train_loss", "epoch_duration_sec")


def epoch_history(events: DataFrame, by: Sequence[str] = (), metric: str | None = None) -> DataFrame:
    """The epoch_end rows of an event log as numbers."""
    wanted = ["epoch", "train_loss", *([metric] if metric else []), "val_loss", "epoch_duration_sec"]
    kept = [c for c in wanted if c in events.columns]
    return events.where(F.col("event") == "epoch_end").select(
        *by, *(F.col(c).cast("double").alias(c) for c in kept)
    )


def trace_problems(
    history: DataFrame, events: DataFrame, by: Sequence[str] = ("run_id",),
    allowed: Sequence[str] = ("epoch_end", "split_start", "split_end"),
) -> DataFrame:
    """Rows where history and event log disagree, one per finding."""
    by = list(by)
    name = F.col("event")
    lacks = F.lit(False)
    for f in EVENT_FIELDS:
        lacks = lacks | F.col(f).isNull()
    reason = (
        F.when(name.isNull(), "missing_event")
        .when(~name.isin(*allowed), "unsupported_event")
        .when((name == "epoch_end") & lacks, "missing_field")
        .when((name != "epoch_end") & F.col("split").isNull(), "missing_split")
    )
    own = events.withColumn("problem", reason).where(F.col("problem").isNotNull()).select(
        *by, F.col("epoch").cast("double").alias("epoch"), "problem"
    )
    left = history.select(*by, F.col("epoch").cast("double").alias("epoch"), F.lit(1).alias("_h"))
    right = events.where(name == "epoch_end").select(
        *by, F.col("epoch").cast("double").alias("epoch"), F.lit(1).alias("_e")
    )
    unmatched = left.join(right, on=[*by, "epoch"], how="full_outer").select(
        *by, "epoch",
        F.when(F.col("_h").isNull(), "not_in_history").when(F.col("_e").isNull(), "not_in_trace").alias("problem"),
    ).where(F.col("problem").isNotNull())
    return own.unionByName(unmatched)


def multiset_digest(row_hash: Column, name: str = "digest") -> list[Column]:
    """Order-free digest aggregates of a sha-256 hex column.

    Each 32-bit lane of the hashes is summed exactly, so partial sums combine
    and no group of hashes is ever collected.
    """
    lanes = [
        F.sum(F.conv(F.substring(row_hash, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
        for i in range(8)
    ]
    text = F.concat_ws(",", F.count("*").cast("string"), *(x.cast("string") for x in lanes))
    return [F.sha2(text, 256).alias(name), F.count("*").alias("n")]


def dataset_digest(df: DataFrame) -> DataFrame:
    """Stable digest of manifest rows: columns sorted by name, rows in any order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.agg(*multiset_digest(row))


def row_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def merkle_tree(df: DataFrame, key: str) -> DataFrame:
    """``level, bucket, digest, n``: digests of 65536 hash buckets of the key (level 2), of 256 groups of them, and of all.

    A bucket is two and four hex digits of the key's sha-256. Buckets are order-free sums that combine before they
    move; a group digests its buckets in order, the root (level 0, bucket '') its groups. Empty buckets have no row.
    """
    place = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 4)
    rows = df.select(place.alias("bucket"), row_hash(df).alias("h"))
    leaves = rows.groupBy("bucket").agg(*multiset_digest(F.col("h")))
    group = _parents(leaves, F.substring("bucket", 1, 2))
    root = _parents(group, F.lit(""))
    parts = [(2, leaves), (1, group), (0, root)]
    tables = [t.select(F.lit(level).alias("level"), "bucket", "digest", "n") for level, t in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _parents(nodes: DataFrame, bucket: Column) -> DataFrame:
    """Digests of at most 256 nodes each."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest")))
    return nodes.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(lines, ","), 256).alias("digest"), F.sum("n").alias("n"))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """``bucket``: those of level 2 that differ, looked for under differing groups only; none where the roots agree."""

    def differing(level: int, above: DataFrame | None) -> DataFrame:
        a, b = (t.where(F.col("level") == level).select("bucket", F.col("digest").alias(d)) for t, d in ((left, "_a"), (right, "_b")))
        if above is not None:
            parent = F.substring("bucket", 1, 2 * level - 2)
            a, b = (t.join(F.broadcast(above), parent == F.col("_above"), "left_semi") for t in (a, b))
        both = a.join(b, "bucket", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
        return both.select(F.col("bucket").alias("_above"))

    groups = differing(1, differing(0, None))
    return differing(2, groups).withColumnRenamed("_above", "bucket")


def digest_diff(left: DataFrame, right: DataFrame, key: str, left_tree: DataFrame, right_tree: DataFrame) -> DataFrame:
    """``key, change``: rows ``added``, ``removed`` or ``changed`` from left to right.

    Only rows of differing buckets are compared, of which there are at most 65536. Rows that share a key are compared
    as a bag.
    """
    buckets = F.broadcast(differing_buckets(left_tree, right_tree))
    place = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 4)

    def opened(df: DataFrame, digest: str) -> DataFrame:
        rows = df.select(key, place.alias("bucket"), row_hash(df).alias("h")).join(buckets, "bucket", "left_semi")
        return rows.groupBy(key).agg(multiset_digest(F.col("h"))[0].alias(digest))

    a, b = opened(left, "_a"), opened(right, "_b").withColumnRenamed(key, "_key")
    both = a.join(b, F.col(key).eqNullSafe(F.col("_key")), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(F.when(F.col("_a").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key), change.alias("change"))


def file_checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """sha-256 per file of a binaryFile listing."""
    return files.withColumn("digest", F.sha2(F.col(content), 256)).drop(content)


def data_version(files: DataFrame, content: str = "content") -> DataFrame:
    """One digest over file names and contents."""
    name = F.element_at(F.split("path", "/"), -1)
    row = F.sha2(F.concat_ws("|", name, F.sha2(F.col(content), 256)), 256)
    return files.agg(*multiset_digest(row, "data_version"))


def verify_checksums(checksums: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare with an expected ``(path, expected)`` table; both sides kept."""
    return checksums.join(expected, on="path", how="full_outer").select(
        "path",
        F.when(F.col("digest").isNull(), "missing")
        .when(F.col("expected").isNull(), "unlisted")
        .when(F.col("digest") == F.col("expected"), "ok")
        .otherwise("mismatch")
        .alias("state"),
    )


def write_runs(runs: DataFrame, path: str) -> None:
    """Persist run manifests as JSON lines."""
    runs.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Primary metric per completed run.

    ``runs(run_id, status, primary_metric, metrics MAP<STRING,DOUBLE>)``; a run
    whose metrics lack the primary one is reported with a problem.
    """
    value = F.try_element_at(F.col("metrics"), F.col("primary_metric"))
    return runs.select(
        "run_id",
        "primary_metric",
        F.when(F.coalesce(F.col("status"), F.lit("")).isin("", "completed"), value).alias("value"),
        F.when(~F.coalesce(F.col("status"), F.lit("")).isin("", "completed"), "not_completed")
        .when(value.isNull(), "missing_primary_metric")
        .alias("problem"),
    )


def markdown_report(run: dict, metrics: dict, **sections: dict) -> str:
    """A small text report of one run, from one aggregate row."""
    blocks = [("Run Manifest", run), ("Metrics", metrics)]
    blocks += [(name.title(), body) for name, body in sections.items() if body]
    lines = ["# Benchmark Report", ""]
    for title, body in blocks:
        lines += [f"## {title}", *(f"- {k}: {v}" for k, v in body.items()), ""]
    return "\n".join(lines).rstrip() + "\n"


def run_reports(runs: DataFrame) -> DataFrame:
    """``run_id, report``: the same text per run, for any number of ``leaderboard`` input rows."""
    metrics = F.transform(
        F.array_sort(F.map_entries("metrics")), lambda e: F.format_string("- %s: %.4f", e["key"], e["value"])
    )
    facts = [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("run_id", "status", "primary_metric")]
    head = F.array(F.lit("# Benchmark Report"), F.lit(""), F.lit("## Run Manifest"), *facts, F.lit(""), F.lit("## Metrics"))
    text = F.array_join(F.concat(head, F.coalesce(metrics, F.array().cast("array<string>"))), "\n")
    return runs.select("run_id", F.concat(text, F.lit("\n")).alias("report"))


def inspect(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """View summary and per-split label counts in one long table."""
    from cellwave.operators.labels import label_histogram
    from cellwave.operators.manifest import view_summary

    counts = label_histogram(df, split, label).select(
        F.concat_ws("/", F.lit("label"), F.col(split), F.col(label).cast("string")).alias("field"), "n"
    )
    return view_summary(df).unionByName(counts)
