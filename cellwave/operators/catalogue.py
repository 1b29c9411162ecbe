"""Corpus tables joined with capture listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_listing(
    metas: DataFrame,
    listing: DataFrame,
    keys: Sequence[str] = ("date", "user_id"),
    users: str | None = None,
    allow: dict[str, Sequence | None] | None = None,
    skip: Sequence[str] = (),
    path: str = "path",
) -> DataFrame:
    """Expand metadata rows over their users and join the files they own.

    ``users`` names an array column to explode into ``user_id``; ``allow``
    holds per-field value lists; a path with a skip substring is dropped.
    """
    rows = metas.withColumn("user_id", F.explode(users)).drop(users) if users else metas
    kept = listing
    for text in skip:
        kept = kept.where(~F.contains(F.col(path), F.lit(text)))
    joined = rows.join(kept, on=list(keys))
    for field, values in (allow or {}).items():
        if values is not None:
            joined = joined.where(F.col(field).isin(list(values)))
    return joined


def parse_index_ranges(spec: Column) -> Column:
    """``"1:5,8,non"`` to the sorted set of indexes; ranges include both ends."""
    tokens = F.filter(
        F.transform(F.split(spec, ","), lambda t: F.trim(t)),
        lambda t: t.rlike(r"^[0-9]+(\s*:\s*[0-9]+)?$"),
    )

    def span(t: Column) -> Column:
        ends = F.split(t, ":")
        low = F.trim(ends.getItem(0)).cast("bigint")
        high = F.trim(F.coalesce(F.get(ends, F.lit(1)), ends.getItem(0))).cast("bigint")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, span))))


def expand_index_ranges(
    df: DataFrame, keys: Sequence[str], specs: dict[str, str]
) -> DataFrame:
    """One row per ``(keys, index)``; of several labels the last in ``specs`` wins.

    Specs are dealt by key before they grow to indexes, so that tasks share the work however few files hold them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = F.array(
        *(
            F.struct(F.lit(rank).alias("rank"), parse_index_ranges(F.coalesce(F.col(c), F.lit(""))).alias("ids"))
            for rank, c in enumerate(specs.values())
        )
    )
    rows = df.select(*keys, *specs.values()).repartition(parts, *keys).select(*keys, F.explode(tagged).alias("t")).select(
        *keys, "t.rank", F.explode("t.ids").alias("index")
    )
    last = rows.groupBy(*keys, "index").agg(F.max("rank").alias("rank"))
    labels = F.array(*(F.lit(label) for label in specs))
    return last.select(*keys, "index", F.get(labels, F.col("rank")).alias("label"))


def select_by_names(records: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return records.join(names.select(key).distinct(), on=key, how="left_semi")


def scan_sequences(
    listing: DataFrame, pattern: str, fields: Sequence[str], allow: dict[str, Sequence] | None = None
) -> DataFrame:
    """Directory-tree levels from the path, filtered by allow-lists."""
    parsed = listing.withColumns(
        {f: F.regexp_extract("path", pattern, i + 1) for i, f in enumerate(fields)}
    ).where(F.col(fields[0]) != "")
    for field, values in (allow or {}).items():
        parsed = parsed.where(F.col(field).isin(list(values)))
    return parsed


def node_paths(
    df: DataFrame, ids: Sequence[str], pattern: str = r"^node_(\d+)_wifi_data_path$"
) -> DataFrame:
    """Wide per-node path columns to one row per node; empty paths drop."""
    import re

    found = [(c, re.match(pattern, c)) for c in df.columns]
    nodes = [(c, int(m.group(1))) for c, m in found if m]
    entries = F.array(
        *(F.struct(F.lit(n).alias("node_id"), F.trim(F.col(c)).alias("path")) for c, n in nodes)
    )
    return (
        df.select(*ids, F.explode(entries).alias("e"))
        .select(*ids, "e.node_id", "e.path")
        .where(F.col("path").isNotNull() & (F.col("path") != ""))
    )
