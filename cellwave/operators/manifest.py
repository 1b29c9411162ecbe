"""Relational operators on sample manifests."""

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cellwave.operators.ordinal import first_rows_per_key, global_ordinal

USER_FIELDS = ("user_id", "subject", "user")
ROOM_FIELDS = ("room", "environment")
DATE_FIELDS = ("date", "collection_date", "session_date")


def row_match(df: DataFrame, predicate: Column | None = None, **equals) -> Column:
    """Predicate AND equalities; a missing column reads as null, null equals null."""
    condition = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    for field, wanted in equals.items():
        held = F.col(field) if field in df.columns else F.lit(None)
        condition = condition & held.eqNullSafe(F.lit(wanted))
    return condition


def python_predicate(fn: Callable, *fields: str) -> Column:
    """Wrap a Python row predicate as one vectorised boolean column."""

    @pandas_udf("boolean")
    def check(*series: pd.Series) -> pd.Series:
        return pd.Series([bool(fn(dict(zip(fields, row)))) for row in zip(*series)])

    return check(*(F.col(f) for f in fields))


def filter_rows(df: DataFrame, predicate: Column | None = None, **equals) -> DataFrame:
    return df.where(row_match(df, predicate, **equals))


def split_matched(df: DataFrame, predicate: Column | None = None, **equals) -> DataFrame:
    """Label each row ``matched`` or ``remainder`` in one pass."""
    hit = row_match(df, predicate, **equals)
    return df.withColumn("part", F.when(hit, "matched").otherwise("remainder"))


def select_positions(df: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at the given positions; a position listed twice gives the row twice."""
    return df.join(positions, on=pos)


def limit_rows(df: DataFrame, n: int | None, pos: str = "pos") -> DataFrame:
    if n is None:
        return df
    if n <= 0:
        raise ValueError("limit expects a positive integer")
    return df.orderBy(pos).limit(n)


def key_parts(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Give every distinct key a part number by first appearance; null is a part."""
    firsts = df.groupBy(key).agg(F.min(pos).alias("_first"))
    numbered, _ = global_ordinal(firsts, ["_first"], name="part")
    same = df[key].eqNullSafe(numbered[key])
    return df.join(numbered, same).select(*(df[c] for c in df.columns), "part")


def get_split(
    df: DataFrame,
    split: str,
    split_field: str | None = None,
    candidate_fields: Sequence[str] = ("split",),
) -> DataFrame:
    """First non-null candidate partition field decides; other markers are the fallback."""
    fields = [f for f in ((split_field,) if split_field else candidate_fields) if f.strip()]
    fields = fields or ["split"]
    held = [F.col("partitions").getItem(f) for f in fields]
    primary = F.coalesce(*held) == F.lit(split)
    fallback = F.lit(False)
    for h in held:
        fallback = fallback | F.coalesce(h == F.lit(split), F.lit(False))
    if "split" in fields:
        for c in ("split", "assigned_split"):
            if c in df.columns:
                fallback = fallback | F.coalesce(F.col(c) == F.lit(split), F.lit(False))
    # the fallback applies only when no row matches the primary rule
    any_primary = df.agg(F.coalesce(F.bool_or(primary), F.lit(False)).alias("_any")).scalar()
    return df.where(F.when(any_primary, F.coalesce(primary, F.lit(False))).otherwise(fallback))


def require_split(df: DataFrame, split: str, candidate_fields: Sequence[str] = ("split",)) -> None:
    """Raise when the split is empty, naming the fields that exist."""
    if get_split(df, split, candidate_fields=candidate_fields).isEmpty():
        fields = df.select(F.explode(F.map_keys("partitions")).alias("f")).distinct()
        names = fields.agg(F.array_sort(F.collect_set("f")).alias("names")).first()["names"]
        raise ValueError(f"split {split!r} is not available; partition fields: {names}")


def first_present(df: DataFrame, fields: Sequence[str]) -> Column:
    present = [F.col(f).cast("string") for f in fields if f in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def summary_values(df: DataFrame, extra: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct ``(field, value)`` rows of a view: users, rooms, dates, declared fields."""
    users, rooms = first_present(df, USER_FIELDS), first_present(df, ROOM_FIELDS)
    digits = r"^[0-9]+$"
    pairs = [
        ("users", F.when(users.rlike(digits), users.cast("decimal(38,0)").cast("string"))),
        ("rooms", F.when(rooms.rlike(digits), rooms.cast("decimal(38,0)").cast("string"))),
        ("dates", first_present(df, DATE_FIELDS)),
    ]
    pairs += [(name, first_present(df, f)) for name, f in (extra or {}).items()]
    entries = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in pairs))
    return (
        df.select(F.explode(entries).alias("e"))
        .select("e.field", "e.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def view_summary(df: DataFrame, extra: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Sample count plus the number of distinct values per summary field."""
    counts = summary_values(df, extra).groupBy("field").agg(F.count("*").alias("n"))
    return counts.unionByName(
        df.agg(F.count("*").alias("n")).select(F.lit("sample_count").alias("field"), "n")
    )


def split_mapping(
    df: DataFrame,
    split: str = "split",
    splits: Sequence[str] = ("train", "val", "test"),
    max_per_split: int | None = None,
    pos: str = "pos",
    bucket: Column | None = None,
) -> DataFrame:
    """Keep declared splits, at most ``max_per_split`` rows each in position order."""
    kept = df.where(F.col(split).isin(*splits))
    if max_per_split is None:
        return kept
    bucket = F.floor(F.col(pos) / F.lit(1 << 20)) if bucket is None else bucket
    capped = first_rows_per_key(
        kept, [split], [pos], bucket, lambda n: F.least(n, F.lit(max_per_split)), "_first"
    )
    return capped.where("_first").drop("_first")


def missing_splits(df: DataFrame, required: Sequence[str], split: str = "split") -> list[str]:
    """Required split names that hold no row (an action over distinct names only)."""
    held = df.where(F.col(split).isin(*required)).select(split).distinct().collect()
    return sorted(set(required) - {r[0] for r in held})


def annotate_split(
    df: DataFrame,
    split: str | Column,
    split_scheme: str | None = None,
    task_binding: str | None = None,
) -> DataFrame:
    """Write the canonical split markers of one split."""
    name = F.lit(split) if isinstance(split, str) else split
    empty = F.create_map().cast("map<string,string>")
    past = F.coalesce(F.col("partitions"), empty) if "partitions" in df.columns else empty
    kept = F.map_filter(past, lambda k, _: k != F.lit("split"))
    marked = df.withColumns(
        {
            "partitions": F.map_concat(kept, F.create_map(F.lit("split"), name)),
            "split": name,
            "assigned_split": name,
        }
    )
    if split_scheme:
        marked = marked.withColumn("split_scheme", F.lit(split_scheme))
    if task_binding:
        marked = marked.withColumn("task_binding", F.lit(task_binding))
    return marked


def flatten_records(
    df: DataFrame,
    coordinates: Sequence[str] = (),
    columns: Sequence[str] = (),
    groups: Sequence[str] = (),
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Declared map entries become columns; partitions become ``split/<name>``."""
    out = [F.col("sample_id")]
    for source, names in (("coordinates", coordinates), ("columns", columns), ("groups", groups)):
        out += [F.col(source).getItem(n).alias(n) for n in names]
    out += [F.col("partitions").getItem(n).alias(f"split/{n}") for n in partitions]
    return df.select(*out)


def coerce_records(
    df: DataFrame,
    coordinates: Sequence[str] = (),
    columns: Sequence[str] = (),
    groups: Sequence[str] = (),
    partitions: Sequence[str] = (),
    payload_refs: Sequence[str] = (),
    extras: Sequence[str] = (),
) -> DataFrame:
    """Shape a flat table into canonical manifest records with typed maps."""

    def packed(names: Sequence[str]) -> Column:
        if not names:
            return F.create_map().cast("map<string,string>")
        pairs = [p for n in names for p in (F.lit(n), F.col(n).cast("string"))]
        # an absent field is an absent key
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    groups_of = {
        "coordinates": coordinates, "columns": columns, "groups": groups,
        "partitions": partitions, "payload_refs": payload_refs, "extras": extras,
    }
    return df.select("sample_id", *(packed(names).alias(n) for n, names in groups_of.items()))


def select_input(
    df: DataFrame, modality: str, node_id: int | None = None
) -> DataFrame:
    """Project session rows to one modality (and node); rows without it drop."""
    name = modality if node_id is None else f"{modality}/{node_id}"
    return df.withColumn("payload", F.col("payload_refs").getItem(name)).where(
        F.col("payload").isNotNull()
    )


def bridge_target_fields(df: DataFrame, bridge: dict[str, str]) -> DataFrame:
    """Copy a dataset's own target field to the canonical name unless present."""
    added = {
        canonical: F.col(own)
        for canonical, own in bridge.items()
        if canonical not in df.columns and own in df.columns
    }
    return df.withColumns(added) if added else df


def resolve_sample_ids(
    df: DataFrame, pos: str = "pos", fields: Sequence[str] = ("sample_id", "sample", "record_id")
) -> DataFrame:
    """First present id field when every row has one, else ``sample-%06d`` of the position."""
    held = [F.col(f).cast("string") for f in fields if f in df.columns]
    fallback = F.format_string("sample-%06d", F.col(pos))
    if not held:
        return df.withColumn("resolved_id", fallback)
    found = F.coalesce(*held)
    complete = df.agg(F.coalesce(F.bool_and(found.isNotNull()), F.lit(True)).alias("_all")).scalar()
    return df.withColumn("resolved_id", F.when(complete, found).otherwise(fallback))
