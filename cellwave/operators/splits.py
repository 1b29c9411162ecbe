"""Train/val/test assignment for manifests.

Shuffles order rows by ``md5(seed|sample)``: counts and determinism match a
seeded shuffle, membership does not depend on partitioning or row order.
Rounding of ``n * ratio`` is half-even everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import half_even, shuffle_key
from cellwave.operators.manifest import annotate_split
from cellwave.operators.ordinal import first_rows_per_key, global_ordinal


def _check_ratio(ratio: float) -> None:
    if not 0.0 < float(ratio) < 1.0:
        raise ValueError(f"ratio must be between 0 and 1, got {ratio}")


def _cutoff(n: int, ratio: float) -> int:
    return max(1, min(n - 1, round(n * ratio)))


def group_split(
    df: DataFrame,
    group_by: str | Sequence[str],
    ratio: float = 0.8,
    left_values: Sequence | None = None,
    right_values: Sequence | None = None,
) -> DataFrame:
    """Add ``side`` so that no group is on both sides.

    Without explicit values, groups are ordered by their string form and the
    first ``round(n * ratio)`` go left.
    """
    fields = [group_by] if isinstance(group_by, str) else list(group_by)
    if not fields:
        raise ValueError("group_by must not be empty")
    if left_values is not None or right_values is not None:
        if len(fields) != 1:
            raise ValueError("explicit sides need a single group field")
        return _explicit_sides(df, fields[0], left_values, right_values)
    _check_ratio(ratio)
    groups, n = global_ordinal(
        df.select(*fields).distinct(), [F.col(f).cast("string") for f in fields], name="_ord"
    )
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    if not groups.where(missing).isEmpty():
        raise ValueError(f"group_split requires every row to define {fields}")
    if n < 2:
        raise ValueError("group_split requires at least two distinct metadata groups")
    side = F.when(F.col("_ord") < _cutoff(n, ratio), "left").otherwise("right")
    return df.join(groups.select(*fields, side.alias("side")), on=fields)


def _explicit_sides(df, field, left_values, right_values) -> DataFrame:
    if left_values is not None and right_values is not None:
        both = set(left_values) & set(right_values)
        if both:
            raise ValueError(f"overlapping group assignments: {sorted(map(str, both))}")
    # a side without a list takes the groups that the other does not name; null groups have none
    value = F.col(field)
    is_left = value.isin(list(left_values)) if left_values is not None else ~value.isin(list(right_values))
    is_right = value.isin(list(right_values)) if right_values is not None else ~value.isin(list(left_values))
    return df.withColumn("side", F.when(is_left, "left").when(is_right, "right"))


def require_group_sides(
    df: DataFrame, field: str, left_values: Sequence | None = None, right_values: Sequence | None = None
) -> None:
    """Raise when a row has no group, a group no side, or a side no group."""
    found = group_side_problems(df, field, left_values, right_values).take(20)
    if found:
        raise ValueError("group sides: " + "; ".join(f"{r['problem']} {r['group']}" for r in found))


def group_side_problems(
    df: DataFrame,
    field: str,
    left_values: Sequence | None = None,
    right_values: Sequence | None = None,
) -> DataFrame:
    """One row per violated rule: missing key, uncovered group, empty side."""
    groups = df.select(field).distinct()
    null_rows = groups.where(F.col(field).isNull()).select(
        F.lit("missing_key").alias("problem"), F.lit(None).cast("string").alias("group")
    )
    problems = null_rows
    if left_values is not None and right_values is not None:
        assigned = [*left_values, *right_values]
        uncovered = groups.where(F.col(field).isNotNull() & ~F.col(field).isin(assigned))
        problems = problems.unionByName(
            uncovered.select(
                F.lit("uncovered").alias("problem"), F.col(field).cast("string").alias("group")
            )
        )
    sides = _explicit_sides(groups, field, left_values, right_values).agg(
        F.count_if(F.col("side") == "left").alias("l"),
        F.count_if(F.col("side") == "right").alias("r"),
    )
    empty = sides.where((F.col("l") == 0) | (F.col("r") == 0)).select(
        F.lit("empty_side").alias("problem"),
        F.when(F.col("l") == 0, "left").otherwise("right").alias("group"),
    )
    return problems.unionByName(empty)


def sorted_group_partition(
    df: DataFrame, group: str, ratio: float, order: str = "string", single_group: str = "error"
) -> DataFrame:
    """Cut the sorted unique groups at the ratio; ``order`` is string or natural.

    ``single_group='train'`` puts one lone group in train. A null group is a
    group of its own, ordered by its text form.
    """
    _check_ratio(ratio)
    if order == "string":
        key = F.coalesce(F.col(group).cast("string"), F.lit("None"))
    else:
        key = F.col(group)
    groups, n = global_ordinal(df.select(group).distinct(), [key], name="_ord")
    if n == 1 and single_group == "train":
        return df.withColumn("split", F.lit("train"))
    cut = _cutoff(n, ratio) if n else 0
    sides = groups.select(
        F.col(group).alias("_g"), F.when(F.col("_ord") < cut, "train").otherwise("val").alias("split")
    )
    return df.join(sides, df[group].eqNullSafe(sides["_g"])).drop("_g")


def _take_by_label(
    df: DataFrame, label: str, sample: str, seed: int, tag: str, take, name: str, pool: Sequence[str] = ()
) -> DataFrame:
    """Mark the first ``take(n)`` rows of every label in shuffled order."""
    hashed = df.withColumn("_hash", shuffle_key(sample, seed, tag))
    # the hash prefix cuts a dominant label into 4096 even buckets
    return first_rows_per_key(
        hashed, [*pool, label], ["_hash", sample], F.substring("_hash", 1, 3), take, name
    ).drop("_hash")


def _train_count(ratio: float):
    def take(n: Column) -> Column:
        cut = F.greatest(F.lit(1), F.least(n - 1, half_even(n * F.lit(float(ratio)))))
        return F.when(n == 1, F.lit(1)).otherwise(cut)

    return take


def stratified_train_val(
    df: DataFrame,
    label: str,
    ratio: float,
    seed: int,
    sample: str = "sample_id",
    ensure_val: bool = False,
    held: Column | None = None,
) -> DataFrame:
    """Per-label shuffled cut; a single-sample label stays in train.

    ``ensure_val`` moves the row of the largest label value to val when every
    label has one sample, so that val is never empty for two rows or more.
    Rows where ``held`` gives a name take that split and do not count.
    """
    if not ensure_val:
        _check_ratio(ratio)
    rows = df if held is None else df.withColumn("_held", held)
    pool = [] if held is None else ["_held"]
    marked = _take_by_label(rows, label, sample, seed, "", _train_count(ratio), "_train", pool)
    is_train = F.col("_train")
    if ensure_val:
        free = rows if held is None else rows.where(F.col("_held").isNull())
        sizes = free.groupBy(label).agg(F.count("*").alias("_c"))
        # null unless every label is single and there are two rows or more
        moved = sizes.agg(
            F.when((F.max("_c") == 1) & (F.sum("_c") > 1), F.max(label)).alias("_moved")
        ).scalar()
        is_train = is_train & ~F.col(label).eqNullSafe(moved)
    split = F.when(is_train, "train").otherwise("val")
    if held is not None:
        split = F.coalesce(F.col("_held"), split)
    return marked.withColumn("split", split).drop("_train", "_held")


def stratified_trainval_test(
    df: DataFrame,
    label: str,
    test_ratio: float,
    seed: int,
    sample: str = "sample_id",
    pos: str = "pos",
) -> DataFrame:
    """Labels with three rows or more give test rows; never an empty test set
    when three rows exist: the first row of the largest label moves."""
    if not 0.0 <= float(test_ratio) < 1.0:
        raise ValueError(f"test_ratio must be in [0, 1), got {test_ratio}")
    if test_ratio == 0.0:
        return df.withColumn("split", F.lit("trainval"))

    def take(n: Column) -> Column:
        proposed = F.greatest(F.lit(1), F.least(n - 2, half_even(n * F.lit(float(test_ratio)))))
        return F.when(n >= 3, proposed).otherwise(F.lit(0))

    marked = _take_by_label(df, label, sample, seed, "test", take, "_test")
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"), F.min(pos).alias("_first"))
    moved = sizes.agg(
        F.when(
            (F.max("_c") < 3) & (F.sum("_c") >= 3),
            F.min_by("_first", F.struct(-F.col("_c"), F.col(label))),
        ).alias("_moved")
    ).scalar()
    is_test = F.col("_test") | F.coalesce(F.col(pos) == moved, F.lit(False))
    return marked.withColumn("split", F.when(is_test, "test").otherwise("trainval")).drop("_test")


def declared_split(
    df: DataFrame,
    contract: dict[str, dict[str, Sequence | None]],
    label: str,
    train_ratio: float,
    seed: int,
    sample: str = "sample_id",
    split_scheme: str | None = None,
) -> DataFrame:
    """Rows go to every split whose field lists they satisfy; val is cut from train.

    A null list means no constraint on that field.
    """
    tags = []
    for split, fields in contract.items():
        hit = F.lit(True)
        for field, allowed in fields.items():
            if allowed is not None:
                hit = hit & F.coalesce(F.col(field).isin(list(allowed)), F.lit(False))
        tags.append(F.when(hit, F.lit(split)))
    placed = df.withColumn("_declared", F.explode(F.array_compact(F.array(*tags))))
    return _carve_val(placed, label, train_ratio, seed, sample, split_scheme)


def source_split(
    df: DataFrame,
    label: str,
    train_ratio: float,
    seed: int,
    split: str = "source_split",
    heldout: str = "test",
    sample: str = "sample_id",
    split_scheme: str | None = None,
) -> DataFrame:
    """The held-out part stays test; the other rows are cut by label."""
    placed = df.withColumn(
        "_declared", F.when(F.col(split).eqNullSafe(F.lit(heldout)), "test").otherwise("train")
    )
    return _carve_val(placed, label, train_ratio, seed, sample, split_scheme)


def _carve_val(placed, label, ratio, seed, sample, scheme) -> DataFrame:
    held = F.when(F.col("_declared") != "train", F.col("_declared"))
    carved = stratified_train_val(placed, label, ratio, seed, sample, held=held).drop("_declared")
    return annotate_split(carved, F.col("split"), split_scheme=scheme)


def metadata_split(
    df: DataFrame,
    split: str = "split",
    required: Sequence[str] = ("train", "test"),
    optional: Sequence[str] = ("val",),
) -> DataFrame:
    """Keep rows whose declared split is supported; ``split_problems`` tells what is missing."""
    return df.where(F.col(split).isin([*required, *optional]))


def split_problems(df: DataFrame, split: str = "split", required: Sequence[str] = ("train", "test")) -> DataFrame:
    """``problem, detail``: a row for each required split that no row declares."""
    found = df.agg(F.collect_set(F.when(F.col(split).isin(list(required)), F.col(split))).alias("found"))
    wanted = F.array(*(F.lit(r) for r in required))
    lacking = found.select(F.explode(F.array_except(wanted, "found")).alias("detail"))
    return lacking.select(F.lit("missing_split").alias("problem"), "detail")


def require_splits(df: DataFrame, split: str = "split", required: Sequence[str] = ("train", "test")) -> None:
    """Raise when a required split is missing."""
    lacking = sorted(r["detail"] for r in split_problems(df, split, required).collect())
    if lacking:
        raise ValueError(f"required splits are missing: {lacking}")


def id_list_split(
    df: DataFrame, ids: DataFrame, sample: str = "sample_id", listed: str = "id"
) -> DataFrame:
    """Rows whose normalised id is listed; a leading ``./`` does not count."""

    def normal(c: str) -> Column:
        return F.regexp_replace(F.trim(F.col(c).cast("string")), r"^(\./)+", "")

    wanted = ids.select(normal(listed).alias("_id")).distinct()
    return df.join(wanted, normal(sample) == F.col("_id"), "left_semi")


def dataset_from_samples(
    df: DataFrame,
    target: str = "target",
    pos: str = "pos",
    sample: str = "sample_id",
    test_ratio: float | None = 0.1,
    train_ratio: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """Encode targets and assign train/val/test in one plan."""
    from cellwave.operators.labels import encode_first_appearance

    encoded = encode_first_appearance(df, target, pos)
    held = None
    if test_ratio:
        encoded = stratified_trainval_test(encoded, "label", test_ratio, seed, sample, pos)
        held = F.when(F.col("split") == "test", F.col("split"))
    return stratified_train_val(encoded, "label", train_ratio, seed, sample, ensure_val=True, held=held)
