"""Metrics of prediction tables, one row per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names per protocol and target column per task kind.
PROTOCOLS = {
    "classification": ("accuracy", ("accuracy", "macro_f1", "correct", "count")),
    "localization": ("mae", ("mae", "rmse", "count")),
    "pose": ("mpjpe", ("mpjpe", "rmse", "count")),
    "respiration": ("rmse", ("rmse", "mae", "count")),
}
TASK_PROTOCOL = {
    "classification": "classification",
    "gait": "classification",
    "pose": "pose",
    "localization": "localization",
    "respiration": "respiration",
}
TASK_TARGET = {
    "classification": "class_label",
    "gait": "identity_label",
    "pose": "pose_keypoints",
    "localization": "position",
    "respiration": "respiration_signal",
}


def argmax(scores: str | Column) -> Column:
    """0-based index of the first largest score."""
    values = F.col(scores) if isinstance(scores, str) else scores
    return F.array_position(values, F.array_max(values)) - 1


def _as_label(df: DataFrame, column: str) -> Column:
    return argmax(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def top_predictions(
    df: DataFrame, logits: str, k: int, labels: dict[int, str] | None = None
) -> DataFrame:
    """One row per kept class: rank, index, softmax score, label; lowest index wins ties."""
    scored = F.transform(
        softmax(F.col(logits).cast("array<double>")),
        lambda p, i: F.struct((-p).alias("neg"), i.alias("index")),
    )
    kept = F.slice(F.array_sort(scored), 1, F.greatest(F.lit(1), F.least(F.lit(k), F.size(logits))))
    out = (
        df.withColumn("_top", kept)
        .select(*df.columns, F.posexplode("_top").alias("rank", "_p"))
        .withColumns({"index": F.col("_p.index"), "score": -F.col("_p.neg")})
        .drop("_p")
    )
    if labels:
        pairs = [F.lit(x) for item in labels.items() for x in item]
        out = out.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col("index")))
    return out


def classification_metrics(
    df: DataFrame, pred: str = "pred", target: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """accuracy, macro_f1, correct, count.

    Everything derives from the confusion counts, so rows shuffle only after
    they were counted per ``(pred, target)``.
    """
    by = list(by)
    confusion = (
        df.select(*by, _as_label(df, pred).alias("_p"), _as_label(df, target).alias("_t"))
        .groupBy(*by, "_p", "_t")
        .agg(F.count("*").alias("_c"))
    )
    hit = F.col("_p") == F.col("_t")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("_p").alias("label"), F.when(hit, F.col("_c")).otherwise(none).alias("tp"),
            F.col("_c").alias("said"), none.alias("real"),
        ),
        F.struct(
            F.col("_t").alias("label"), none.alias("tp"), none.alias("said"), F.col("_c").alias("real")
        ),
    )
    per_label = (
        confusion.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.said").alias("said"), F.sum("s.real").alias("real"))
    )
    precision = F.col("tp") / F.greatest(F.col("said"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("real"), F.lit(1))
    f1 = 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return per_label.groupBy(*by).agg(
        (F.sum("tp") / F.greatest(F.sum("said"), F.lit(1))).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.sum("tp").cast("double").alias("correct"),
        F.sum("said").cast("double").alias("count"),
    )


def _errors(df: DataFrame, pred: str, target: str, by: list[str]) -> DataFrame:
    """One error per element of scalar or array predictions."""
    if dict(df.dtypes)[pred].startswith("array<array"):
        pair = F.arrays_zip(F.flatten(pred).alias("p"), F.flatten(target).alias("t"))
    elif dict(df.dtypes)[pred].startswith("array"):
        pair = F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))
    else:
        return df.select(*by, (F.col(pred) - F.col(target)).cast("double").alias("_e"))
    return df.select(*by, F.explode(pair).alias("_x")).select(
        *by, (F.col("_x.p").cast("double") - F.col("_x.t").cast("double")).alias("_e")
    )


def regression_metrics(
    df: DataFrame, pred: str = "pred", target: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """mae, rmse, count over all elements."""
    return _errors(df, pred, target, list(by)).groupBy(*by).agg(
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.count("_e").cast("double").alias("count"),
    )


def pose_metrics(
    df: DataFrame, pred: str = "pred", target: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """mpjpe, rmse, count (joints) for ``array<array<double>>`` keypoints."""

    def gap(p: Column, t: Column) -> Column:
        squares = F.zip_with(p, t, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)

    pairs = F.zip_with(F.col(pred), F.col(target), lambda p, t: F.struct(
        gap(p, t).alias("sq"), F.size(p).alias("dims")))
    joints = df.select(*by, F.explode(pairs).alias("j"))
    return joints.groupBy(*by).agg(
        F.avg(F.sqrt("j.sq")).alias("mpjpe"),
        F.sqrt(F.sum("j.sq") / F.sum("j.dims")).alias("rmse"),
        F.count("*").cast("double").alias("count"),
    )


def evaluate(df: DataFrame, task_kind: str, pred: str = "predictions", by: Sequence[str] = ()) -> DataFrame:
    """Apply the metric set of the task's protocol to its target column."""
    if task_kind not in TASK_PROTOCOL:
        raise ValueError(f"unknown task kind {task_kind!r}; known: {sorted(TASK_PROTOCOL)}")
    protocol, target = TASK_PROTOCOL[task_kind], TASK_TARGET[task_kind]
    metrics = {"classification": classification_metrics, "pose": pose_metrics}.get(
        protocol, regression_metrics
    )
    primary, names = PROTOCOLS[protocol]
    out = metrics(df, pred, target, by)
    return out.select(*by, *names, F.lit(primary).alias("primary_metric"))


def evaluate_splits(
    df: DataFrame,
    task_kind: str,
    pred: str = "predictions",
    split: str = "split",
    splits: Sequence[str] = ("val", "test"),
) -> DataFrame:
    """Long table ``(metric, value, status)`` with split prefixes and the primary value.

    A split without rows is one ``skipped`` row, not an error.
    """
    scored = evaluate(df.where(F.col(split).isin(*splits)), task_kind, pred, [split])
    primary, names = PROTOCOLS[TASK_PROTOCOL[task_kind]]
    first, *others = splits
    entries = [
        F.struct(F.concat(F.col(split), F.lit(f"_{n}")).alias("metric"), F.col(n).alias("value"))
        for n in names
    ]
    alone = [
        F.struct(F.when(F.col(split) == first, F.lit(n)).alias("metric"), F.col(primary).alias("value"))
        for n in (primary, "primary_metric_value")
    ]
    alone += [
        F.struct(F.when(F.col(split) == s, F.lit(f"{s}_metric_value")).alias("metric"),
                 F.col(primary).alias("value"))
        for s in others
    ]
    long = (
        scored.select(F.explode(F.array(*entries, *alone)).alias("e"))
        .select("e.metric", "e.value", F.lit("evaluated").alias("status"))
        .where(F.col("metric").isNotNull())
    )
    held = df.where(F.col(split).isin(*splits)).agg(F.collect_set(split).alias("_s"))
    wanted = F.array(*map(F.lit, splits))
    skipped = held.select(F.explode(F.array_except(wanted, "_s")).alias("metric")).select(
        "metric", F.lit(None).cast("double").alias("value"), F.lit("skipped").alias("status")
    )
    return long.unionByName(skipped)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _log_total(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def cross_entropy(
    logits: str | Column, target: str | Column, label_smoothing: float = 0.0, weight: Sequence[float] | None = None
) -> Column:
    """``-log softmax(logits)[target]`` per row; smoothing mixes in all classes, ``weight`` scales by class."""
    z, place = _column(logits).cast("array<double>"), _column(target).cast("int") + 1
    loss = _log_total(z) - F.element_at(z, place)
    scale = F.array(*map(F.lit, weight)) if weight else None
    if scale is not None:
        loss = loss * F.element_at(scale, place)
    if label_smoothing:
        each = F.transform(z, lambda x: _log_total(z) - x)
        if scale is not None:
            each = F.zip_with(each, scale, lambda x, w: x * w)
        rest = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(z)
        loss = (1 - label_smoothing) * loss + label_smoothing * rest
    return loss


def nll(log_probs: str | Column, target: str | Column, weight: Sequence[float] | None = None) -> Column:
    """Negative log probability of the target class."""
    place = _column(target).cast("int") + 1
    loss = -F.element_at(_column(log_probs).cast("array<double>"), place)
    return loss * F.element_at(F.array(*map(F.lit, weight)), place) if weight else loss


def _mean_loss(fn: Callable[[Column, Column], Column]) -> Callable[[str | Column, str | Column], Column]:
    """Mean over elements of ``fn(prediction, target)``."""

    def loss(pred: str | Column, target: str | Column) -> Column:
        parts = F.zip_with(_column(pred).cast("array<double>"), _column(target).cast("array<double>"), fn)
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)

    return loss


def _smooth_l1(beta: float = 1.0) -> Callable[[Column, Column], Column]:
    def fn(p: Column, t: Column) -> Column:
        a = F.abs(p - t)
        return F.when(a < beta, 0.5 * a * a / F.lit(float(beta or 1))).otherwise(a - 0.5 * beta)

    return fn


def _huber(delta: float = 1.0) -> Callable[[Column, Column], Column]:
    def fn(p: Column, t: Column) -> Column:
        a = F.abs(p - t)
        return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))

    return fn


def _bce(p: Column, t: Column) -> Column:
    # logarithms are held at -100, so that certain errors stay finite
    return -(t * F.greatest(F.log(p), F.lit(-100.0)) + (1 - t) * F.greatest(F.log1p(-p), F.lit(-100.0)))


def _bce_logits(z: Column, t: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


#: Losses by name: each takes its parameters and gives a function of prediction and target columns.
LOSSES: dict[str, Callable[..., Callable[[str | Column, str | Column], Column]]] = {
    "cross_entropy": lambda **kw: lambda p, t: cross_entropy(p, t, **kw),
    "nll_loss": lambda **kw: lambda p, t: nll(p, t, **kw),
    "mse_loss": lambda: _mean_loss(lambda p, t: (p - t) * (p - t)),
    "l1_loss": lambda: _mean_loss(lambda p, t: F.abs(p - t)),
    "smooth_l1_loss": lambda beta=1.0: _mean_loss(_smooth_l1(beta)),
    "huber_loss": lambda delta=1.0: _mean_loss(_huber(delta)),
    "binary_cross_entropy": lambda: _mean_loss(_bce),
    "binary_cross_entropy_with_logits": lambda: _mean_loss(_bce_logits),
}


def row_loss(objective: str, **params) -> Callable[[str | Column, str | Column], Column]:
    """Loss by name, with or without the ``_loss`` suffix, and its parameters."""
    name = objective.strip()
    for candidate in (name, f"{name}_loss"):
        if candidate in LOSSES:
            return LOSSES[candidate](**params)
    raise ValueError(f"unsupported loss {objective!r}; available: {sorted(LOSSES)}")


def mean_of_batch_means(
    df: DataFrame, loss: Column, batch: str = "batch", by: Sequence[str] = ()
) -> DataFrame:
    """Average loss per batch, then over batches (not per sample)."""
    per_batch = df.groupBy(*by, batch).agg(F.avg(loss).alias("_mean"), F.count("*").alias("_n"))
    return per_batch.groupBy(*by).agg(
        F.avg("_mean").alias("loss"),
        F.count("*").alias("batches"),
        F.sum("_n").alias("samples"),
    )
