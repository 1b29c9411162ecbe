"""Model scoring and the reference baseline classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def score_batches(
    df: DataFrame,
    features: str,
    load_model: Callable[[], Callable],
    width: int,
    batch_size: int = 1024,
    out: str = "logits",
) -> DataFrame:
    """Run a user model over feature arrays; the loader runs once per worker."""
    forward = predict_batch_udf(
        load_model,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(out, forward(F.col(features).cast("array<float>")))


def fit_mlp(
    train: DataFrame,
    features: str,
    label: str,
    layers: Sequence[int],
    seed: int = 41,
    epochs: int = 50,
):
    """Fit the multilayer perceptron baseline on feature arrays."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    data = train.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=epochs).fit(data)


def predict_mlp(model, df: DataFrame, features: str, out: str = "pred") -> DataFrame:
    vectors = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(vectors).withColumn(out, F.col("prediction").cast("bigint"))
    return scored.select(*df.columns, out)
