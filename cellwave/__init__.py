"""Spark-native analytics for wireless-sensing corpora.

Manifests are DataFrames, signals are cell tables with one index column per
axis, and every operator is DataFrame -> DataFrame (or Signal -> Signal).
"""

from cellwave.model import Signal

__all__ = ["Signal"]
