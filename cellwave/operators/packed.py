"""Statistics of cells by a packed cell table, from one read and without moving single cells.

Cells of a statistic's group are packed into rows of up to ``CHUNK_CELLS`` cells, by equal spans of every axis inside
the group. Partial packing comes before the exchange. Where declared axis sizes bound a group to one chunk, its
statistics are aggregated along with it and that is all. Otherwise they are made from the packed rows, whose exchange
both sides of the join share, and only packed rows meet the small table of statistics: a hot sample is many chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import null_safe
from cellwave.model import Signal

CHUNK_CELLS = 1 << 16
_CELLS = "_cells"


def chunk_spans(sig: Signal, keys: list[str]) -> dict[str, int] | None:
    """The span of each inner axis in a chunk; None where one chunk holds a whole group."""
    inner = [a for a in sig.axes if a not in keys]
    declared = math.prod(sig.sizes.get(a, 1) for a in inner)
    open_ = [a for a in inner if a not in sig.sizes]
    if not open_ and declared <= CHUNK_CELLS:
        return None
    if declared > CHUNK_CELLS:
        open_, declared = inner, 1
    span = max(int((CHUNK_CELLS // declared) ** (1 / len(open_))), 1)
    return dict.fromkeys(open_, span)


def with_statistics(sig: Signal, keys: list[str], *aggs: Column) -> DataFrame:
    """All cells with the aggregates of their group. Null keys are a group like any other."""
    rest = [c for c in (*sig.axes, *sig.parts) if c not in keys]
    cells = F.collect_list(F.struct(*rest)).alias(_CELLS)
    spans = chunk_spans(sig, keys)
    if spans is None:
        return unpacked(sig.cells.groupBy(*keys).agg(cells, *aggs))
    spots = [F.floor(F.col(a) / F.lit(n)).alias(f"_at_{a}") for a, n in spans.items()]
    packed = sig.cells.groupBy(*keys, *spots).agg(cells).drop(*(f"_at_{a}" for a in spans))
    stats = packed.select(*keys, F.inline(_CELLS)).groupBy(*keys).agg(*aggs)
    return unpacked(null_safe(packed, stats, list(keys)))


def unpacked(packed: DataFrame) -> DataFrame:
    """One row per packed cell, its chunk's other columns beside it."""
    return packed.select(*(c for c in packed.columns if c != _CELLS), F.inline(_CELLS))
