"""Tables seen as signals, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.model import KEY, Signal


def _index_columns(position, sizes: dict[str, int]):
    """Row-major axis indexes of a flat position."""
    columns, rest = [], position
    for name in reversed(list(sizes)):
        columns.append(F.pmod(rest, F.lit(sizes[name])).alias(name))
        rest = F.floor(rest / F.lit(sizes[name]))
    return list(reversed(columns))


def _index_sql(sizes: dict[str, int]) -> str:
    parts, below = [], 1
    for name in reversed(list(sizes)):
        parts.append(f"(j // {below}) % {sizes[name]} AS {name}")
        below *= sizes[name]
    return ", ".join(reversed(parts))


def complex_signal(t, samples=None, coords=None, **sizes: int) -> Signal:
    """Each embedding as 32 complex cells: (re, im) = elements (2j, 2j + 1)."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda j: F.struct(
            F.get("embedding", j * 2).cast("double").alias("re"),
            F.get("embedding", j * 2 + 1).cast("double").alias("im"),
        ),
    )
    flat = t.embeddings.select(F.col("vec_id").alias(KEY), F.posexplode(pairs).alias("_j", "_c"))
    j = F.col("_j").cast("bigint")
    cells = flat.select(KEY, *_index_columns(j, sizes), "_c.re", "_c.im")
    return Signal(cells, tuple(sizes), samples, coords, sizes)


def long_signal(t) -> Signal:
    """25 captures of the embeddings one after another: four time steps of (subc 4, tx 1, rx 2) from each."""
    flat = complex_signal(t, time=4, rx=2, subc=4, tx=1).cells
    at = F.floor(F.col(KEY) / 25) * 4 + F.col("time")
    capture = F.pmod(F.col(KEY), F.lit(25))
    cells = flat.select(capture.alias(KEY), at.alias("time"), "subc", "tx", "rx", "re", "im")
    return Signal(cells, ("time", "subc", "tx", "rx"), sample_table(t), sizes={"subc": 4, "tx": 1, "rx": 2})


def real_signal(t, samples=None, coords=None, **sizes: int) -> Signal:
    """Each embedding as 64 real cells."""
    flat = t.embeddings.select(F.col("vec_id").alias(KEY), F.posexplode("embedding").alias("_j", "_v"))
    j = F.col("_j").cast("bigint")
    cells = flat.select(KEY, *_index_columns(j, sizes), F.col("_v").cast("double").alias("value"))
    return Signal(cells, tuple(sizes), samples, coords, sizes)


def complex_sql(**sizes: int) -> str:
    return f"""c AS (SELECT vec_id AS sample_id, {_index_sql(sizes)}, CAST(embedding[2*j+1] AS DOUBLE) AS re,
   CAST(embedding[2*j+2] AS DOUBLE) AS im FROM embeddings, range(32) r(j))"""


def real_sql(**sizes: int) -> str:
    return f"""c AS (SELECT vec_id AS sample_id, {_index_sql(sizes)}, CAST(embedding[j+1] AS DOUBLE) AS value
   FROM embeddings, range(64) r(j))"""


def sample_table(t):
    """One metadata row per embedding; fields go missing on a rule."""
    i = F.col("vec_id")
    return t.embeddings.select(
        i.alias(KEY),
        (5.18e9 + (i % 4) * 6e5).alias("center_freq"),
        F.when(i % 7 != 0, F.lit(2e7)).alias("bandwidth"),
        F.lit(1000.0).alias("sample_rate"),
        F.when(i % 11 != 0, F.lit(312500.0)).otherwise(0.0).alias("subcarrier_spacing"),
        (1.7e9 + i).cast("double").alias("timestamp_start"),
        F.concat(F.lit("reader"), (i % 3).cast("string")).alias("reader_id"),
    )


def rounded(sig: Signal, digits: int = 6, *columns: str):
    """Cells with rounded values and no negative zero, for comparison."""
    parts = columns or sig.parts
    df = sig.cells if isinstance(sig, Signal) else sig
    return df.withColumns({p: F.round(p, digits) + F.lit(0.0) for p in parts})
