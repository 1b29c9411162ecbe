"""Shared folder, written tables and byte views that the operators have in common."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions.ship import ship_package

_own: dict[str, str] = {}
SLICE_BYTES = 4 << 20
FILTER_BITS = 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset (one machine)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        folder = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="cellwave-shared-")
        _own[app] = folder
    return folder.rstrip("/")


def new_place(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    place = new_place(spark, label)
    df.write.parquet(place)
    table = spark.read.schema(df.schema).parquet(place)
    table.written_place = place
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove ``written`` tables that nothing will read again, and the shuffle files of jobs that are over.

    Spark removes the latter once the driver has collected what refers to them.
    """
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(table.written_place)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def shipped(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    return spark


def mark(key: str) -> Column:
    """Where a key falls in a filter of ``2 ** FILTER_BITS`` places."""
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int")


def marks(rows: DataFrame, key: str) -> DataFrame:
    """The filter's places that keys of ``rows`` fall in, as a broadcast side: at most ``2 ** FILTER_BITS`` numbers."""
    return F.broadcast(rows.select(mark(key).alias("mark")).distinct())


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else None
    if kind is None:
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        sums = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sums):
            before = sums[start - 1] if start else 0
            end = max(int(np.searchsorted(sums, before + most, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end
