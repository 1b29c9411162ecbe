"""Text sources: CSI packets in CSV, delimited metadata, capture listings."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.sources.framing import heads_of

# Integers per CSV packet and the subcarriers they carry.
SUBCARRIERS_BY_LENGTH = {106: 56, 114: 57, 128: 64, 234: 117, 256: 128, 384: 192}
# Bandwidth in Hz by the largest subcarrier count it covers.
BANDWIDTH_BY_SUBCARRIERS = {64: 20e6, 128: 40e6, 999999: 80e6}
CSI_COLUMNS = ("type", "data", "channel")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV with trimmed names and values, all strings.

    Give ``columns`` to skip the header inference job.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", True)
    raw = reader.csv(path)
    return raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns))


def require_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")


def read_csv_csi(spark: SparkSession, path: str) -> DataFrame:
    """CSI packets of a CSV capture, quoted JSON payload in ``data``."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    require_columns(raw, CSI_COLUMNS)
    return raw


def parse_csv_csi(raw: DataFrame) -> DataFrame:
    """Keep CSI_DATA rows with a usable payload; add ``re``/``im`` arrays.

    A payload is usable when it is a JSON integer list of a known length that
    holds enough (re, im) pairs for its subcarriers.
    """
    counts = F.create_map(*(F.lit(x) for item in SUBCARRIERS_BY_LENGTH.items() for x in item))
    kept = raw.where(F.col("type") == "CSI_DATA")
    kept = kept.withColumn("_iq", F.from_json("data", "array<int>"))
    kept = kept.withColumn("num_subc", F.try_element_at(counts, F.size("_iq")))
    kept = kept.where(F.col("num_subc") * 2 <= F.size("_iq"))

    def side(offset: int) -> Column:
        steps = F.sequence(F.lit(0), F.col("num_subc") - 1)
        return F.transform(steps, lambda i: F.element_at("_iq", i * 2 + F.lit(offset + 1)).cast("double"))

    return kept.withColumns({"re": side(0), "im": side(1)}).drop("_iq", "data")


def csv_csi_problems(raw: DataFrame) -> DataFrame:
    """CSI_DATA rows that do not parse, with the reason."""
    counts = F.create_map(*(F.lit(x) for item in SUBCARRIERS_BY_LENGTH.items() for x in item))
    iq = F.from_json("data", "array<int>")
    subcarriers = F.try_element_at(counts, F.size(iq))
    reason = (
        F.when(iq.isNull(), "invalid_json")
        .when(subcarriers.isNull(), "unknown_length")
        .when(subcarriers * 2 > F.size(iq), "too_few_values")
    )
    return raw.where(F.col("type") == "CSI_DATA").withColumn("reason", reason).where("reason IS NOT NULL")


def list_captures(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """File listing ``(path, name, length)``; contents are never read, empty files are skipped."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(path)
        .drop("content")
    )
    return listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def walk_captures(spark: SparkSession, path: str) -> DataFrame:
    """File listing ``(path, name, length)`` that keeps empty files, from any store that Spark lists.

    Spark's file sources skip files of length zero, which audits must see; its file index on the driver names them.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # the index names local files with three slashes, the metadata column with one
    urls = [url.replace("file:///", "file:/", 1) if url.startswith("file:///") else url for url in rows.inputFiles()]
    index = spark.createDataFrame([(url, unquote(url)) for url in urls], "url string, plain string")
    known = rows.select(F.col("_metadata.file_path").alias("url"), F.col("path").alias("own"), "length")
    out = index.join(known, "url", "left").select(
        F.coalesce("own", "plain").alias("path"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), "url"
    )
    return out.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "url")


def read_heads(spark: SparkSession, path: str, size: int = 3) -> DataFrame:
    """The same listing with ``head``, the first bytes of each file, null for an empty one."""
    return walk_captures(spark, path).join(heads_of(spark, path, size), "url", "left")


def parse_capture_names(listing: DataFrame, name: str = "name") -> DataFrame:
    """Fields of ``userU-G-O-T-rR`` (canonical) or six-token (capture) names.

    A name that does not fit is dropped.
    """
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    rows = listing.withColumn("sample_id", stem).withColumn("_tok", F.split("sample_id", "-"))
    rows = rows.where(F.size("_tok").isin(5, 6))

    def number(i: int, letters: str = "") -> Column:
        token = F.element_at("_tok", i)
        return (F.replace(token, F.lit(letters), F.lit("")) if letters else token).try_cast("bigint")

    five = F.size("_tok") == 5
    third, fourth, fifth = number(3), number(4), number(5)
    rows = rows.withColumns({
        "user_id": number(1, "user"),
        "gesture_id": number(2),
        "rx_id": number(-1, "r"),
        "filename_variant": F.when(five, "canonical").otherwise("capture"),
        "orientation": F.when(five, third),
        "trial": F.when(five, fourth),
        "location_id": F.when(~five, third),
        "orientation_id": F.when(~five, fourth),
        "repeat_id": F.when(~five, fifth),
    })
    whole = F.lit(True)
    for c in (F.col("user_id"), F.col("gesture_id"), F.col("rx_id"), third, fourth):
        whole = whole & c.isNotNull()
    return rows.where(whole & (five | F.col("repeat_id").isNotNull())).drop("_tok")


def parse_gesture_metas(metas: DataFrame) -> DataFrame:
    """Gesture map and user list of ``file|room|gesture_list|user|sample_num`` rows."""
    entries = F.filter(F.split("gesture_list", ";"), lambda e: F.contains(e, F.lit(":")))
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.trim(F.substring_index(e, ":", 1)).cast("bigint").alias("k"),
            F.trim(F.regexp_replace(e, r"^[^:]*:", "")).alias("v"),
        ),
    )
    users = F.transform(F.split(F.regexp_replace("user", "^User", ""), ","), lambda u: F.trim(u).cast("bigint"))
    return metas.select(
        F.col("file").alias("date"), F.col("room").cast("bigint").alias("room"),
        F.map_from_entries(pairs).alias("gesture_map"), users.alias("users"),
        F.col("sample_num").cast("bigint").alias("sample_num"),
    )
