"""Queries against their SQL on rows that the small tables lack."""

import duckdb
import pytest
from oracle import compare

from cellwave.operators import audit
from cellwave.workload import all_queries, all_sql


def agrees(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(spark, con, str(folder), all_queries()[name], all_sql()[name])


def test_captures_without_text_or_id_and_repeated_ids(spark, tmp_path):
    text = "x" * 400
    rows = [(k, text) for k in range(10)] + [(k, None) for k in range(5)] + [(k, "short") for k in range(5, 10)]
    rows += [(3, text), (None, text), (None, "short"), (None, None), (-3, text), (-5, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count, problems = agrees(spark, tmp_path, "capture_problems", "documents")
    assert (count, problems) == (len(rows), [])


def test_captures_below_a_header_are_too_short(spark, tmp_path):
    rows = [(k, text) for k, text in enumerate(["", "A.", "abc", "é", "x" * 301, "x" * 302, "é" * 151] * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count, problems = agrees(spark, tmp_path, "capture_problems", "documents")
    assert (count, problems) == (len(rows), [])
    got = {r.doc_id: r.reason for r in all_queries()["capture_problems"](spark, str(tmp_path)).collect()}
    assert all(got[k] == ("too_short" if k % 5 else "missing") for k, text in rows if len(text.encode()) < 3)


def test_listed_capture_of_unknown_length_is_not_missing(spark):
    listing = spark.createDataFrame([("a", None, bytes.fromhex("012CBB"))], "path string, length long, head binary")
    manifest = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.path: r.reason for r in audit.capture_problems(manifest, listing).collect()} == {"a": None, "b": "missing"}


@pytest.mark.parametrize("name", ["run_reports", "leaderboard"])
def test_means_halfway_between_two_roundings(spark, tmp_path, name):
    # 80 values in hundredths: means end in whole multiples of 1.25e-4, which often lie halfway
    rows = [(user, (user * 7919 * (k + 3) ** 2 % 9973) / 100) for user in range(1, 400) for k in range(80)]
    spark.createDataFrame(rows, "user_id long, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    count, problems = agrees(spark, tmp_path, name, "events")
    assert (count, problems) == (399, [])
