"""Compare registered queries with their SQL in DuckDB.

Run as a script: ``python tests/oracle.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    left = bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = bag(names, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if left != right:
        extra, missing = list((left - right).items()), list((right - left).items())
        problems.append(
            f"rows {sum(left.values())} vs {sum(right.values())}; only spark {len(extra)} "
            f"{sorted(extra)[:3]}; only sql {len(missing)} {sorted(missing)[:3]}"
        )
    return sum(left.values()), problems


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from cellwave.workload import all_queries, all_sql

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sqls = session(), connect(sys.argv[1]), all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                n, problems = compare(spark, con, folder, fn, sqls[name])
            else:
                n, problems = len(fn(spark, folder).collect()), []
            mark = "ok" if not problems and n else "BAD"
            if n == 0:
                problems.append("empty result")
            note = "" if name in sqls else "(no sql)"
            print(f"{mark:4}{name:32}{n:9}{time.time() - start:7.2f}s {note}{'; '.join(problems)}"[:900])
            bad += mark == "BAD"
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}")
    print("bad:", bad)
