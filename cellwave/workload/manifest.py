"""Manifest, split, leakage and label queries over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.operators import catalogue, labels, leakage, manifest, ordinal, splits
from cellwave.sources import sinks
from cellwave.workload.registry import Tables, query

# a manifest: room is null for status P, so null semantics are exercised
MANIFEST_SQL = """m AS (
  SELECT o_orderkey AS sample_id, o_orderkey AS pos, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE c_nationkey END AS room,
         o_orderpriority AS label, o_orderstatus AS status, c_mktsegment AS segment,
         CAST(year(o_orderdate) AS VARCHAR) AS date, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def orders_manifest(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    room = F.when(F.col("o_orderstatus") != "P", F.col("c_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("user_id"),
        room.alias("room"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.year("o_orderdate").cast("string").alias("date"),
        F.col("o_totalprice").alias("price"),
    )


def sides(t: Tables):
    m = orders_manifest(t)
    return m.where("status <> 'O'"), m.where("status = 'O' OR price > 400000")


SIDES_SQL = f"""WITH {MANIFEST_SQL},
 l AS (SELECT * FROM m WHERE status <> 'O'),
 r AS (SELECT * FROM m WHERE status = 'O' OR price > 400000)"""


@query("filter_equals", f"""WITH {MANIFEST_SQL}
SELECT sample_id, user_id, segment FROM m
WHERE price > 100000 AND room IS NULL AND segment = 'BUILDING'""")
def _(t):
    kept = manifest.filter_rows(
        orders_manifest(t), F.col("price") > 100000, room=None, segment="BUILDING", absent=None
    )
    return kept.select("sample_id", "user_id", "segment")


@query("filter_python_predicate", f"""WITH {MANIFEST_SQL}
SELECT sample_id, status FROM m WHERE status = 'F' AND label LIKE '1%'""")
def _(t):
    test = manifest.python_predicate(
        lambda row: row["status"] == "F" and row["label"].startswith("1"), "status", "label"
    )
    return manifest.filter_rows(orders_manifest(t), test).select("sample_id", "status")


@query("select_positions", """
WITH d AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos FROM events),
 p AS (SELECT o_orderkey AS pos FROM orders UNION ALL SELECT c_custkey * 2 FROM customer)
SELECT d.pos, event_id FROM d JOIN p ON d.pos = p.pos""")
def _(t):
    from cellwave.operators.ordinal import global_ordinal

    ranked, _ = global_ordinal(
        t.events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")]
    )
    wanted = t.orders.select(F.col("o_orderkey").alias("pos")).unionAll(
        t.customer.select((F.col("c_custkey") * 2).alias("pos"))
    )
    return manifest.select_positions(ranked, wanted).select("pos", "event_id")


@query("limit_rows", f"WITH {MANIFEST_SQL} SELECT sample_id, label FROM m ORDER BY pos LIMIT 100")
def _(t):
    return manifest.limit_rows(orders_manifest(t), 100).select("sample_id", "label")


@query("split_matched", f"""WITH {MANIFEST_SQL}
SELECT CASE WHEN coalesce(room > 10, false) THEN 'matched' ELSE 'remainder' END AS part,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM m GROUP BY 1""")
def _(t):
    parts = manifest.split_matched(orders_manifest(t), F.col("room") > 10)
    return parts.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("id_sum")
    )


@query("key_parts", f"""WITH {MANIFEST_SQL},
 f AS (SELECT room, row_number() OVER (ORDER BY min(pos)) - 1 AS part FROM m GROUP BY room)
SELECT m.sample_id, m.room, CAST(f.part AS BIGINT) AS part
FROM m JOIN f ON m.room IS NOT DISTINCT FROM f.room""")
def _(t):
    return manifest.key_parts(orders_manifest(t), "room").select("sample_id", "room", "part")


@query("group_split_ratio", f"""WITH {MANIFEST_SQL},
 g AS (SELECT user_id, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS o,
         count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM m))
SELECT m.sample_id, m.user_id,
  CASE WHEN o < greatest(1, least(n - 1, round_even(n * 0.8, 0))) THEN 'left' ELSE 'right' END AS side
FROM m JOIN g USING (user_id)""")
def _(t):
    return splits.group_split(orders_manifest(t), "user_id", 0.8).select(
        "sample_id", "user_id", "side"
    )


@query("group_split_sides", f"""WITH {MANIFEST_SQL}
SELECT sample_id, segment,
  CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'left' ELSE 'right' END AS side FROM m""")
def _(t):
    return splits.group_split(
        orders_manifest(t), "segment", left_values=["BUILDING", "MACHINERY"]
    ).select("sample_id", "segment", "side")


@query("group_side_problems", f"""WITH {MANIFEST_SQL}
SELECT 'uncovered' AS problem, CAST(room AS VARCHAR) AS "group" FROM
  (SELECT DISTINCT room FROM m WHERE room IS NOT NULL AND room > 19)
UNION ALL SELECT 'missing_key', NULL FROM (SELECT 1 FROM m WHERE room IS NULL LIMIT 1)""")
def _(t):
    return splits.group_side_problems(
        orders_manifest(t), "room", list(range(10)), list(range(10, 20))
    )


@query("sorted_group_partition", f"""WITH {MANIFEST_SQL},
 g AS (SELECT room, row_number() OVER (ORDER BY coalesce(CAST(room AS VARCHAR), 'None')) - 1 AS o,
         count(*) OVER () AS n FROM (SELECT DISTINCT room FROM m))
SELECT m.sample_id, m.room,
  CASE WHEN o < greatest(1, least(n - 1, round_even(n * 0.7, 0))) THEN 'train' ELSE 'val' END AS split
FROM m JOIN g ON m.room IS NOT DISTINCT FROM g.room""")
def _(t):
    return splits.sorted_group_partition(orders_manifest(t), "room", 0.7).select(
        "sample_id", "room", "split"
    )


STRATIFIED_SQL = """k AS (SELECT *,
   row_number() OVER (PARTITION BY label ORDER BY md5('41|' || sample_id), sample_id) - 1 AS o,
   count(*) OVER (PARTITION BY label) AS n FROM pool),
 cut AS (SELECT *, CASE WHEN n = 1 OR o < greatest(1, least(n - 1, round_even(n * 0.8, 0)))
   THEN 'train' ELSE 'val' END AS part FROM k)"""


@query("stratified_train_val", f"""WITH {MANIFEST_SQL}, pool AS (SELECT * FROM m), {STRATIFIED_SQL}
SELECT sample_id, label, part AS split FROM cut""")
def _(t):
    return splits.stratified_train_val(orders_manifest(t), "label", 0.8, 41).select(
        "sample_id", "label", "split"
    )


@query("stratified_ensure_val", """WITH pool AS (
   SELECT l_orderkey AS sample_id, l_quantity + l_orderkey * 100 AS label FROM
     (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)),
 x AS (SELECT max(label) AS top FROM pool)
SELECT sample_id, CASE WHEN label = top THEN 'val' ELSE 'train' END AS split FROM pool, x""")
def _(t):
    # every label has one sample: the row of the largest label must move
    pool = t.lineitem.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.max("l_quantity").alias("q")
    )
    pool = pool.select("sample_id", (F.col("q") + F.col("sample_id") * 100).alias("label"))
    return splits.stratified_train_val(pool, "label", 0.8, 41, ensure_val=True).select(
        "sample_id", "split"
    )


@query("stratified_trainval_test", f"""WITH {MANIFEST_SQL},
 k AS (SELECT *,
   row_number() OVER (PARTITION BY label ORDER BY md5('test7|' || sample_id), sample_id) - 1 AS o,
   count(*) OVER (PARTITION BY label) AS n FROM m)
SELECT sample_id, CASE WHEN n >= 3 AND o < greatest(1, least(n - 2, round_even(n * 0.1, 0)))
  THEN 'test' ELSE 'trainval' END AS split FROM k""")
def _(t):
    return splits.stratified_trainval_test(orders_manifest(t), "label", 0.1, 7).select(
        "sample_id", "split"
    )


@query("declared_split", f"""WITH {MANIFEST_SQL},
 pool AS (SELECT * FROM m WHERE room IN (3, 7, 8, 9) AND segment IN ('BUILDING', 'MACHINERY')),
 {STRATIFIED_SQL}
SELECT sample_id, part AS split FROM cut
UNION ALL SELECT sample_id, 'test' FROM m WHERE room IN (1, 2, 5, 6)""")
def _(t):
    contract = {
        "train": {"room": [3, 7, 8, 9], "segment": ["BUILDING", "MACHINERY"], "user_id": None},
        "test": {"room": [1, 2, 5, 6], "segment": None},
    }
    return splits.declared_split(
        orders_manifest(t), contract, "label", 0.8, 41, split_scheme="cross_subject"
    ).select("sample_id", "split")


@query("source_split", f"""WITH {MANIFEST_SQL},
 pool AS (SELECT * FROM m WHERE status <> 'F'), {STRATIFIED_SQL}
SELECT sample_id, part AS split, 'default' AS split_scheme FROM cut
UNION ALL SELECT sample_id, 'test', 'default' FROM m WHERE status = 'F'""")
def _(t):
    rows = orders_manifest(t).withColumn(
        "source_split", F.when(F.col("status") == "F", "test").otherwise("train")
    )
    return splits.source_split(rows, "label", 0.8, 41, split_scheme="default").select(
        "sample_id", "split", "split_scheme"
    )


@query("metadata_split", f"""WITH {MANIFEST_SQL}
SELECT status AS split, CAST(count(*) AS BIGINT) AS n FROM m WHERE status IN ('F', 'O') GROUP BY 1""")
def _(t):
    rows = orders_manifest(t).withColumnRenamed("status", "split")
    kept = splits.metadata_split(rows, required=("F", "O"), optional=("V",))
    return kept.groupBy("split").agg(F.count("*").alias("n"))


@query("id_list_split", """SELECT o_orderkey AS sample_id FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    ids = t.lineitem.where("l_returnflag = 'R'").select(
        F.concat(F.lit("./"), F.col("l_orderkey").cast("string")).alias("id")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("sample_id"))
    return splits.id_list_split(rows, ids)


@query("get_split", f"""WITH {MANIFEST_SQL}
SELECT sample_id FROM m WHERE coalesce(CAST(room AS VARCHAR), status) = '3'""")
def _(t):
    pairs = F.create_map(
        F.lit("fold"), F.col("room").cast("string"), F.lit("split"), F.col("status")
    )
    rows = orders_manifest(t).withColumn("partitions", pairs)
    return manifest.get_split(rows, "3", candidate_fields=("fold", "split")).select("sample_id")


@query("written_split", f"WITH {MANIFEST_SQL} SELECT sample_id, room, price FROM m WHERE segment = 'BUILDING'")
def _(t):
    path = f"{ordinal.shared_folder(t.spark)}/splits-{t.spark.sparkContext.applicationId}"
    sinks.write_splits(orders_manifest(t).withColumnRenamed("segment", "split"), path)
    return sinks.read_split(t.spark, path, "BUILDING").select("sample_id", "room", "price")


@query("bucketed_join", f"""WITH {MANIFEST_SQL}
SELECT sample_id, price, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM m JOIN lineitem ON l_orderkey = sample_id GROUP BY 1, 2""")
def _(t):
    name = "cellwave_" + t.spark.sparkContext.applicationId.replace("-", "_")
    sinks.write_bucketed(orders_manifest(t).select("sample_id", "price"), f"{name}_samples", buckets=16)
    sinks.write_bucketed(t.lineitem.select(F.col("l_orderkey").alias("sample_id"), "l_quantity"), f"{name}_lines", buckets=16)
    samples, lines = t.spark.table(f"{name}_samples"), t.spark.table(f"{name}_lines")
    rows = samples.join(lines.hint("merge"), "sample_id").groupBy("sample_id", "price")
    return rows.agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("get_split_fallback", f"WITH {MANIFEST_SQL} SELECT sample_id FROM m WHERE segment = 'BUILDING'")
def _(t):
    # no partition value matches, so the plain split column decides
    rows = orders_manifest(t).withColumns(
        {"partitions": F.create_map(F.lit("fold"), F.col("status")), "split": F.col("segment")}
    )
    return manifest.get_split(rows, "BUILDING").select("sample_id")


@query("view_summary", f"""WITH {MANIFEST_SQL}
SELECT 'users' AS field, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM m
UNION ALL SELECT 'rooms', count(DISTINCT room) FROM m
UNION ALL SELECT 'dates', count(DISTINCT date) FROM m
UNION ALL SELECT 'segments', count(DISTINCT segment) FROM m
UNION ALL SELECT 'sample_count', count(*) FROM m""")
def _(t):
    return manifest.view_summary(orders_manifest(t), {"segments": ("absent", "segment")})


@query("split_mapping", f"""WITH {MANIFEST_SQL},
 k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY pos) AS o FROM m)
SELECT sample_id, status FROM k WHERE o <= 500 AND status IN ('F', 'O')""")
def _(t):
    return manifest.split_mapping(
        orders_manifest(t), "status", ("F", "O"), max_per_split=500
    ).select("sample_id", "status")


@query("annotate_split", f"""WITH {MANIFEST_SQL}
SELECT sample_id, 'train' AS split, 'train' AS assigned_split, 'train' AS part_split, label AS part_fold,
 'official' AS split_scheme, 'gesture' AS task_binding FROM m""")
def _(t):
    rows = orders_manifest(t).withColumn(
        "partitions", F.create_map(F.lit("fold"), F.col("label"), F.lit("split"), F.col("status"))
    )
    out = manifest.annotate_split(rows, "train", "official", "gesture")
    return out.select(
        "sample_id", "split", "assigned_split",
        F.col("partitions")["split"].alias("part_split"),
        F.col("partitions")["fold"].alias("part_fold"),
        "split_scheme", "task_binding",
    )


@query("leakage_keys", SIDES_SQL + """
SELECT room, segment FROM l INTERSECT SELECT room, segment FROM r""")
def _(t):
    return leakage.leakage_keys(*sides(t), ["room", "segment"])


@query("leakage_by_field", SIDES_SQL + """,
 k AS (SELECT user_id, date FROM l INTERSECT SELECT user_id, date FROM r)
SELECT DISTINCT 'user_id' AS field, CAST(user_id AS VARCHAR) AS value FROM k
UNION SELECT DISTINCT 'date', date FROM k""")
def _(t):
    return leakage.leakage_by_field(*sides(t), ["user_id", "date"])


@query("overlapping_rows", SIDES_SQL + """
SELECT sample_id, room, label FROM l WHERE EXISTS (SELECT 1 FROM r WHERE
  l.room IS NOT DISTINCT FROM r.room AND l.label = r.label AND l.segment = r.segment)""")
def _(t):
    return leakage.overlapping_rows(*sides(t), ["room", "label", "segment"]).select(
        "sample_id", "room", "label"
    )


@query("field_overlap", SIDES_SQL + """
SELECT DISTINCT 'room' AS field, CAST(l.room AS VARCHAR) AS value FROM l WHERE room IN (SELECT room FROM r WHERE room IS NOT NULL)
UNION SELECT DISTINCT 'user_id', CAST(l.user_id AS VARCHAR) FROM l WHERE user_id IN (SELECT user_id FROM r)""")
def _(t):
    return leakage.field_overlap(*sides(t), ["room", "user_id"])


@query("flatten_records", f"""WITH {MANIFEST_SQL}
SELECT sample_id, CAST(user_id AS VARCHAR) AS user_id, label, segment, status AS "split/split" FROM m""")
def _(t):
    records = manifest.coerce_records(
        orders_manifest(t).withColumn("split", F.col("status")),
        coordinates=("user_id",), columns=("label",), groups=("segment",), partitions=("split",),
    )
    return manifest.flatten_records(records, ("user_id",), ("label",), ("segment",), ("split",))


@query("coerce_records", f"""WITH {MANIFEST_SQL}
SELECT sample_id, CASE WHEN room IS NULL THEN 1 ELSE 2 END AS n_columns,
 CAST(room AS VARCHAR) AS room FROM m""")
def _(t):
    records = manifest.coerce_records(orders_manifest(t), columns=("label", "room"))
    return records.select(
        "sample_id", F.size("columns").alias("n_columns"), F.col("columns")["room"].alias("room")
    )


@query("encode_first_appearance", f"""WITH {MANIFEST_SQL},
 f AS (SELECT label, row_number() OVER (ORDER BY min(pos)) - 1 AS code FROM m GROUP BY label)
SELECT sample_id, CAST(code AS BIGINT) AS label FROM m JOIN f USING (label)""")
def _(t):
    rows = orders_manifest(t).withColumnRenamed("label", "target")
    return labels.encode_first_appearance(rows, "target").select("sample_id", "label")


@query("encode_sorted", f"""WITH {MANIFEST_SQL}
SELECT sample_id, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS BIGINT) AS label FROM m""")
def _(t):
    rows = orders_manifest(t).drop("label")
    return labels.encode_sorted(rows, "segment").select("sample_id", "label")


@query("remap_labels", """SELECT vec_id AS sample_id, CAST(CASE WHEN label IN (1, 2) THEN 0
 WHEN label = 9 THEN 7 ELSE label END AS BIGINT) AS label FROM embeddings""")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("sample_id"), "label")
    return labels.remap_labels(rows, "label", {1: 0, 2: 0, 9: 7})


@query("join_coordinates", """SELECT c_custkey AS sample_id, n_nationkey * 1.5 AS x, n_regionkey * 2.5 AS y
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    spots = t.nation.select(
        F.col("n_nationkey").alias("label"),
        F.array(F.col("n_nationkey") * 1.5, F.col("n_regionkey") * 2.5).alias("position"),
    )
    rows = t.customer.select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("label"))
    out = labels.join_coordinates(rows, spots, "label")
    return out.select(
        "sample_id", F.col("position")[0].alias("x"), F.col("position")[1].alias("y")
    )


@query("coordinate_problems", """SELECT 'missing_coordinate' AS problem, CAST(n_nationkey AS VARCHAR) AS detail
FROM nation WHERE n_regionkey = 4 AND n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'mixed_dimensions', '1,2'""")
def _(t):
    pair = F.array(F.lit(1.0), F.lit(2.0))
    spots = t.nation.where("n_regionkey <> 4").select(
        F.col("n_nationkey").alias("label"),
        F.when(F.col("n_regionkey") == 0, F.array(F.lit(1.0))).otherwise(pair).alias("position"),
    )
    rows = t.customer.select(F.col("c_nationkey").alias("label"))
    return labels.coordinate_problems(rows, spots, "label", "position")


@query("join_listing", """SELECT s_suppkey AS meta_id, p_partkey AS file_id, user_id FROM
 (SELECT s_suppkey, s_suppkey % 25 AS date, unnest([s_suppkey % 7, s_suppkey % 7 + 7]) AS user_id FROM supplier)
 JOIN (SELECT p_partkey, p_partkey % 25 AS date, p_size % 14 AS user_id, p_name FROM part)
 USING (date, user_id) WHERE p_name NOT LIKE '%bolt%' AND user_id IN (1, 2, 3, 8)""")
def _(t):
    metas = t.supplier.select(
        F.col("s_suppkey").alias("meta_id"),
        (F.col("s_suppkey") % 25).alias("date"),
        F.array(F.col("s_suppkey") % 7, F.col("s_suppkey") % 7 + 7).alias("users"),
    )
    files = t.part.select(
        F.col("p_partkey").alias("file_id"),
        (F.col("p_partkey") % 25).alias("date"),
        (F.col("p_size") % 14).cast("bigint").alias("user_id"),
        F.col("p_name").alias("path"),
    )
    out = catalogue.join_listing(
        metas, files, users="users", allow={"user_id": [1, 2, 3, 8]}, skip=("bolt",)
    )
    return out.select("meta_id", "file_id", "user_id")


@query("expand_index_ranges", """WITH s AS (SELECT p_partkey, p_size AS a, p_size + 4 AS b FROM part),
 x AS (SELECT p_partkey, 'nonfall' AS label, 0 AS rank, unnest(range(a, b + 1)) AS "index" FROM s
  UNION ALL SELECT p_partkey, 'nonfall', 0, 90 FROM s UNION ALL SELECT p_partkey, 'fall', 1, b FROM s)
SELECT p_partkey, CAST("index" AS BIGINT) AS "index", max_by(label, rank) AS label FROM x GROUP BY 1, 2""")
def _(t):
    size = F.col("p_size")
    specs = t.part.select(
        "p_partkey",
        F.concat_ws(",", F.concat_ws(":", size, size + 4), F.lit("90"), F.lit("non")).alias("nonfalls"),
        (size + 4).cast("string").alias("falls"),
    )
    return catalogue.expand_index_ranges(
        specs, ["p_partkey"], {"nonfall": "nonfalls", "fall": "falls"}
    )


@query("select_by_names", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
 (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t):
    names = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return catalogue.select_by_names(t.orders, names, "o_custkey").select("o_orderkey", "o_custkey")


@query("scan_sequences", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS scene,
 regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 2) AS subject,
 regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 3) AS action FROM pages
WHERE regexp_matches(url, '^https?://([^/]+)/(en|fr)/([0-9]+)')""")
def _(t):
    listing = t.pages.select("page_id", F.col("url").alias("path"))
    return catalogue.scan_sequences(
        listing, r"^https?://([^/]+)/([a-z]+)/([0-9]+)", ("scene", "subject", "action"),
        allow={"subject": ["en", "fr"]},
    ).drop("path")


def session_table(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("sample_id"),
        F.col("p_name").alias("node_1_wifi_data_path"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("node_2_wifi_data_path"),
        F.when(F.col("p_size") > 40, F.col("p_type")).alias("node_13_wifi_data_path"),
    )


NODES_SQL = """SELECT p_partkey AS sample_id, 1 AS node_id, p_name AS path FROM part
UNION ALL SELECT p_partkey, 2, p_brand FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, 13, p_type FROM part WHERE p_size > 40"""


@query("node_paths", NODES_SQL)
def _(t):
    return catalogue.node_paths(session_table(t), ["sample_id"])


@query("select_input", "SELECT p_partkey AS sample_id, p_brand AS payload FROM part WHERE p_size > 25")
def _(t):
    refs = F.create_map(
        F.lit("wifi/1"), F.col("p_name"),
        F.lit("wifi/2"), F.when(F.col("p_size") > 25, F.col("p_brand")),
    )
    rows = t.part.select(F.col("p_partkey").alias("sample_id"), refs.alias("payload_refs"))
    return manifest.select_input(rows, "wifi", 2).select("sample_id", "payload")


@query("label_histogram", """SELECT o_orderstatus AS split, o_orderpriority AS label, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1, 2""")
def _(t):
    rows = t.orders.select(
        F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("label")
    )
    return labels.label_histogram(rows)


@query("split_manifest", """SELECT o_orderstatus AS split, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("split"))
    return labels.split_manifest(rows, ("F", "O"))[0]


@query("dataset_from_samples", f"""WITH e AS (SELECT event_id AS sample_id, event_type AS target, event_id AS pos FROM events),
 f AS (SELECT target, row_number() OVER (ORDER BY min(pos)) - 1 AS label FROM e GROUP BY target),
 c AS (SELECT e.*, f.label FROM e JOIN f USING (target)),
 a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('test41|' || sample_id), sample_id) - 1 AS ot,
   count(*) OVER (PARTITION BY label) AS nt FROM c),
 s AS (SELECT *, nt >= 3 AND ot < greatest(1, least(nt - 2, round_even(nt * 0.1, 0))) AS is_test FROM a),
 pool AS (SELECT * FROM s WHERE NOT is_test), {STRATIFIED_SQL}
SELECT sample_id, CAST(label AS BIGINT) AS label, part AS split FROM cut
UNION ALL SELECT sample_id, CAST(label AS BIGINT), 'test' FROM s WHERE is_test""")
def _(t):
    rows = t.events.select(
        F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("target"),
        F.col("event_id").alias("pos"),
    )
    return splits.dataset_from_samples(rows, test_ratio=0.1, train_ratio=0.8, seed=41).select(
        "sample_id", "label", "split"
    )


@query("bridge_target_fields", "SELECT vec_id AS sample_id, label AS activity, label AS target FROM embeddings")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("activity"))
    return manifest.bridge_target_fields(rows, {"target": "activity", "pose": "joints"})


@query("resolve_sample_ids", f"""WITH {MANIFEST_SQL}
SELECT sample_id AS pos, printf('sample-%06d', sample_id) AS resolved_id FROM m""")
def _(t):
    # room is null on some rows, so ids fall back to positions everywhere
    return manifest.resolve_sample_ids(orders_manifest(t), fields=("absent", "room")).select(
        "pos", "resolved_id"
    )
