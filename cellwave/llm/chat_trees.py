"""Reply trees to conversations: root-to-leaf paths by iterated self-joins, the best branch as one text.

Each join doubles the stretch of ancestors that a node knows, so a thread of n turns takes about log2(n) joins.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cellwave.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LINE = "<\\/>"


def escape(text: Column) -> Column:
    """No control string is left: a backslash goes before each backslash and between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break, which ends the role, becomes a string that escaping can't make."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def linear_threads(turns: DataFrame) -> DataFrame:
    """``conv_id, node, parent, role, text, score`` of rows ``conv_id, turn, role, text``: each answers the one before.

    Rows of a conversation go by turn, ties by role and text; null roles and texts are empty, null ids are one
    conversation. An assistant row scores 1.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = written(rows.withColumn("node", F.monotonically_increasing_id()), "chat-turns")
    order = W.Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return rows.select(
        "conv_id", "node", F.lag("node").over(order).alias("parent"), "role", "text",
        (F.col("role") == "assistant").cast("double").alias("score"),
    )


def best_paths(nodes: DataFrame) -> DataFrame:
    """``conv_id, node, depth`` of the best root-to-leaf path of every ``conv_id``.

    ``nodes``: ``conv_id, node, parent, score`` with ``node`` unique over all rows. A node whose parent is null or
    not there is a root. The path with the greatest sum of scores is chosen, then the longer, then the leaf with
    the smallest id. Nodes in a cycle have no root and are in no path.
    """
    base = nodes.select("conv_id", "node", "parent", "score")
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = base.join(known, "parent", "left").select(
        "conv_id", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"),
        F.lit(1).cast("long").alias("depth"),
    )
    state = written(state, "chat-jumps")
    most, reach = state.count(), 1
    done, open_ = state.filter("up is null"), state.filter("up is not null")
    jumps = [open_]
    while reach < most and not open_.isEmpty():
        # only nodes that have not met their root yet are joined
        above = done.unionByName(open_).select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"),
            F.col("depth").alias("further"),
        )
        state = open_.join(above, "up").select(
            "conv_id", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"),
            (F.col("depth") + F.col("further")).alias("depth"),
        )
        state = written(state, "chat-jumps")
        done, open_ = done.unionByName(state.filter("up is null")), state.filter("up is not null")
        jumps.append(open_)
        reach *= 2
    inner = jumps[0].select(F.col("up").alias("node")).distinct()
    rank = F.struct("total", "depth", (-F.col("node")).alias("low"))
    leaves = done.join(inner, "node", "left_anti").groupBy("conv_id").agg(F.max(rank).alias("rank"))
    path = written(leaves.select((-F.col("rank.low")).alias("node")), "chat-path")
    for table in jumps:
        above = table.join(path, "node").select(F.col("up").alias("node"))
        # written, because each round uses the last one twice
        path = written(path.unionByName(above), "chat-path")
    return done.join(path, "node").select("conv_id", "node", "depth")


def format_paths(nodes: DataFrame) -> DataFrame:
    """``conv_id, formatted, n_turns, loss``: the best path of every conversation as one text.

    ``loss`` has an entry per turn: null, or the code points ``[start, end)`` of an assistant's text in
    ``formatted``. Texts and roles are escaped, so ``read_back`` returns them whatever they hold.
    """
    rows = nodes.drop("depth").join(best_paths(nodes).select("node", "depth"), "node")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "depth", head.alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("trained"),
    )
    before = W.Window.partitionBy("conv_id").orderBy("depth").rowsBetween(W.Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    span = F.struct(start.cast("long").alias("start"), (start + F.length("body")).cast("long").alias("end"))
    rows = rows.select(
        "conv_id", "depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("trained"), span).alias("span")
    )
    turns = F.sort_array(F.collect_list(F.struct("depth", "piece", "span")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return out.select(
        "conv_id", F.array_join("turns.piece", "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"),
        F.col("turns.span").alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, loss_text`` from ``formatted`` and ``loss`` alone; ``loss_text`` is null outside the mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2147483647)
    rows = formatted.select("conv_id", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss").alias("span"))))
    rows = rows.select("conv_id", F.col("pos").alias("position"), "col.piece", "col.span")
    before = W.Window.partitionBy("conv_id").orderBy("position").rowsBetween(W.Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("piece") + len(OPEN)).over(before), F.lit(0)) + len(OPEN)
    rows = rows.withColumn("shift", shift)
    role = F.substring_index("piece", "\n", 1)
    body = F.expr(f"substring(piece, length(substring_index(piece, '\\n', 1)) + 2, "
                  f"length(piece) - length(substring_index(piece, '\\n', 1)) - 1 - {len(CLOSE)})")
    masked = F.expr("substring(piece, cast(span.start - shift as int) + 1, cast(span.end - span.start as int))")
    return rows.select(
        "conv_id", "position", unescape_role(role).alias("role"), unescape(body).alias("text"),
        unescape(masked).alias("loss_text"),
    )
