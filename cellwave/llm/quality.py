"""Quality rules over words and over lines that many documents of a host share; DataFrame functions only.

Line frequency: normalised lines are hashed, distinct documents are counted per host (equal texts count once,
so copies of one document do not make its lines boilerplate), lines in more than ``most_documents`` are removed
and a document with fewer than ``least_left`` characters left is rejected.

``keep_good`` gives texts without those lines and counts more strictly: documents with the same normalised lines count
once, and so do near copies, whose lines but a fifth or ``least_left`` characters are all over the limit, by the
longest of these, so that a group of copies alone doesn't make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.common import mark, marks, written

GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
BLANKS = "\x20\x09\x0B\x0C\x0D"
SYMBOLS = r"[^#*$%&|<>]+"
RUN = 5
MOST_DOCUMENTS, LEAST_LEFT, LEAST_WORDS, MOST_REPEATED = 100, 50, 10, 20
NEAR = 5


def _run_hashes(hashes: Column) -> Column:
    """A hash for each window of ``RUN`` words, from the hashes of the words."""
    runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, RUN))))
    return F.slice(runs, 1, F.greatest(F.size(hashes) - (RUN - 1), F.lit(0)))


def text_measures(documents: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """``document, host, text_hash`` and the counts of every row; a null text has no words, a null source is host ''.

    ``document`` holds the ``carried`` columns of the row, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(
        F.struct(*carried).alias("document"),
        *_text_key(text),
        F.filter(F.split(text, GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_GAP)).alias("lines"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    runs = base.select(
        "document", "host", "text_hash", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    runs = runs.withColumn("runs", _run_hashes(F.col("hashes"))).drop("hashes")
    # windows sorted by hash, in the texts that repeat one
    tagged = runs.withColumn(
        "tagged",
        F.when(
            F.size(F.array_distinct("runs")) < F.size("runs"),
            F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("runs")
    starts = tagged.withColumn(
        "starts",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "tagged",
                    lambda x, k: F.when(
                        (F.get("tagged", k - 1)["h"] == x["h"]) | (F.get("tagged", k + 1)["h"] == x["h"]), x["i"]
                    ),
                )
            )
        ),
    ).drop("tagged")
    # a window covers its words up to the next repeated window
    steps = F.transform("starts", lambda s, k: F.least(F.coalesce(F.get("starts", k + 1) - s, F.lit(RUN)), F.lit(RUN)))
    return starts.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    ).drop("starts")


def _text_key(text: Column) -> tuple[Column, Column]:
    return (
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        F.concat_ws("-", F.xxhash64(text), F.octet_length(text)).alias("text_hash"),
    )


def _text_lines(documents: DataFrame) -> DataFrame:
    """``host, text_hash, line, chars``: the distinct normalised lines of each text, and their characters in it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), *_text_key(text), F.explode(F.split(F.lower(text), "\n")).alias("raw")
    )
    rows = rows.select("row", "host", "text_hash", F.btrim("raw", F.lit(BLANKS)).alias("clean"))
    rows = rows.select("row", "host", "text_hash", F.xxhash64("clean").alias("line"), F.length("clean").alias("chars"))
    per_row = rows.filter("chars > 0").groupBy("row", "host", "text_hash", "line").agg(F.sum("chars").alias("chars"))
    per_text = per_row.groupBy("host", "text_hash", "line").agg(F.max("chars").alias("chars"))
    return written(per_text, "quality-lines")


def line_removals(documents: DataFrame, most_documents: int) -> DataFrame:
    """``host, text_hash, removed_chars, left_chars`` of the texts that hold a line of more than ``most_documents`` documents.

    Characters are those of lines without the blanks at their ends.
    """
    lines = _text_lines(documents)
    often = lines.groupBy("host", "line").count().filter(F.col("count") > most_documents)
    often = often.select("host", "line", F.lit(True).alias("often"))
    removed = F.coalesce(F.sum(F.when(F.col("often"), F.col("chars"))), F.lit(0))
    return (
        lines.join(often, ["host", "line"], "left")
        .groupBy("host", "text_hash")
        .agg(removed.alias("removed_chars"), (F.sum("chars") - removed).alias("left_chars"))
        .filter("removed_chars > 0")
    )


def common_lines(documents: DataFrame, most_documents: int, least_left: int) -> DataFrame:
    """``host, text_hash, gone, left_chars``: the hashes of lines over the limit in each text that holds any.

    A document that lines of more than ``most_documents`` texts leave ``least_left`` characters or more, and a fifth
    of its own, counts by all its lines; another one by the longest of those lines.
    """
    lines = _text_lines(documents)
    able = lines.groupBy("host", "line").count().filter(F.col("count") > most_documents)
    able = written(able.select("host", "line", F.lit(True).alias("able")), "quality-able")
    total, left = F.sum("chars"), F.coalesce(F.sum(F.when(F.col("able").isNull(), F.col("chars"))), F.lit(0))
    texts = lines.join(able, ["host", "line"], "left").groupBy("host", "text_hash").agg(
        total.alias("total"), left.alias("left"), F.max(F.when(F.col("able"), F.struct("chars", "line"))).alias("longest"),
        F.xxhash64(F.bit_xor(F.xxhash64("line", "chars")), F.count("*"), total).alias("whole"),
    )
    near = (F.col("left") < least_left) | (F.col("left") * NEAR < F.col("total"))
    copy = F.when(near, F.xxhash64(F.lit("near"), "longest.line")).otherwise(F.col("whole"))
    texts = texts.filter("longest is not null").select("host", "text_hash", "total", copy.alias("copy"))
    held = written(lines.join(able.drop("able"), ["host", "line"]).join(texts, ["host", "text_hash"]), "quality-held")
    often = held.groupBy("host", "line", "copy").agg(F.count("*").alias("n")).groupBy("host", "line").count()
    often = often.filter(F.col("count") > most_documents).select("host", "line")
    gone = held.join(often, ["host", "line"]).groupBy("host", "text_hash").agg(
        F.collect_set("line").alias("gone"), (F.first("total") - F.sum("chars")).alias("left_chars")
    )
    return gone


def _without(text: Column, gone: Column) -> Column:
    """The text without its lines of those hashes, compared as ``_text_lines`` has them."""
    line = lambda x: F.xxhash64(F.btrim(F.lower(x), F.lit(BLANKS)))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, line(x))), "\n")


def _base_failed(least_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)


def judge_quality(
    documents: DataFrame,
    most_documents: int = MOST_DOCUMENTS,
    least_left: int = LEAST_LEFT,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """``doc_id``, the counts of every row, ``removed_chars``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` per cent of them in repeated
    windows. ``kept`` is false for those and for documents that lines over the limit leave with fewer than
    ``least_left`` characters. Null and empty texts fail; repeated rows are judged alike and each returned.
    """
    removed = line_removals(documents, most_documents)
    measures = text_measures(documents, ("doc_id",)).select("document.doc_id", "*").drop("document")
    return (
        measures.join(removed, ["host", "text_hash"], "left")
        .withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
        .withColumn("base_failed", _base_failed(least_words, most_repeated))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("left_chars") >= least_left, F.lit(True)))
        .drop("host", "text_hash", "left_chars")
    )


def keep_good(
    documents: DataFrame,
    most_documents: int = MOST_DOCUMENTS,
    least_left: int = LEAST_LEFT,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """The rows that pass the base rules and keep ``least_left`` characters, without the lines over the limit.

    All columns stay; ``text`` is the rest of the text, and ``n_chars``, where there is one, its length. The base rules
    look at the whole text, as in ``judge_quality``.
    """
    gone = common_lines(documents, most_documents, least_left)
    gone = gone.select(F.concat_ws("/", "host", "text_hash").alias("key"), "gone", "left_chars")
    gone = written(gone, "quality-gone")
    # only texts that may be among them move
    text = F.coalesce(F.col("text"), F.lit(""))
    host, key = _text_key(text)
    rows = documents.select(F.struct("*").alias("document"), F.concat_ws("/", host, key).alias("key"))
    places = marks(gone, "key")
    far = rows.join(places, mark("key") == F.col("mark"), "left_anti").select("document.*", F.lit(None).cast("string").alias("quality_text"))
    near = rows.join(places, mark("key") == F.col("mark"), "left_semi").join(gone, "key", "left")
    near = near.filter(F.coalesce(F.col("left_chars") >= least_left, F.lit(True)))
    rest = F.when(F.col("gone").isNotNull(), _without(F.col("document.text"), F.col("gone")))
    rows = far.unionByName(near.select("document.*", rest.alias("quality_text")))
    # the row number keeps the filter above the measures, which it would else be written into
    rows = text_measures(rows, (*documents.columns, "quality_text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.filter((F.col("row") >= 0) & ~_base_failed(least_words, most_repeated)).select("document.*")
    rest = F.col("quality_text")
    new = {"text": F.coalesce(rest, F.col("text"))}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new = {"n_chars": F.when(rest.isNotNull(), F.length(rest).cast(kind)).otherwise(F.col("n_chars"))} | new
    return rows.withColumns(new).select(documents.columns)
