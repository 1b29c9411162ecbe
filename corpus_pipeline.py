"""Documents to packed sequences: the stages of a corpus, each on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.llm import jaccard, packing, qgrams, quality, suffix
from cellwave.llm.common import shipped, written
from cellwave.llm.workload import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Trie walks, induced sorting and banded alignment have no SQL form; tests hold the stages against plain ones.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not left empty by lines of many documents."""
    shipped(spark)
    return quality.keep_good(docs.select(*COLUMNS))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, four fifths in common."""
    shipped(spark)
    return jaccard.keep_first(docs.select(*COLUMNS), 5, "4/5")


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that occur elsewhere; a document of nothing but such passages goes.

    A character of which a part is removed goes as a whole. ``n_chars`` counts the new text.
    """
    shipped(spark)
    rows = suffix.strip_repeats(docs.select(*COLUMNS))
    changed = F.size("suffix_spans") > 0
    # a cut inside a character leaves bytes that are no UTF-8
    text = F.when(changed, F.replace(F.make_valid_utf8(F.col("suffix_kept").cast("string")), F.lit("�"), F.lit(""))).otherwise(
        F.col("text")
    )
    rows = rows.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.filter(~changed | F.col("text").rlike(quality.NOT_GAP)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return qgrams.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, their sequence and their place in it."""
    shipped(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("benchmark decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
