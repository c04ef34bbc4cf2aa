"""The operators of this folder as stages over `documents` (doc_id, text, lang, source, n_chars).

Each takes (spark, docs, sf_dir).  Columns beyond these five are dropped, so extra columns cannot
clash.  Nulls, empty and long texts, ties, repeated rows and empty tables have the results that the
operators define; what a stage adds is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, secret_scan, toxicity
from .near_copies import near_copy_components
from .packing import pack
from .shared import materialize, table, tidy
from .simhash import near_duplicate_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the fit sees labelled rows outside the held-out fold only."""
    docs = docs.select(*COLUMNS)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.fold(F.col("id")) != 1)
    return toxicity.score(docs, scorer, carry=COLUMNS).where("__predicted = 0").select(*COLUMNS)


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of each group (found: id, uid, root) with the smallest id, of those that share it the least hash of the text.

    Rows that repeat an id and a text are one row; a row without an id stands for a group only if all others lack one too.
    """
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("row")).select(F.col("row.id").alias("i"), F.col("row.uid").alias("u"))
    mine = [F.col("doc_id").cast("long").eqNullSafe(F.col("i")), F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("u")]
    kept = docs.join(best, mine, "left_semi")
    again = materialize(found.groupBy("id", "uid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("i"), F.col("uid").alias("u")), "near-repeats")
    if again.isEmpty():  # no two rows are alike, so none need be sorted out
        return kept.select(*COLUMNS)
    once = kept.join(again, mine, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, mine, "left_anti").unionByName(once).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near fingerprints the row that first_rows() names."""
    docs = docs.select(*COLUMNS)
    return first_rows(docs, materialize(near_duplicate_components(docs).select("id", "uid", "root"), "near-groups"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As drop_near_duplicates, but groups also join texts whose five-word shingles have a Jaccard similarity of at least 0.8."""
    docs = docs.select(*COLUMNS)
    near = materialize(near_duplicate_components(docs).select("id", "uid", "root"), "near-groups")
    tidy(spark)
    return first_rows(docs, materialize(near_copy_components(docs, near), "near-copies"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    clean = secret_scan.masked(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities of their source, language and topic draw; full cells' excess goes to others."""
    return mixing.mix(docs.select(*COLUMNS)).where("__sampled").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence and its ids."""
    return pack(docs.select(*COLUMNS)).withColumnRenamed("id", "doc_id")
