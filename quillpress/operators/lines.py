"""Lines as rows: (id, pos, line) relations and what windows over them give."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workers import ship
from .dictionary import often
from .spread import spread

HEADING = r"""^[^`\[]"""


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col), F.posexplode(T.lines(F.col(text_col))).alias("pos", "line"))


def assemble(rows: DataFrame, id_col: str = "doc_id", line: str = "line") -> DataFrame:
    """(id, text): the lines of each id in order, each ended by \\n."""
    got = F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("line"))))
    return rows.groupBy(id_col).agg(T.joined(F.transform(got, lambda x: x["line"])).alias("text"))


def _before(id_col: str) -> Window:
    return Window.partitionBy(id_col).orderBy("pos")


def with_fences(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with is_fence and in_code: between a line that starts with ``` and the next such line."""
    fence = F.col("line").startswith("```")
    seen = F.sum(fence.cast("int")).over(_before(id_col))
    return rows.withColumn("is_fence", fence).withColumn("in_code", ~fence & (seen % 2 == 1))


def is_heading(line: Column) -> Column:
    """A # heading or a short `title:`."""
    line = T.trim(line)
    title = F.regexp_replace(line, ":+$", "")
    named = line.endswith(":") & ~line.rlike(r"^[`\[]") & (title != "") & (F.octet_length(title) < 80) & (~title.contains(" ") | title.rlike(r"^[\p{IsAlphabetic}\p{N}\-_ ]+$"))
    return line.startswith("#") | named


def with_sections(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with section: the count of headings up to the line, at least 1."""
    return rows.withColumn("section", F.greatest(F.lit(1), F.sum(is_heading(F.col("line")).cast("int")).over(_before(id_col))).cast("long"))


def with_repeats(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with repeat: the trimmed line, of 20 bytes or more and no heading or tick, stands earlier too."""
    rows = rows.withColumn("trimmed", T.trim(F.col("line")))
    long = (F.octet_length("trimmed") >= 20) & ~F.col("trimmed").rlike("^[#`]")
    return rows.withColumn("repeat", long & (F.row_number().over(Window.partitionBy(id_col, "trimmed").orderBy("pos")) > 1)).drop("trimmed")


def replace_repeats(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows whose repeated lines are a reference to the first one's section."""
    marked = with_sections(with_repeats(rows, id_col), id_col).withColumn("trimmed", T.trim(F.col("line")))
    first = F.first("section").over(Window.partitionBy(id_col, "trimmed").orderBy("pos"))
    return marked.withColumn("line", F.when(F.col("repeat"), F.concat(F.lit("[see §"), first.cast("string"), F.lit("]"))).otherwise(F.col("line"))).drop("trimmed")


def merge_items(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, line): runs of short items of one indentation as one item; islands by a running sum."""
    item = F.regexp_extract("line", r"^(\s*)([-*] )(.*?)\s*$", 3)
    short = F.col("line").rlike(r"^\s*[-*] ") & (F.octet_length(item) <= 50) & ~item.contains(",")
    rows = rows.withColumns({"item": item, "key": F.when(short, F.regexp_extract("line", r"^\s*", 0))})
    same = F.coalesce(F.col("key") == F.lag("key").over(_before(id_col)), F.lit(False))
    rows = rows.withColumn("island", F.sum((~same).cast("int")).over(_before(id_col)))
    got = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    made = rows.groupBy(id_col, "island").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.first("key").alias("key"), F.count("*").alias("n"), got.alias("items"))
    return made.select(id_col, "pos", F.when(F.col("n") > 1, F.concat("key", F.lit("- "), F.array_join("items", ", "))).otherwise(F.col("line")).alias("line"))


def group_sections(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, line): a heading and what follows it as `title{...}`; lines before the first heading stay out."""
    title = T.heading_title(F.col("line"))
    rows = rows.withColumns({"title": title, "rest": F.when(title.isNotNull(), T.after_colon(F.col("line"))).otherwise(T.trim(F.col("line")))})
    rows = rows.withColumn("island", F.sum(F.col("title").isNotNull().cast("int")).over(_before(id_col))).where("island > 0")
    got = F.transform(F.array_sort(F.collect_list(F.when(F.col("rest") != "", F.struct("pos", "rest")))), lambda x: x["rest"])
    made = rows.groupBy(id_col, "island").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), got.alias("content"))
    return made.select(id_col, "pos", F.concat("title", F.lit("{"), F.array_join("content", " "), F.lit("}")).alias("line"))


def compress_tables(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows whose pipe tables (header, delimiters, data) have cells by spaces and no delimiters, where that is not longer."""
    piped = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    rows = rows.withColumn("piped", piped)
    turn = F.coalesce((F.col("piped") != F.lag("piped").over(_before(id_col))).cast("int"), F.lit(0))
    rows = rows.withColumn("island", F.sum(turn).over(_before(id_col)))
    inside = Window.partitionBy(id_col, "island").orderBy("pos")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|", -1), T.trim)
    rows = rows.withColumns({"nth": F.row_number().over(inside), "cells": cells})
    made = F.when(F.col("nth") == 2, F.lit(None).cast("string")).otherwise(F.array_join("cells", " "))
    rows = rows.withColumn("short", made)
    whole = Window.partitionBy(id_col, "island")
    old, new = F.sum(F.octet_length("line") + 1).over(whole), F.sum(F.octet_length("short") + 1).over(whole)
    rule = F.max(F.when(F.col("nth") == 2, F.col("line").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"))).over(whole)
    table = F.col("piped") & F.coalesce(rule, F.lit(False)) & (F.count("*").over(whole) > 2) & (new <= old)
    rows = rows.withColumn("table", table)
    return rows.where(~F.col("table") | (F.col("nth") != 2)).select(id_col, "pos", F.when(F.col("table"), F.col("short")).otherwise(F.col("line")).alias("line"))


def normalize_headings(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows whose # headings outside code are `title:`."""
    title = T.normalized_heading(F.col("line"))
    return with_fences(rows, id_col).withColumn("line", F.when(~F.col("in_code") & ~F.col("is_fence"), F.coalesce(title, "line")).otherwise(F.col("line"))).select(id_col, "pos", "line")


def repeated_blocks(rows: DataFrame, id_col: str = "doc_id", least: int = 3, most: int = 15, size: int = 30) -> DataFrame:
    """(id, n_lines, block, n, first_pos): blocks of consecutive lines that a document holds twice or more.

    Blocks are told apart by hashes of their lines' hashes; only of those that come twice are the lines joined and compared.
    """
    ahead = Window.partitionBy(id_col).orderBy("pos").rowsBetween(0, most - 1)
    line = F.struct(F.xxhash64("line").alias("h"), F.octet_length("line").alias("bytes"), F.col("line").rlike(r"\S").alias("full"))
    runs = rows.select(id_col, "pos", F.collect_list(line).over(ahead).alias("ahead"))
    head = lambda name: F.slice(f"ahead.{name}", F.lit(1), F.col("n_lines"))
    cut = runs.select(id_col, "pos", "ahead", F.explode(F.when(F.size("ahead") >= least, F.sequence(F.lit(least), F.size("ahead")))).alias("n_lines"))
    weighty = (F.aggregate(head("bytes"), F.col("n_lines") - 1, lambda a, x: a + x) >= size) & F.exists(head("full"), lambda x: x)
    cut = cut.where(weighty).select(id_col, "n_lines", F.xxhash64(head("h")).alias("h"), "pos")
    again = cut.groupBy(id_col, "n_lines", "h").agg(F.collect_list("pos").alias("at")).where(F.size("at") > 1)  # all of one document's
    again = again.select(id_col, "n_lines", F.explode("at").alias("start"))
    placed = again.select("*", F.explode(F.sequence("start", F.col("start") + F.col("n_lines") - 1)).alias("pos")).join(rows, [id_col, "pos"])
    got = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = placed.groupBy(id_col, "n_lines", "start").agg(got.alias("block"))
    return blocks.groupBy(id_col, "n_lines", "block").agg(F.count("*").alias("n"), F.min("start").alias("first_pos")).where("n > 1")


def seed_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 12, least: int = 4) -> DataFrame:
    """(id, seed, n): substrings of one length that a text holds often; the last place is not counted.  A row's text is counted within the row."""
    ship()

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None or not (places := often(text, length, least)):
                    continue
                found = [(x, n) for x, n in Counter(text[p : p + length] for p in places).items() if n >= least]
                ids = pa.repeat(batch.column(0)[i], len(found))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[id_col, "seed", "n"])

    rows = spread(df.select(id_col, F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, seed string, n long")


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): every run of letters and numbers."""
    return df.select(id_col, F.explode(words_of(F.col(text_col))).alias("word"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
