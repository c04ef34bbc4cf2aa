"""Reading corpora of Markdown files and tables, and writing what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters at most of a document in a recall report, and bytes at least.
LONGEST, SHORTEST = 50_000, 50


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_markdown(spark: SparkSession, *dirs: str) -> DataFrame:
    """(path, text): every *.md file below the folders; folders that are missing are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [d for d in dirs if (p := jvm.org.apache.hadoop.fs.Path(d)).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(there, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, text_col: str = "text", source: str = "parquet") -> DataFrame:
    """A table with a text column, of any format that Spark reads."""
    df = spark.read.format(source).load(path)
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col!r} in {path}")
    return df


def sample(df: DataFrame, n: int, key: str = "path", seed: int = 42) -> DataFrame:
    """n rows by the hash of a key: the same ones at every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def long_enough(df: DataFrame, text_col: str = "text", by_chars: bool = False) -> DataFrame:
    """Without texts under 50 bytes (or characters)."""
    size = F.length(text_col) if by_chars else F.octet_length(text_col)
    return df.where(size >= SHORTEST)


def shortened(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts cut to what a recall report reads."""
    return df.withColumn(text_col, F.substring(text_col, 1, LONGEST))


def write(df: DataFrame, path: str, source: str = "parquet", text_col: str | None = None) -> None:
    """Overwrite a folder; format text writes one column."""
    (df.select(text_col) if source == "text" else df).write.mode("overwrite").format(source).save(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def stats_line(input_tokens: int, output_tokens: int, savings_pct: float) -> str:
    return f"tokens: {input_tokens} → {output_tokens} ({savings_pct:.0f}% savings)"
