"""The minifier on streams: every operator works row by row, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.minify import minify


def read_markdown_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(path, text): files as they appear."""
    got = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_trigger).load(folder)
    return got.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def minify_stream(stream: DataFrame, out: str, checkpoint: str, config: Config = Config(), source: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Write minified rows as they come; exactly once, by the checkpoint and the file sink's log."""
    writer = minify(stream, config=config).drop("text").writeStream.format(source).option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
