"""The minifier: one plan for a setting, over a DataFrame or a Column.

All passes are functions of one row, so they run in one Arrow batch function with no shuffle, and
work alike on batch and streaming DataFrames; statistics stay built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CodeMode, Config, Level
from ..functions.tokens import estimate_tokens, savings_pct
from ..workers import ship
from . import code, dedup, dictionary, grammar, lists, restructure, scan
from .spread import spread

# Schemes that addresses lose, in this order.
SCHEMES = ("https://", "http://", "file://", "ftp://")


def strip_frontmatter(text: str) -> str:
    if text.startswith("---\n"):
        head, end, rest = text[4:].partition("\n---\n")
        return rest if end else text
    return text


def strip_schemes(text: str) -> str:
    for x in SCHEMES:
        text = text.replace(x, "")
    return text


def _structured(text: str, config: Config) -> str:
    """The passes before the grammar's."""
    text = scan.apply_structure(text, config.level, config.code_blocks)
    if config.level >= Level.MEDIUM:
        text = strip_frontmatter(text)
        text = lists.inline_tiny_sections(lists.flatten_nested(text))
        text = lists.merge_short_items(strip_schemes(text))
        if config.code_blocks is CodeMode.COMPRESS:
            text = code.compress_blocks(text)
    return text


def _stripped(text: str, config: Config) -> str:
    """The grammar's pass and what follows it, up to the dictionary's."""
    if config.grammar:
        text = grammar.strip_grammar(text, config.grammar)
    return text if config.level is Level.OFF else dedup.deduplicate(text)


def _coded(text: str, config: Config) -> str:
    """The passes from the dictionary's on."""
    if config.level is Level.OFF:
        return text
    if config.dictionary:
        text = dictionary.compress(text)
    return restructure.restructure(text, config)


def minify_text(text: str, config: Config) -> str:
    """One text through all passes of the setting."""
    if config.level is not Level.OFF:
        text = _structured(text, config)
    return _coded(_stripped(text, config), config)


def minify_many(text: str, configs: list[Config]) -> list[str]:
    """One text through several settings; passes that settings share run once."""
    structured: dict[tuple, str] = {}
    stripped: dict[tuple, str] = {}
    out = []
    for c in configs:
        key = (c.level, c.code_blocks)
        if key not in structured:
            structured[key] = text if c.level is Level.OFF else _structured(text, c)
        if (*key, c.grammar) not in stripped:
            stripped[(*key, c.grammar)] = _stripped(structured[key], c)
        out.append(_coded(stripped[(*key, c.grammar)], c))
    return out


def text_udf(function) -> Column:
    """A text function as a vectorised expression; null stays null."""
    ship()

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if x is None else function(x) for x in batch.to_pylist()], pa.string())

    return run


def minify_output(text: Column, config: Config) -> Column:
    if config.level is Level.OFF and config.grammar is None:
        return text
    return text_udf(lambda x: minify_text(x, config))(text)


def minify_col(text: Column, config: Config = Config()) -> Column:
    """struct(output, input_tokens, output_tokens, savings_pct); null for null."""
    out = minify_output(text, config)
    before, after = estimate_tokens(text), estimate_tokens(out)
    made = F.struct(out.alias("output"), before.alias("input_tokens"), after.alias("output_tokens"), savings_pct(before, after).alias("savings_pct"))
    return F.when(text.isNotNull(), made)


def minify(df: DataFrame, text_col: str = "text", config: Config = Config(), on_error: str = "raise") -> DataFrame:
    """df with output, input_tokens, output_tokens and savings_pct; on_error "keep" keeps a failed row's text and adds error."""
    if on_error not in ("raise", "keep"):
        raise ValueError("on_error must be raise or keep")
    if config.level is not Level.OFF or config.grammar is not None:
        df = spread(df)
    text = F.col(text_col)
    if on_error == "raise":
        out = df.withColumn("output", minify_output(text, config))
    else:

        @F.pandas_udf("output string, error string")
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for x in texts:
                try:
                    rows.append((None if x is None else minify_text(x, config), None))
                except Exception as e:  # noqa: BLE001  the row says what failed
                    rows.append((x, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(rows, columns=["output", "error"], dtype=object)

        out = df.withColumn("__made", run(text)).withColumns({"output": F.col("__made.output"), "error": F.col("__made.error")}).drop("__made")
    before, after = estimate_tokens(text), estimate_tokens(F.col("output"))
    return out.withColumns({"input_tokens": before, "output_tokens": after, "savings_pct": F.when(text.isNotNull(), savings_pct(before, after))})


def register(spark: SparkSession, name: str = "minify") -> None:
    """minify(text, level) as an SQL function; level as in the command line."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else minify_text(x, Config(Level.parse(y))) for x, y in zip(texts, levels, strict=True)], dtype=object)

    spark.udf.register(name, run)
