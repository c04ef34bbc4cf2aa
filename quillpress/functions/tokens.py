"""Token estimate and savings: a token is four bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """Whole tokens in text, by bytes and not by characters; null for null."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def savings_pct(before: Column, after: Column) -> Column:
    """Percent saved, never below 0; 0 where nothing was there."""
    return F.when(before > 0, F.greatest(before - after, F.lit(0)) / before.cast("double") * 100).otherwise(F.lit(0.0))
