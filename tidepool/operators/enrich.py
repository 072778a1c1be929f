"""The topic-enrichment query and its projections. Narrow (map-only): no shuffle at any scale.

One function serves batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import topics


def passthrough(df: DataFrame) -> DataFrame:
    """Copy source to sink unchanged."""
    return df.select("*")


def upper_text(df: DataFrame, col: str = "message") -> DataFrame:
    return df.select("*", T.upper_text(F.col(col)).alias("message_upper"))


def text_length(df: DataFrame, col: str = "message") -> DataFrame:
    return df.select("*", T.text_length(F.col(col)).alias("message_length"))


def length_category(df: DataFrame, col: str = "message") -> DataFrame:
    return df.select("*", T.length_category(F.col(col)).alias("category"))


def enrich(df: DataFrame, col: str = "message", keep: list[str] | None = None) -> DataFrame:
    """message, message_upper, message_length, category (plus any ``keep`` lineage columns)."""
    return df.select(*(keep or []), *T.enrich_columns(F.col(col)))


def enrich_values(df: DataFrame, value_col: str = "value", on_error: str = "fail", keep: list[str] | None = None) -> DataFrame:
    """Decode JSON record values, then enrich: the whole source -> sink query."""
    decoded = df.select(*(keep or []), topics.decode_json(F.col(value_col), on_error).alias("r"))
    return enrich(decoded.select(*(keep or []), "r.message"), keep=keep)
