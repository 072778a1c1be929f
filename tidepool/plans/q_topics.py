"""Queries of the topic-enrichment job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..sources import topics
from ..sources.views import table, view
from . import query
from .oracle import register


def _messages(spark, sf):
    return view(spark, sf, "v_messages")


def _topic_values(spark, sf):
    """The source topic as records: key = id, value = ``{"message": ...}``."""
    return _messages(spark, sf).select("id", topics.encode_message(F.col("message")).alias("value"))


@query("decode_json")
def decode_json(spark, sf):
    v = _topic_values(spark, sf)
    return v.select("id", topics.decode_json(F.col("value")).alias("r")).select("id", "r.message")


register("decode_json", "SELECT id, message FROM v_messages")


@query("passthrough")
def passthrough(spark, sf):
    return E.passthrough(_messages(spark, sf))


register("passthrough", "SELECT id, message FROM v_messages")


@query("upper_text")
def upper_text(spark, sf):
    return E.upper_text(_messages(spark, sf))


# DuckDB upper-cases 'ß' to 'ẞ' where Spark (Java) gives 'SS'.
register("upper_text", "SELECT id, message, upper(replace(message, 'ß', 'SS')) AS message_upper FROM v_messages")


@query("text_length")
def text_length(spark, sf):
    return E.text_length(_messages(spark, sf))


register("text_length", "SELECT id, message, CAST(length(message) AS INTEGER) AS message_length FROM v_messages")


@query("length_category")
def length_category(spark, sf):
    return E.length_category(_messages(spark, sf))


register(
    "length_category",
    "SELECT id, message, CASE WHEN length(message) < 10 THEN 'short' WHEN length(message) < 30 THEN 'medium' "
    "ELSE 'long' END AS category FROM v_messages",
)


ENRICH_SQL = (
    "SELECT id, message, upper(replace(message, 'ß', 'SS')) AS message_upper, "
    "CAST(length(message) AS INTEGER) AS message_length, "
    "CASE WHEN length(message) < 10 THEN 'short' WHEN length(message) < 30 THEN 'medium' ELSE 'long' END AS category "
    "FROM v_messages"
)


@query("enrich_messages")
def enrich_messages(spark, sf):
    """Flagship: decode each topic record and enrich it (upper, length, category)."""
    return E.enrich_values(_topic_values(spark, sf), keep=["id"])


register("enrich_messages", ENRICH_SQL)


@query("topic_sink")
def topic_sink(spark, sf):
    """Enriched rows written to the sink topic as JSON values and read back with the sink schema."""
    from ..session import scratch_path
    from ..sources import schemas as S

    path = scratch_path(spark, "sink-topic")
    topics.write_sink(E.enrich_values(_topic_values(spark, sf)), path=path)
    return spark.read.text(path).select(F.from_json("value", S.SINK_TOPIC, {"mode": "FAILFAST"}).alias("r")).select("r.*")


register("topic_sink", f"SELECT message, message_upper, message_length, category FROM ({ENRICH_SQL})")


@query("message_generator")
def message_generator(spark, sf):
    """Generator records for every event sequence number."""
    return topics.generate_messages(table(spark, sf, "events").select(F.col("event_id").alias("i")))


register(
    "message_generator",
    "SELECT event_id AS i, CASE event_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'hello there friend' "
    "ELSE 'this is a much longer test message to exercise the category enrichment' END || '-' || CAST(event_id AS VARCHAR) "
    "AS message, CAST(event_id % 3 AS INTEGER) AS partition FROM events",
)
