"""Enrichment query: generator fixtures, category bounds, NULL/empty/emoji/ß edges, JSON decode."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import enrich as E
from tidepool.sources import topics


def test_generator_fixture(spark):
    seq = spark.createDataFrame([(0,), (1,), (2,)], "i long")
    rows = {r["i"]: r for r in E.enrich(topics.generate_messages(seq), keep=["i"]).collect()}
    assert (rows[0]["message"], rows[0]["message_length"], rows[0]["category"]) == ("hi-0", 4, "short")
    assert (rows[1]["message"], rows[1]["message_length"], rows[1]["category"]) == ("hello there friend-1", 20, "medium")
    assert rows[2]["message_length"] == 72 and rows[2]["category"] == "long"
    assert topics.generate_messages(seq).collect()[1]["partition"] == 1


@pytest.mark.parametrize("text,cat", [("a" * 9, "short"), ("a" * 10, "medium"), ("a" * 29, "medium"), ("a" * 30, "long"),
                                      ("", "short"), (None, "long")])
def test_category_bounds(spark, text, cat):
    df = spark.createDataFrame([(text,)], "message string")
    assert E.enrich(df).collect()[0]["category"] == cat


def test_emoji_and_sharp_s(spark):
    df = spark.createDataFrame([("😀a",), ("straße",)], "message string")
    rows = E.enrich(df).collect()
    assert rows[0]["message_length"] == 2
    assert rows[1]["message_upper"] == "STRASSE"


def test_decode_modes(spark):
    df = spark.createDataFrame([('{"message": "x"}',), ("{}",), ('{"message": 5}',)], "value string")
    rows = E.enrich_values(df).collect()
    assert rows[0]["message"] == "x" and rows[1]["message"] is None and rows[1]["category"] == "long"
    bad = spark.createDataFrame([("not json",)], "value string")
    with pytest.raises(Exception):
        E.enrich_values(bad).collect()
    q = bad.select(topics.decode_json(F.col("value"), "quarantine").alias("r")).collect()
    assert q[0]["r"]["message"] is None


def test_sink_keeps_nulls(spark):
    df = spark.createDataFrame([(None,)], "message string")
    v = topics.encode_json(E.enrich(df)).collect()[0]["value"]
    assert v == '{"message":null,"message_upper":null,"message_length":null,"category":"long"}'


def test_kafka_options():
    o = topics.kafka_source_options("b1:9092,b2:9092")
    assert o["subscribe"] == "source" and o["startingOffsets"] == "earliest" and o["kafka.group.id"] == "flink-test-group"
