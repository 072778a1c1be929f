"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ODD_SCHEMA = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("score", "kept", "fingerprint", "ids", "found", "k0", "c0", "h", "id", "body", "length"))])


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def odd_frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, *(["x"] * 11)) for i, t in rows], ODD_SCHEMA)


LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
ODD = [(1, "one two three four five"), (2, None), (3, ""), (4, " \t\n "), (5, "one two three four five"), (5, "one two three four five"), (None, "null id here"),
       (6, LONG), (7, "12 34 .. !!"), (8, "é ü   漢字 \U0001f600 x"), (-9, "one  two\nthree four five"), (None, None)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
