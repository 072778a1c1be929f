"""Artifact catalog: listing, search, totals, display sizes, object names, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format as FM

# Statuses that no longer hold an artifact.
INACTIVE = ["deleted", "failed"]


def live_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def list_artifacts(jars: DataFrame, host: str, port: str, bucket: str) -> DataFrame:
    return live_rows(jars).withColumn("url", FM.artifact_url(F.col("object_name"), host, port, bucket)) \
        .orderBy(F.col("created_at").desc(), F.col("id").desc())


def search_artifacts(jars: DataFrame, text: str) -> DataFrame:
    return jars.where(F.lower(F.col("name")).contains(F.lit(text.lower())))


def artifact_totals(jars: DataFrame) -> DataFrame:
    return jars.agg(F.count(F.lit(1)).alias("n_artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def human_sizes(jars: DataFrame) -> DataFrame:
    return jars.select("id", "size_bytes", FM.human_size(F.col("size_bytes")).alias("size_text"))


def safe_object_names(jars: DataFrame, prefix_col: str) -> DataFrame:
    return jars.select("id", "name", FM.safe_object_name(F.col("name"), F.col(prefix_col)).alias("object_name"))


def artifact_references(jars: DataFrame, deployments: DataFrame) -> DataFrame:
    """Per live artifact, live deployments still using it (any status but deleted/failed); deletable iff none.

    The count is a grouped aggregate (map-side combined) joined back to the artifacts.
    """
    active = live_rows(deployments).where(~F.col("status").isin(INACTIVE) & F.col("jar_id").isNotNull())
    refs = active.groupBy(F.col("jar_id").alias("id")).agg(F.count(F.lit(1)).alias("n_active"))
    out = live_rows(jars).select("id", "name").join(refs, "id", "left")
    n = F.coalesce(F.col("n_active"), F.lit(0)).cast("long")
    return out.select("id", "name", n.alias("n_active"), (n == 0).alias("deletable"))
