"""Registry tables (deployments, savepoints, artifacts, defaults) with their fixed schemas.

``read_registry_table`` reads a real registry export (parquet, or JDBC options);
the ``*_from`` functions shape the stand-in views of ``sources.views`` into the same
schemas so that every job runs on identically typed input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .views import view


def read_registry_table(spark: SparkSession, ddl: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """Read one registry table from parquet or over JDBC and project it to the fixed schema."""
    if jdbc is not None:
        df = spark.read.format("jdbc").options(**jdbc).load()
    else:
        df = spark.read.schema(ddl).parquet(path)
    cols = [c.strip().split(" ", 1) for c in _split_top(ddl)]
    return df.select(*[F.col(n).cast(t) for n, t in cols])


def _split_top(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch in "<(":
            depth += 1
        elif ch in ">)":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    return [c.strip() for c in out if c.strip()]


def _entries(*pairs: tuple[str, str]):
    """map<string,string> from optional (key, value-column) pairs; NULL values are left out."""
    arr = F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(arr, lambda e: e["value"].isNotNull()))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_deployments")
    config = F.struct(
        F.col("namespace").alias("namespace"),
        F.col("cfg_image").alias("image"),
        F.col("cfg_flink_version").alias("flinkVersion"),
        F.col("cfg_service_account").alias("serviceAccount"),
        F.struct(F.col("jm_memory").alias("memory"), F.col("jm_cpu").alias("cpu"), F.col("jm_replicas").alias("replicas")).alias("jobManager"),
        F.struct(
            F.col("tm_memory").alias("memory"),
            F.col("tm_cpu").alias("cpu"),
            F.col("tm_replicas").alias("replicas"),
            F.col("tm_slots").alias("taskSlots"),
        ).alias("taskManager"),
        _entries(("parallelism.default", "conf_parallelism"), ("state.backend", "conf_backend")).alias("flinkConfiguration"),
    )
    resource = F.struct(
        F.lit("FlinkDeployment").alias("kind"),
        F.col("deployment_name").alias("name"),
        F.col("namespace").alias("namespace"),
        F.col("resource_uid").alias("uid"),
        F.lit("flink.apache.org/v1beta1").alias("apiVersion"),
    )
    resources = F.when(F.col("n_resources") > 0, F.array(resource)).otherwise(F.array().cast(f"array<{S.RESOURCE}>"))
    return v.select(
        "id",
        "deployment_name",
        "namespace",
        "status",
        config.alias("config"),
        resources.alias("resources"),
        "error_message",
        "deployment_mode",
        "jar_id",
        _entries(("STAGE", "env_stage"), ("REGION", "env_region")).alias("environment_variables"),
        "job_parallelism",
        "pending_action",
        F.lit(None).cast("string").alias("state_bucket_name"),
        "last_savepoint_path",
        "created_at",
        "updated_at",
        "deleted_at",
    )


def savepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_savepoints")
    return v.select(
        "id", "deployment_id", "path", "source", "created_at",
        F.col("created_at").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


def jars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_jars")


# The seeded configuration defaults row (namespace is ours).
DEFAULTS_ROW = dict(
    id=1, image="flink:1.19-kafka", flink_version="v1_19", service_account="flink", namespace="default",
    job_manager_memory="1024m", job_manager_cpu="0.5", job_manager_replicas=1,
    task_manager_memory="1024m", task_manager_cpu="0.5", task_manager_replicas=1, task_manager_slots=1,
)


def defaults(spark: SparkSession, row: dict | None = None) -> DataFrame:
    """The configuration defaults table (one seeded row unless given)."""
    r = dict(DEFAULTS_ROW, **(row or {}))
    cols = []
    for c in _split_top(S.DEFAULTS_DDL):
        n, t = c.split(" ", 1)
        cols.append(F.lit(r[n]).cast(t).alias(n))
    return spark.range(1).select(*cols)
