"""Cluster snapshot documents (custom resources, pods, events, state snapshots).

Real snapshots are JSON files (one document per line) read with an explicit nested
schema (``read_documents``). The stand-in custom resources are serialised to JSON and
parsed back through ``parse_documents``, so that path runs end to end in every fleet
query; pods, events and state snapshots are handed over as already-typed documents of
the declared schema (``*_documents`` still gives their JSON text for file round trips).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S
from .views import view


def read_documents(spark: SparkSession, path: str, ddl: str, on_error: str = "fail") -> DataFrame:
    """Read JSON snapshot files. ``on_error='fail'`` stops on a malformed document."""
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    return spark.read.schema(ddl).option("mode", mode).json(path)


def watch_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Stream of the JSON snapshot files below ``path``, as they arrive: the document's fields, ``poll_ms`` (the folder of its listing), ``file``
    and ``_corrupt_record`` (the text of what is no document, else null). A folder that does not exist fails at once."""
    raw = spark.readStream.schema(f"{ddl}, poll_ms long, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file"))


def follow_documents(spark: SparkSession, path: str, ddl: str, out: str, checkpoint: str) -> None:
    """Take what has arrived below ``path`` (call again after more has): of each micro-batch the newest document of every
    name, and the texts that are no document, each batch in a folder of its own that it overwrites when it is run again."""
    fields = T.StructType.fromDDL(ddl).names

    def step(batch: DataFrame, batch_id: int) -> None:
        bad = F.col("_corrupt_record").isNotNull() | F.col("metadata.name").isNull()
        batch = batch.persist()
        try:
            batch.where(bad).select("file", "poll_ms", "_corrupt_record").write.mode("overwrite").parquet(f"{out}/corrupt/batch={batch_id}")
            newest_documents(batch.where(~bad).select("poll_ms", *fields)).write.mode("overwrite").parquet(f"{out}/documents/batch={batch_id}")
        finally:
            batch.unpersist()

    watch_documents(spark, path, ddl).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_documents(docs: DataFrame) -> DataFrame:
    """Of every (namespace, name) the document of its newest listing."""
    fields = [c for c in docs.columns if c != "poll_ms"]
    newest = docs.groupBy(F.col("metadata.namespace").alias("_ns"), F.col("metadata.name").alias("_name")).agg(F.max_by(F.struct("poll_ms", *fields), F.struct("poll_ms", F.to_json(F.struct(*fields)))).alias("d"))
    return newest.select("d.*")


def followed_documents(spark: SparkSession, out: str, ddl: str) -> DataFrame:
    """The newest document of every name over all batches."""
    return newest_documents(spark.read.schema(f"poll_ms long, {ddl}").parquet(f"{out}/documents/batch=*"))


def corrupt_files(spark: SparkSession, out: str) -> DataFrame:
    """file, poll_ms and the number of its texts that are no document."""
    rows = spark.read.schema("file string, poll_ms long, _corrupt_record string").parquet(f"{out}/corrupt/batch=*")
    return rows.groupBy("file", "poll_ms").agg(F.count(F.lit(1)).alias("n"))


def parse_documents(df: DataFrame, ddl: str, col: str = "doc", on_error: str = "fail") -> DataFrame:
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    return df.select(F.from_json(F.col(col), ddl, {"mode": mode}).alias("d")).select("d.*")


def _json(c: Column) -> Column:
    return F.to_json(c).alias("doc")


def cr_documents(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, and the columns ``keep`` of the view it is made of; a filter on them needs no documents."""
    v = view(spark, sf_dir, "v_cr")
    cond = F.transform(
        F.sequence(F.lit(0), F.col("n_conditions") - 1),
        lambda k: F.struct(
            F.when(k == 0, "Ready").otherwise("Progressing").alias("type"),
            F.when(F.col("jm_status") == "READY", "True").otherwise("False").alias("status"),
            F.when(k == 0, "JobManagerReady").otherwise("Reconciling").alias("reason"),
            F.concat(F.lit("condition "), k.cast("string"), F.lit(" of "), F.col("name")).alias("message"),
            F.col("cond_time").alias("lastTransitionTime"),
        ),
    )
    conditions = F.when(F.col("n_conditions") > 0, cond)
    history = F.transform(
        F.sequence(F.lit(0), F.col("n_history") - 1),
        lambda k: F.concat(F.lit("s3://flink-"), F.col("name"), F.lit("/savepoints/history-"), k.cast("string")),
    )
    doc = F.struct(
        F.struct(F.col("name").alias("name"), F.col("namespace").alias("namespace")).alias("metadata"),
        F.struct(F.struct(F.col("spec_job_state").alias("state")).alias("job")).alias("spec"),
        F.struct(
            F.col("lifecycle_state").alias("lifecycleState"),
            F.col("jm_status").alias("jobManagerDeploymentStatus"),
            F.struct(
                F.col("job_state").alias("state"),
                F.col("upgrade_path").alias("upgradeSavepointPath"),
                F.struct(F.when(F.col("n_history") > 0, history).alias("savepointHistory")).alias("savepointInfo"),
                F.struct(F.col("job_note").alias("message")).alias("lastRestore"),
            ).alias("jobStatus"),
            F.col("error").alias("error"),
            conditions.alias("conditions"),
        ).alias("status"),
    )
    return v.select(_json(doc), *keep)


def cr_file_documents(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents as the cluster writes them: an error that is an object is one, not its text."""
    docs = cr_documents(spark, sf_dir, keep)
    error = F.get_json_object("doc", "$.status.error")
    quoted = F.to_json(F.struct(error.alias("error")))
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    as_object = F.replace(F.col("doc"), inner, F.concat(F.lit('"error":'), error))
    return docs.select(F.when(error.startswith("{"), as_object).otherwise(F.col("doc")).alias("doc"), *keep)


def custom_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(cr_documents(spark, sf_dir), S.CR_DDL)


def pod_documents(spark: SparkSession, sf_dir: str, as_json: bool = True) -> DataFrame:
    v = view(spark, sf_dir, "v_pods")

    def container(i: int) -> Column:
        return F.struct(
            F.col(f"c{i}_name").alias("name"),
            F.col(f"c{i}_ready").alias("ready"),
            F.col(f"c{i}_restarts").alias("restartCount"),
            F.col(f"c{i}_state").alias("state"),
            F.col(f"c{i}_last_state").alias("lastState"),
        )

    doc = F.struct(
        F.struct(
            F.col("pod_name").alias("name"),
            F.col("namespace").alias("namespace"),
            F.create_map(F.lit("app"), F.col("app"), F.lit("component"), F.lit("taskmanager")).alias("labels"),
        ).alias("metadata"),
        F.struct(F.col("node").alias("nodeName")).alias("spec"),
        F.struct(
            F.col("phase").alias("phase"),
            F.col("reason").alias("reason"),
            F.col("start_time").alias("startTime"),
            F.when(~F.col("no_containers"), F.array(container(1), container(2))).alias("containerStatuses"),
        ).alias("status"),
    )
    return v.select(_json(doc)) if as_json else v.select(doc.alias("d")).select("d.*")


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pod_documents(spark, sf_dir, as_json=False)


def event_documents(spark: SparkSession, sf_dir: str, as_json: bool = True) -> DataFrame:
    v = view(spark, sf_dir, "v_k8s_events")
    doc = F.struct(
        F.col("event_id").alias("uid"),
        F.col("reason"),
        F.col("message"),
        F.col("type"),
        F.struct(F.col("object_kind").alias("kind"), F.col("object_name").alias("name"), F.col("namespace").alias("namespace")).alias(
            "involvedObject"
        ),
        F.col("first_ts").alias("firstTimestamp"),
        F.col("last_ts").alias("lastTimestamp"),
        F.col("event_time").alias("eventTime"),
        F.col("count"),
    )
    return v.select(_json(doc)) if as_json else v.select(doc.alias("d")).select("d.*")


def k8s_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_documents(spark, sf_dir, as_json=False)


def snapshot_documents(spark: SparkSession, sf_dir: str, as_json: bool = True) -> DataFrame:
    v = view(spark, sf_dir, "v_snapshots")
    labels = F.create_map(
        F.lit("job-reference.name"), F.col("job_name"),
        F.lit("snapshot.trigger-type"), F.col("trigger_type"),
        F.lit("snapshot.type"), F.col("snap_type"),
    )
    doc = F.struct(
        F.struct(F.col("name").alias("name"), F.col("namespace").alias("namespace"), F.col("created").alias("creationTimestamp"), labels.alias("labels")).alias(
            "metadata"
        ),
        F.struct(F.col("state"), F.col("path"), F.col("result_ts").alias("resultTimestamp"), F.col("error")).alias("status"),
    )
    return v.select(_json(doc)) if as_json else v.select(doc.alias("d")).select("d.*")


def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_documents(spark, sf_dir, as_json=False)
