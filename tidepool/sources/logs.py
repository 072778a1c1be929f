"""Log sources: log-store result chunks, pod log files (docker envelope) and the JSON layout.

``read_pod_logs`` is the real source: it tails kubelet log files, takes the labels
from the file path and unwraps one JSON envelope per line. The ``*_from_view``
helpers shape the stand-in ``v_logs`` / ``v_json_logs`` rows into those inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .views import view

# The kubelet log path layout <ns>_<pod>_<uid>/<container>/<n>.log and container name.
MAIN_CONTAINER = "flink-main-container"
POD_PATH_PATTERN = r"/(?:pod_dir=)?([^/_]+)_([^/_]+)_([^/_]+)/(?:container=)?([^/]+)/[^/]+$"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log lines (app, component, namespace, pod, ts_ns, line)."""
    return view(spark, sf_dir, "v_logs").drop("event_id")


def log_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-store response chunks: label map + array of [ts_ns, line] string pairs."""
    v = view(spark, sf_dir, "v_logs")
    labels = F.create_map(
        F.lit("app"), F.col("app"), F.lit("component"), F.col("component"),
        F.lit("namespace"), F.col("namespace"), F.lit("pod"), F.col("pod"),
    )
    return v.select(labels.alias("stream"), F.array(F.array(F.col("ts_ns").cast("string"), F.col("line"))).alias("values"))


def json_log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-layout log records (one JSON object per line) with their stream labels."""
    v = view(spark, sf_dir, "v_json_logs")
    rec = F.struct(
        F.col("time_millis").alias("timeMillis"), F.col("level"), F.col("logger_name").alias("loggerName"),
        F.col("thread"), F.col("message"),
    )
    return v.select("app", "component", "namespace", "pod", F.to_json(rec).alias("value"))


def envelope_lines(df: DataFrame) -> DataFrame:
    """Wrap log lines in the container runtime's JSON envelope, keyed by the pod's log folder.

    Its time is RFC 3339 with up to nine fraction digits, none when it is a whole second.
    """
    second = F.expr("date_format(timestampadd(SECOND, CAST(floor(ts_ns / 1000000000) AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\")")
    rest = F.regexp_replace(F.lpad(F.pmod("ts_ns", F.lit(10**9)).cast("string"), 9, "0"), "0+$", "")
    time = F.concat(second, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("Z"))
    env = F.to_json(F.struct(F.concat(F.col("line"), F.lit("\n")).alias("log"), F.lit("stdout").alias("stream"), time.alias("time")))
    folder = F.concat_ws("_", F.col("namespace"), F.col("pod"), F.concat(F.lit("uid"), F.col("pod_uid")))
    return df.select(folder.alias("pod_dir"), F.lit(MAIN_CONTAINER).alias("container"), env.alias("value"))


def rfc3339_ns(text: Column) -> Column:
    """Epoch nanoseconds of an RFC 3339 time with any fraction and zone, NULL when it is none."""
    pattern = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    second = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.upper(part(4)))))
    return F.when(part(1) != "", second * F.lit(10**9) + F.rpad(part(3), 9, "0").cast("long"))


def parse_pod_log_lines(raw: DataFrame) -> DataFrame:
    """(value, file_path) -> labels from the path + the unwrapped line; lines that are no envelope with a time are skipped."""
    env = F.from_json(F.col("value"), S.ENVELOPE_DDL, {"mode": "PERMISSIVE"})
    p = raw.select(F.col("file_path"), env.alias("e"))
    path = F.col("file_path")
    line = F.regexp_replace(F.col("e.log"), r"\n$", "")
    return p.select(
        F.regexp_extract(path, POD_PATH_PATTERN, 1).alias("namespace"),
        F.regexp_extract(path, POD_PATH_PATTERN, 2).alias("pod"),
        F.regexp_extract(path, POD_PATH_PATTERN, 4).alias("container"),
        rfc3339_ns(F.col("e.time")).alias("ts_ns"),
        line.alias("line"),
    ).where((F.col("container") == MAIN_CONTAINER) & F.col("ts_ns").isNotNull() & F.col("line").isNotNull())


def read_pod_logs(spark: SparkSession, root: str, stream: bool = True) -> DataFrame:
    """Tail (or scan) every pod log file below ``root``."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("text").option("recursiveFileLookup", "true").load(root)
    return parse_pod_log_lines(raw.select("value", F.col("_metadata.file_path").alias("file_path")))


def attach_pod_labels(lines: DataFrame, pods: DataFrame) -> DataFrame:
    """Only running pods are scrape targets; their app/component labels come from the pod table.

    ``pods`` (name, namespace, app, component, phase) is a snapshot table; the join is a
    stream-static hash join on (namespace, pod).
    """
    running = pods.where(F.col("phase") == "Running").select(
        F.col("name").alias("pod"), "namespace", "app", "component")
    return lines.join(running, ["namespace", "pod"])
