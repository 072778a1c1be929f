"""Log streams: live tail of log-store frames, date-partitioned log store, back-fill then tail."""

from __future__ import annotations

import logging
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..session import drop_path, list_names, scratch_path

FRAME_DDL = "streams array<struct<stream:map<string,string>, `values`:array<array<string>>>>"
# Retention configured for the log store (off by default, as in the original set-up).
RETENTION_HOURS = 720


def log_date(ts_ns) -> F.Column:
    """UTC calendar day of a nanosecond timestamp, as 'yyyy-MM-dd' (time-zone independent)."""
    return F.date_from_unix_date(F.floor(ts_ns / F.lit(86_400 * 10**9)).cast("int")).cast("string")


def frames_of(lines: DataFrame) -> DataFrame:
    """Encode log lines as tail frames (one stream with one [ts, line] pair per frame)."""
    labels = F.create_map(F.lit("app"), F.col("app"), F.lit("component"), F.col("component"),
                          F.lit("namespace"), F.col("namespace"), F.lit("pod"), F.col("pod"))
    frame = F.struct(F.array(F.struct(labels.alias("stream"),
                                      F.array(F.array(F.col("ts_ns").cast("string"), F.col("line"))).alias("values"))).alias("streams"))
    return lines.select(F.to_json(frame).alias("value"))


def read_tail(spark: SparkSession, path: str) -> DataFrame:
    """Tail frames (JSON lines) -> flat log lines; malformed frames are skipped, not fatal."""
    raw = spark.readStream.format("text").load(path)
    f = raw.select(F.from_json("value", FRAME_DDL, {"mode": "PERMISSIVE"}).alias("f")).where(F.col("f.streams").isNotNull())
    return L.flatten_streams(f.select(F.explode("f.streams").alias("s")).select("s.stream", "s.values"))


def tail(spark: SparkSession, frames_path: str, q: L.LogQuery, out: str, checkpoint: str) -> DataFrame:
    """Run the query's predicates over the live tail (availableNow) and return the sink."""
    s = L.apply_predicates(read_tail(spark, frames_path), q)
    w = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.parquet(out)


def store_logs(lines: DataFrame, out: str, checkpoint: str) -> None:
    """Persist a (streaming) log DataFrame partitioned by day.

    Every micro-batch writes its own sub-folder of each day (``batch``), by dynamic overwrite: a batch that is run again replaces what it had written, and whole
    days can be dropped later, as no log of files stands beside the store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch").parquet(out)

    lines.withColumn("log_date", log_date(F.col("ts_ns"))).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _cutoff(now_ns: int, hours: int = RETENTION_HOURS) -> int:
    return now_ns - hours * 3600 * 10**9


def expire(spark: SparkSession, store: str, now_ns: int, hours: int = RETENTION_HOURS) -> list[str]:
    """Drop the whole days of a store that lie before ``now_ns`` less ``hours``; the days dropped, as 'yyyy-MM-dd'.

    The day that the cut-off falls into stays: ``read_log_store`` leaves out its expired lines. No line is read or written.
    """
    day = (datetime(1970, 1, 1) + timedelta(seconds=_cutoff(now_ns, hours) // 10**9)).strftime("%Y-%m-%d")
    gone = [n for n in list_names(spark, store) if n.startswith("log_date=") and n.removeprefix("log_date=") < day]
    for name in gone:
        drop_path(spark, f"{store}/{name}")
    return [n.removeprefix("log_date=") for n in gone]


def read_log_store(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None,
                   now_ns: int | None = None, retention: bool = False) -> DataFrame:
    """Read the day-partitioned store; the day range of [start, end) prunes partitions.
    With ``retention`` only the last RETENTION_HOURS before ``now_ns`` are visible: later days whole, the cut-off's day by line."""
    df = spark.read.parquet(path).withColumn("log_date", F.col("log_date").cast("string")).drop("batch")
    if start_ns is not None:
        df = df.where(F.col("log_date") >= log_date(F.lit(start_ns))).where(F.col("ts_ns") >= start_ns)
    if end_ns is not None:
        df = df.where(F.col("log_date") <= log_date(F.lit(end_ns))).where(F.col("ts_ns") < end_ns)
    if retention and now_ns is not None:
        cut = F.lit(_cutoff(now_ns))
        df = df.where(F.col("log_date") >= log_date(cut)).where((F.col("log_date") > log_date(cut)) | (F.col("ts_ns") >= cut))
    return df


#: Fixed value: what a viewer is told when the look-back cannot be read.
BACKFILL_WARNING = "History backfill unavailable"


def backfill_then_tail(spark: SparkSession, store: str, live: DataFrame, q: L.LogQuery, now_ns: int) -> DataFrame:
    """The store's lines of the look-back before ``now_ns`` (pruned by day), then the live lines from then on."""
    start_ns, end_ns = L.default_range(now_ns)
    history = L.apply_predicates(read_log_store(spark, store, start_ns, end_ns), q).withColumn("ts_ms", F.col("ts_ns") / F.lit(1e6))
    return history.select(*live.columns).unionByName(live.where(F.col("ts_ns") >= now_ns))


def backfill_or_warn(spark: SparkSession, store: str, live: DataFrame, q: L.LogQuery, now_ns: int) -> DataFrame:
    """``backfill_then_tail`` with an ``event`` column (line or warning); a look-back that cannot be read gives one warning, and the tail goes on.

    The look-back is read here, into a table of its own, so that a store that is broken anywhere (no folder, a file that is none) shows now and not in the tail.
    """
    start_ns, end_ns = L.default_range(now_ns)
    after = live.where(F.col("ts_ns") >= now_ns).withColumn("event", F.lit("line"))
    held = scratch_path(spark, "backfill")
    try:
        history = L.apply_predicates(read_log_store(spark, store, start_ns, end_ns), q).withColumn("ts_ms", F.col("ts_ns") / F.lit(1e6)).select(*live.columns)
        history.write.parquet(held)
    except (PySparkException, Py4JJavaError) as e:  # the latter: what a task met
        logging.getLogger(__name__).warning("log history back-fill failed: %s", str(e).splitlines()[0])
        told = {"event": "warning", "line": BACKFILL_WARNING}
        return spark.range(1).select(*[F.lit(told.get(f.name)).cast(f.dataType).alias(f.name) for f in after.schema]).unionByName(after)
    return spark.read.schema(live.schema).parquet(held).withColumn("event", F.lit("line")).unionByName(after)
