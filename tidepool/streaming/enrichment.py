"""The enrichment stream on plain Structured Streaming: checkpointed query, idempotent sink, continuity audit.

A query keeps its position in its checkpoint folder. Its sink is a ``foreachBatch`` writer that overwrites
``run=<n>/batch=<id>``: a batch that is run again after a failure or a stop in mid-flight rewrites the same folder, so
starting again on the same checkpoint loses and repeats nothing. A start on a fresh checkpoint is a new run, which
reads the topic from its earliest record again; ``once_each`` then takes every record once, by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import enrich as E
from ..session import FINE_PARTS
from ..sources import topics


def enrichment_stream(spark: SparkSession, source_path: str, on_error: str = "fail", max_files_per_trigger: int | None = None) -> DataFrame:
    """Topic twin -> decoded, enriched rows with the record key."""
    raw = topics.read_topic_stream(spark, path=source_path, max_files_per_trigger=max_files_per_trigger)
    return E.enrich_values(raw.select("key", "value"), on_error=on_error, keep=["key"])


def start(spark: SparkSession, source_path: str, out: str, checkpoint: str, run: int = 0, every: str | None = None) -> StreamingQuery:
    """Start the query; ``every`` is a processing-time interval, without it the query ends when the topic is read."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/run={run}/batch={batch_id}")

    w = enrichment_stream(spark, source_path).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def start_deployment(spark: SparkSession, source_path: str, out: str, configuration: dict[str, str], storage: str = "", every: str | None = "") -> StreamingQuery:
    """Start the query of one deployment as its checkpoint configuration says: interval and folders.

    ``storage`` takes the place of ``s3:/`` in folder names, for a store that is mounted elsewhere. Micro-batches commit once per trigger, so the interval is
    the trigger's; a pause between checkpoints has no counterpart.
    """
    folder = configuration["state.checkpoints.dir"]
    if storage:
        folder = folder.replace("s3:/", storage, 1)
    return start(spark, source_path, out, folder, every=f"{int(configuration['execution.checkpointing.interval'])} milliseconds" if every == "" else every)


def read_sink(spark: SparkSession, out: str) -> DataFrame:
    """Every batch of every run (partition columns run, batch): what a reader of the sink sees."""
    return spark.read.option("basePath", out).parquet(f"{out}/run=*/batch=*")


def once_each(sink: DataFrame, key: str = "key") -> DataFrame:
    """Every record once: of the copies that several runs emitted, one. Whole records are sorted for it, so they are dealt finely."""
    return sink.repartition(FINE_PARTS, key).dropDuplicates([key])


def emissions(sink: DataFrame, key: str = "key") -> DataFrame:
    """Every record once, as ``once_each`` takes it, with its ``copies`` and the number of ``runs`` that emitted it. Its copies are dealt once for all three."""
    record = F.struct(*[c for c in sink.columns if c not in (key, "run", "batch")])
    counted = sink.repartition(FINE_PARTS, key).groupBy(key).agg(F.first(record).alias("r"), F.count(F.lit(1)).alias("copies"), F.count_distinct("run").alias("runs"))
    return counted.select(key, "r.*", "copies", "runs")


def continuity_audit(sent: DataFrame, received: DataFrame, col: str = "message") -> DataFrame:
    """Per distinct message: copies sent and received, and whether any went missing,
    were duplicated or appeared without being sent. NULL messages compare equal."""
    s = sent.groupBy(F.col(col).alias("m")).agg(F.count(F.lit(1)).alias("sent"))
    r = received.groupBy(F.col(col).alias("m2")).agg(F.count(F.lit(1)).alias("received"))
    j = s.join(r, s["m"].eqNullSafe(r["m2"]), "full_outer")
    sent_n, recv_n = F.coalesce("sent", F.lit(0)).cast("long"), F.coalesce("received", F.lit(0)).cast("long")
    status = (F.when(sent_n == recv_n, "ok").when(sent_n == 0, "extra")
              .when(recv_n < sent_n, "missing").otherwise("duplicated"))
    return j.select(F.when(F.col("sent").isNotNull(), F.col("m")).otherwise(F.col("m2")).alias(col),
                    sent_n.alias("sent"), recv_n.alias("received"), status.alias("status"))
