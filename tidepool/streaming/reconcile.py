"""Continuous reconciliation: complete polls of the custom resources update the registry's state.

A poll is one listing of all custom resources. Its records carry the poll's time and the number of its documents; one record without a
document ends the listing, so an empty one is a poll too. Records may arrive in any number of micro-batches, in any order and more than once.

Spark's own keyed state says when a poll may be whole: its records are counted in the state store, a row a poll, dropped once the watermark (``LATENESS``
behind the newest poll) has passed. The counts that change come to ``foreachBatch`` in update mode. Of a poll with enough records that is newer than the
last one applied (older ones are superseded), the documents are read from its own folder, each (namespace, name) once, so that state
does not grow with the fleet; if there are as many as the poll has, the registry is read anew, and the rows that changed are written as partition
``batch=<id>`` of one table, with one row (of no deployment) for the poll itself. A batch that is run again reads the
partitions below its own and overwrites its own, so a crash between writing and committing does no harm.

The registry stays the master of what users do to it: of a registry row and the newest change of it here, the newer
one (``updated_at`` against the poll's time) holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fleet as FL
from ..operators import fleet as FO
from ..session import path_exists, shuffles_freed
from ..sources import schemas as S

FIELDS = ["status", "pending_action", "error_message", "last_savepoint_path"]
CHANGE_DDL = "id long, status string, pending_action string, error_message string, last_savepoint_path string, captured_savepoint string, poll_ms long"
POLL_DDL = "poll_ms long, n_docs long, doc string"
#: A poll whose records are this far behind the newest poll is given up.
LATENESS = "1 hour"
#: Seconds between two polls while something is in transition.
POLL_SECONDS = 4.0
#: Parts of the state, which has a row a poll; each part costs every pass a task and its files.
STATE_PARTS = 4
#: Records in one compressed file of a poll at most; a task reads a whole file.
FILE_RECORDS = 50_000


def _blank(spark: SparkSession, n: int) -> DataFrame:
    """``n`` changes of no deployment."""
    return spark.range(n).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in CHANGE_DDL.split(", "))])


def _log(spark: SparkSession, base: str, before: int | None) -> DataFrame:
    """Rows that batches below ``before`` (all if None) have written."""
    path = f"{base}/changes"
    if not path_exists(spark, path):
        return _blank(spark, 0)
    rows = spark.read.schema(f"{CHANGE_DDL}, batch long").parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def changes(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The newest change of every deployment that has one."""
    rows = _log(spark, base, before).where("id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct(*FIELDS, "poll_ms"), "poll_ms").alias("c")).select("id", "c.*")


def savepoints(spark: SparkSession, base: str, known: DataFrame) -> DataFrame:
    """Savepoints that completed stops left behind and that are not ``known`` (deployment_id, path)."""
    rows = _log(spark, base, None).where("captured_savepoint is not null")
    return FO.stop_savepoint_capture(rows, known).distinct()


def current(registry: DataFrame, changed: DataFrame) -> DataFrame:
    """The registry with the changes that are newer than its rows."""
    c = changed.select(F.col("id").alias("_id"), F.struct(*FIELDS).alias("_c"), F.col("poll_ms").alias("_at"))
    j = registry.join(c, registry["id"] == F.col("_id"), "left")
    own = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', updated_at)")
    newer = F.col("_at").isNotNull() & F.coalesce(F.col("_at") * 1000 >= own, F.lit(True))
    out = j
    for f in FIELDS:
        out = out.withColumn(f, F.when(newer, F.col(f"_c.{f}")).otherwise(F.col(f)))
    return out.drop("_id", "_c", "_at")


def _parsed(df: DataFrame, col: str, ddl: str, mode: str) -> DataFrame:
    """The fields of a JSON column, parsed once a row: conditions on them (a join brings some, too) stay above a generator, while those on a plain column
    are moved below it and parse the text again."""
    return df.select(F.inline(F.array(F.from_json(col, ddl, {"mode": mode}))))


def _records(raw: DataFrame) -> DataFrame:
    return _parsed(raw, "value", POLL_DDL, "FAILFAST")


def poll_counts(records: DataFrame) -> DataFrame:
    """poll_ms, n (records of documents that have arrived, repeated ones too) and n_docs (that the poll has) of a stream of poll records."""
    at = records.select(F.timestamp_millis("poll_ms").alias("at"), "poll_ms", "n_docs", F.col("doc").isNotNull().alias("some")).withWatermark("at", LATENESS)
    return at.groupBy("at", "poll_ms").agg(F.count_if("some").alias("n"), F.max("n_docs").alias("n_docs")).select("poll_ms", "n", "n_docs")


def _arrived(spark: SparkSession, polls_path: str, poll: int) -> DataFrame:
    """doc of every record of one poll, copies too, and null of those that end a listing."""
    return _records(spark.read.schema("value string, poll_ms long").text(polls_path).where(F.col("poll_ms") == poll)).select("doc")


def poll_names(docs: DataFrame) -> DataFrame:
    """namespace and name of documents, each once; the name is null for what has none."""
    return _parsed(docs, "doc", "metadata struct<namespace: string, name: string>", "PERMISSIVE").select("metadata.namespace", "metadata.name").distinct()


def poll_status(docs: DataFrame) -> DataFrame:
    """The status of documents, one of each (namespace, name); they are dealt first, so that no task sorts them twice."""
    status = FO.cr_status(_parsed(docs, "doc", S.CR_DDL, "FAILFAST"))
    return status.repartition("namespace", "name").dropDuplicates(["namespace", "name"])


def apply_poll(spark: SparkSession, read_registry: Callable[[], DataFrame], counts: DataFrame, batch_id: int, polls_path: str, base: str) -> tuple[int, int] | None:
    """One micro-batch of poll counts: the poll that was applied, if any, and how many deployments it leaves in transition."""
    last = _log(spark, base, batch_id).where("id is null").agg(F.max("poll_ms")).first()[0]
    enough = counts.where("n >= n_docs").select("poll_ms", "n_docs").collect()  # of the polls that the watermark keeps
    poll = None
    for at, n_docs in sorted(enough, reverse=True):
        if last is not None and at <= last:
            return None
        if not n_docs or poll_names(_arrived(spark, polls_path, at)).agg(F.count("name")).first()[0] >= n_docs:
            poll = at
            break
    if poll is None:
        return None
    status = poll_status(_arrived(spark, polls_path, poll))
    before = current(FO.live(read_registry()), changes(spark, base, batch_id))
    seen = Observation(f"poll-{batch_id}")
    moving = F.count_if(FL.in_transition(F.col("status"), F.col("pending_action")))
    done = FO.changed_rows(FO.reconcile(before, status).observe(seen, moving.alias("moving")))
    at = F.lit(poll).cast("long").alias("poll_ms")
    mark = _blank(spark, 1).withColumn("poll_ms", at)
    done.select("id", *FIELDS, "captured_savepoint", at).unionByName(mark).write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id}")
    return poll, seen.get["moving"]


def reconcile_stream(spark: SparkSession, read_registry: Callable[[], DataFrame], polls_path: str, base: str) -> list[tuple[int, int]]:
    """Run one availableNow pass over newly arrived poll records (call again after more arrive); the polls applied, with
    the number of deployments that each leaves in transition."""
    counting = spark.newSession()
    counting.conf.set("spark.sql.shuffle.partitions", STATE_PARTS)
    raw = counting.readStream.schema("value string, poll_ms long").format("text").load(polls_path)
    applied: list[tuple[int, int]] = []

    def step(batch: DataFrame, batch_id: int) -> None:
        with shuffles_freed(spark):
            found = apply_poll(spark, read_registry, batch, batch_id, polls_path, base)
        if found:
            applied.append(found)

    poll_counts(_records(raw)).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{base}/ckpt") \
        .trigger(availableNow=True).start().awaitTermination()
    return applied


def watch(spark: SparkSession, read_registry: Callable[[], DataFrame], poll: Callable[[int], None], polls_path: str, base: str,
          every: float = POLL_SECONDS, most: int | None = None) -> list[tuple[int, int]]:
    """Poll and reconcile every ``every`` seconds until a poll leaves nothing in transition (or ``most`` polls were made).

    ``poll`` writes the records of one listing. What is in transition is observed while a pass writes its changes, so no table is read for it.
    """
    applied: list[tuple[int, int]] = []
    for n in count():
        poll(n)
        done = reconcile_stream(spark, read_registry, polls_path, base)
        applied += done
        if (done and done[-1][1] == 0) or n + 1 == most:
            return applied
        time.sleep(every)
    return applied


def write_poll(docs: DataFrame, path: str, poll_ms: int, n_docs: int, last: bool = True) -> None:
    """Append documents of one poll as records of its folder, with the record that ends the listing if they are the ``last``."""
    if last:
        docs = docs.select("doc").unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("doc")))
    rec = F.struct(F.lit(poll_ms).cast("long").alias("poll_ms"), F.lit(n_docs).cast("long").alias("n_docs"), F.col("doc"))
    docs.select(F.to_json(rec).alias("value")).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(f"{path}/poll_ms={poll_ms}")
