"""Savepoint snapshots, outcomes, history, resume decisions and idempotent upserts.

A savepoint trigger is polled every five seconds until 120 s after it; every poll looks at the newest manual
savepoint snapshot created no earlier than one second before the trigger. Triggers and snapshots meet in a
range join: both carry a time bucket as wide as a trigger's window, a snapshot stands in its bucket and the one before, and a trigger looks into the bucket
that its window begins in, so the join is an equi-join on (deployment, namespace, bucket) whose groups are bounded by
one window's snapshots whatever the history. Triggers are dealt by these keys once: telling them apart, the join, which keeps those without
a snapshot, and the grouping by trigger all follow that dealing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Snapshot labels, creation tolerance, poll step and deadline.
LABEL_JOB = "job-reference.name"
LABEL_TRIGGER = "snapshot.trigger-type"
LABEL_TYPE = "snapshot.type"
MANUAL, SAVEPOINT = "MANUAL", "SAVEPOINT"
CREATION_TOLERANCE_MS = 1000
POLL_INTERVAL_MS = 5000
DEADLINE_MS = 120000
TRIGGER = ["deployment_name", "namespace", "trigger_ms"]


def _iso_ms(c):
    """Epoch ms of an ISO-8601 text (NULL when unparsable)."""
    return F.unix_millis(F.try_to_timestamp(c))


def manual_snapshots(snapshots: DataFrame) -> DataFrame:
    """The manual savepoint snapshots with a readable creation time."""
    labels = F.col("metadata.labels")
    return snapshots.where(
        (labels.getItem(LABEL_TRIGGER) == MANUAL) & (labels.getItem(LABEL_TYPE) == SAVEPOINT)
    ).select(
        labels.getItem(LABEL_JOB).alias("deployment_name"),
        F.col("metadata.namespace").alias("namespace"),
        _iso_ms(F.col("metadata.creationTimestamp")).alias("created_ms"),
        F.col("metadata.name").alias("snapshot_name"),
        F.col("status.state").alias("state"),
        F.nullif(F.col("status.path"), F.lit("")).alias("path"),
        _iso_ms(F.nullif(F.col("status.resultTimestamp"), F.lit(""))).alias("result_ms"),
        F.col("status.error").alias("error"),
    ).where(F.col("created_ms").isNotNull())


def in_window(triggers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every distinct trigger with each snapshot created within its window, one second before it to its deadline, or with nulls if there is none."""
    width = CREATION_TOLERANCE_MS + DEADLINE_MS + 1
    lo, hi = F.col("trigger_ms") - CREATION_TOLERANCE_MS, F.col("trigger_ms") + DEADLINE_MS
    keys = ["deployment_name", "namespace", "_bucket"]
    t = triggers.select(*TRIGGER, F.floor(lo / width).alias("_bucket")).repartition(*keys).distinct()
    s = manual_snapshots(snapshots)
    own = F.floor(F.col("created_ms") / width)
    s = s.select(*[F.col(c).alias(f"_{c}") if c in TRIGGER else F.col(c) for c in s.columns], F.explode(F.array(own, own - 1)).alias("_at"))
    met = (F.col("deployment_name") == F.col("_deployment_name")) & (F.col("namespace") == F.col("_namespace")) & (F.col("_bucket") == F.col("_at"))
    return t.join(s, met & (F.col("created_ms") >= lo) & (F.col("created_ms") <= hi), "left").drop("_deployment_name", "_namespace", "_at")


def snapshot_candidate(triggers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per distinct trigger: path, result time, completed, failed, failure reason of the newest snapshot of its window."""
    fields = ["snapshot_name", "path", "result_ms", "state", "error"]
    order = F.when(F.col("created_ms").isNotNull(), F.struct("created_ms", "snapshot_name"))
    j = in_window(triggers, snapshots).groupBy(*TRIGGER, "_bucket").agg(F.max_by(F.struct(*fields), order).alias("b"))
    state = F.col("b.state")
    return j.select(
        *TRIGGER, F.col("b.snapshot_name").alias("snapshot_name"),
        F.col("b.path").alias("last_savepoint_path"),
        F.col("b.result_ms").alias("result_ms"),
        F.coalesce(state == "COMPLETED", F.lit(False)).alias("completed"),
        F.coalesce(state == "FAILED", F.lit(False)).alias("failed"),
        F.when(state == "FAILED", F.col("b.error")).alias("failure_reason"),
    )


def savepoint_outcome(triggers: DataFrame, snapshots: DataFrame, now_ms: int) -> DataFrame:
    """What polling gives for every distinct trigger up to ``now_ms``: error (with reason), success, pending or timed out.

    A snapshot is seen by the first poll after it is both created and final, unless a newer snapshot exists by then: a completed one
    is final at its result time (and counts only if that is not before the trigger), a failed one carries
    no result time and is final when created. Triggers after ``now_ms`` do not exist yet.
    """
    now, t = F.lit(now_ms).cast("long"), F.col("trigger_ms")
    due = triggers.where(t <= now)
    final = F.when(F.col("state") == "FAILED", F.col("created_ms")).when(
        (F.col("state") == "COMPLETED") & F.col("path").isNotNull() & (F.col("result_ms") >= t), F.greatest("created_ms", "result_ms"))
    newer = F.lead("created_ms").over(Window.partitionBy(*TRIGGER, "_bucket").orderBy("created_ms", "snapshot_name"))
    polls = F.greatest(F.lit(1), F.ceil((final - t) / POLL_INTERVAL_MS))
    looked = in_window(due, snapshots).withColumn("_newer", newer).withColumn("seen_ms", F.when(final.isNotNull(), (t + polls * POLL_INTERVAL_MS).cast("long")))
    seen = (F.col("seen_ms") <= t + DEADLINE_MS) & (F.col("seen_ms") <= now) & (F.col("_newer").isNull() | (F.col("_newer") > F.col("seen_ms")))
    order = F.when(seen, F.struct("seen_ms", "created_ms", "snapshot_name"))
    first = looked.groupBy(*TRIGGER, "_bucket").agg(F.min_by(F.struct("seen_ms", "state", "path", "error"), order).alias("b"))
    state, deadline = F.col("b.state"), t + DEADLINE_MS
    return first.select(
        *TRIGGER,
        F.when(state == "FAILED", "error").when(state == "COMPLETED", "success").when(now < deadline, "pending").otherwise("timed_out").alias("outcome"),
        F.when(state == "FAILED", F.coalesce(F.nullif(F.col("b.error"), F.lit("")), F.lit("unknown error"))).alias("reason"),
        F.when(state == "COMPLETED", F.col("b.path")).alias("savepoint_path"),
        F.col("b.seen_ms").alias("seen_ms"),
        deadline.alias("deadline_ms"),
    )


def savepoint_history(deployments: DataFrame, savepoints: DataFrame) -> DataFrame:
    """Savepoints of each deployment, newest first, with the deployment's total.

    Totals come from a grouped count joined back (not a window over a possibly huge
    deployment); the final ordering is a global range-partitioned sort whose key
    includes (created_at, id), so even one hot deployment spreads over many tasks.
    """
    d = deployments.select(F.col("id").alias("deployment_id"), "deployment_name")
    sp = savepoints.join(d, "deployment_id")
    totals = sp.groupBy("deployment_id").agg(F.count(F.lit(1)).alias("total"))
    return sp.join(totals, "deployment_id").select(
        "deployment_id", "deployment_name", "id", "path", "source", "created_at", "total"
    ).orderBy("deployment_id", F.col("created_at").desc(), F.col("id").desc())


def newest_savepoint(savepoints: DataFrame) -> DataFrame:
    """Per deployment: id of the newest savepoint (created_at, then id)."""
    return savepoints.groupBy("deployment_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("newest_id"))


def resume_source(requests: DataFrame, deployments: DataFrame, savepoints: DataFrame) -> DataFrame:
    """Decide how each resume request starts: stateless, from a chosen older savepoint path,
    or from the latest state; or the error kind that rejects it (checked in the service's order)."""
    d = deployments.select(F.col("id").alias("deployment_id"), "deployment_name", "deployment_mode", "status", "pending_action")
    r = requests.join(d, "deployment_name", "left")
    chosen = savepoints.select(F.col("id").alias("savepoint_id"), "deployment_id", F.col("path").alias("chosen_path"))
    r = r.join(chosen, ["savepoint_id", "deployment_id"], "left").join(newest_savepoint(savepoints), "deployment_id", "left")
    sid, skip = F.col("savepoint_id"), F.coalesce(F.col("skip_savepoint"), F.lit(False))
    decision = (
        F.when(F.col("deployment_id").isNull(), "error:deployment_not_found")
        .when(F.col("deployment_mode") != "application", "error:not_application_mode")
        .when(sid.isNotNull() & skip, "error:both_savepoint_and_skip")
        .when(F.coalesce(F.col("pending_action") != "", F.lit(False)), "error:action_pending")
        .when(~F.coalesce(F.col("status").isin("suspended", "failed", "unknown"), F.lit(False)), "error:not_resumable")
        .when(skip, "stateless")
        .when(sid.isNull(), "latest")
        .when(F.col("chosen_path").isNull(), "error:savepoint_not_found")
        .when(F.col("newest_id") == sid, "latest")
        .otherwise(F.concat(F.lit("path:"), F.col("chosen_path")))
    )
    return r.select("request_id", "deployment_name", "savepoint_id", F.col("skip_savepoint"), decision.alias("decision"))


def savepoint_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert (deployment_id, path) pairs that are absent; an existing row is kept as it is.

    Duplicates within ``incoming`` collapse to their earliest record (then smallest source).
    Returns the table after the upsert with an ``inserted`` flag.
    """
    first = incoming.groupBy("deployment_id", "path").agg(
        F.min_by(F.struct("source", "created_at"), F.struct("created_at", "source")).alias("f"))
    new = first.join(existing.select("deployment_id", "path"), ["deployment_id", "path"], "left_anti").select(
        "deployment_id", "path", F.col("f.source").alias("source"), F.col("f.created_at").alias("created_at"), F.lit(True).alias("inserted"))
    old = existing.select("deployment_id", "path", "source", "created_at", F.lit(False).alias("inserted"))
    return old.unionByName(new)
