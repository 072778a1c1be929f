"""Fleet-state reconciliation, listing and summaries over the registry and CR snapshots.

The registry (one row per deployment) is joined once to the custom-resource snapshot
on (name, namespace): a plain equi-join that Catalyst plans as a broadcast hash join
while the snapshot side is small and as a sort-merge join otherwise. All rules are
column expressions evaluated in that single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fleet as FL
from ..sources import schemas as S

STATUS_TABS = ["all", "creating", "running", "suspended", "failed", "deleting", "deleted"]
PAGE_SIZE = 15


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def cr_status(cr: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """Flatten a custom resource to its status fields (and ``keep``); absent or empty values become NULL."""
    blank = lambda c: F.nullif(c, F.lit(""))
    job = F.from_json(F.col("status.jobStatus"), S.JOB_STATUS_DDL, {"mode": "PERMISSIVE"})
    return cr.withColumn("_job", job).select(
        F.col("metadata.name").alias("name"),
        F.col("metadata.namespace").alias("namespace"),
        blank(F.col("status.lifecycleState")).alias("lifecycle_state"),
        blank(F.col("status.jobManagerDeploymentStatus")).alias("jm_status"),
        blank(F.col("_job.state")).alias("job_state"),
        blank(F.col("spec.job.state")).alias("spec_job_state"),
        blank(F.col("status.error")).alias("error"),
        blank(F.col("_job.upgradeSavepointPath")).alias("upgrade_path"),
        F.coalesce(F.size(F.col("_job.savepointInfo.savepointHistory")), F.lit(-1)).alias("n_history"),
        *(keep or []),
    ).withColumn("n_history", F.greatest(F.col("n_history"), F.lit(0)))


def mapped_status(mode: Column) -> Column:
    return FL.resolve_status(F.col("lifecycle_state"), F.col("job_state"), F.col("spec_job_state"), F.col("error"), mode)


def with_snapshot(registry: DataFrame, status: DataFrame) -> DataFrame:
    """registry LEFT JOIN flattened CR status on (name, namespace); ``has_cr`` marks a match."""
    s = status.withColumnRenamed("name", "deployment_name").withColumn("has_cr", F.lit(True))
    return registry.join(s, ["deployment_name", "namespace"], "left").withColumn("has_cr", F.coalesce("has_cr", F.lit(False)))


def _with_rule_inputs(status: DataFrame) -> DataFrame:
    """Evaluate the mapping for both modes and the error text once per snapshot, before the join.

    The post-join rules then reference plain columns, which keeps the generated code of
    the join stage small (no repeated inlining of the rule trees).
    """
    return status.select(
        "*",
        FL.resolve_status(F.col("lifecycle_state"), F.col("job_state"), F.col("spec_job_state"), F.col("error"),
                          F.lit(FL.APPLICATION)).alias("_mapped_app"),
        FL.resolve_status(F.col("lifecycle_state"), F.col("job_state"), F.col("spec_job_state"), F.col("error"),
                          F.lit(FL.SESSION)).alias("_mapped_session"),
        FL.error_message(F.col("error")).alias("_err"),
    )


def reconcile(registry: DataFrame, status: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """New (status, pending_action, error_message, last_savepoint_path) per deployment.

    Rules in order: a deleted row stays as it is; no snapshot and nothing pending ->
    deleted; pending delete resolves once the snapshot is gone; other pending actions
    resolve on (stop|force_stop -> suspended), (resume -> running) or failed, and a
    completed plain stop captures the upgrade savepoint path; otherwise the mapped
    status is written only when it is known and differs (error text alone is not).
    ``keep`` names further columns of the registry and the snapshot to return, those of the
    snapshot NULL for a deleted row, whose snapshot is not looked at.
    """
    j = with_snapshot(registry, _with_rule_inputs(status))
    st, pend = F.col("status"), F.col("pending_action")
    mapped = F.when(F.col("deployment_mode") == FL.SESSION, F.col("_mapped_session")).otherwise(F.col("_mapped_app"))
    j = j.withColumn("_mapped", mapped)
    m = F.col("_mapped")
    has_pending = F.coalesce(pend != "", F.lit(False))
    stop_done = pend.isin("stop", "force_stop") & (m == FL.SUSPENDED)
    resume_done = (pend == "resume") & (m == FL.RUNNING)
    resolved = F.coalesce(stop_done | resume_done | (m == FL.FAILED), F.lit(False))
    capture = F.coalesce(stop_done & (pend == "stop") & F.col("upgrade_path").isNotNull(), F.lit(False))
    changed = F.coalesce(m.isNotNull() & (m != st), F.lit(False))
    action = (
        F.when(st == FL.DELETED, "unchanged")
        .when(~F.col("has_cr") & ~has_pending, "deleted")
        .when(pend == "delete", F.when(~F.col("has_cr"), "deleted").otherwise("unchanged"))
        .when(has_pending, F.when(resolved, "resolved").otherwise("unchanged"))
        .when(changed, "synced")
        .otherwise("unchanged")
    )
    j = j.withColumn("action", action).withColumn("_capture", capture)
    a = F.col("action")
    captured = (a == "resolved") & F.col("_capture")
    return j.select(
        "id",
        "deployment_name",
        "namespace",
        "deployment_mode",
        "created_at",
        st.alias("old_status"),
        F.when(a == "deleted", F.lit(FL.DELETED)).when(a.isin("resolved", "synced"), m).otherwise(st).alias("status"),
        F.when(a.isin("deleted", "resolved"), F.lit(None).cast("string")).otherwise(pend).alias("pending_action"),
        F.when(a == "deleted", F.lit(None).cast("string"))
        .when(a.isin("resolved", "synced"), F.col("_err"))
        .otherwise(F.col("error_message"))
        .alias("error_message"),
        F.when(captured, F.col("upgrade_path")).otherwise(F.col("last_savepoint_path")).alias("last_savepoint_path"),
        F.when(captured, F.col("upgrade_path")).alias("captured_savepoint"),
        a.alias("action"),
        pend.alias("old_pending_action"),
        F.col("error_message").alias("old_error_message"),
        F.col("last_savepoint_path").alias("old_last_savepoint_path"),
        *[F.when(st != FL.DELETED, F.col(c)).alias(c) if c in status.columns else F.col(c) for c in keep or []],
    )


def missing_deployments(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Deployments with no snapshot, nothing pending and not yet deleted -> become deleted."""
    s = status.select(F.col("name").alias("deployment_name"), "namespace")
    cand = registry.where(F.col("pending_action").isNull() | (F.col("pending_action") == ""))
    cand = cand.where(F.col("status") != FL.DELETED)
    gone = cand.join(s, ["deployment_name", "namespace"], "left_anti")
    return gone.select("id", "deployment_name", "namespace", F.col("status").alias("old_status"),
                       F.lit(FL.DELETED).alias("status"), F.lit(None).cast("string").alias("error_message"))


def changed_rows(reconciled: DataFrame) -> DataFrame:
    """Rows to write back: any persisted field differs from the stored row (NULL-safe)."""
    diff = (
        ~F.col("status").eqNullSafe(F.col("old_status"))
        | ~F.col("pending_action").eqNullSafe(F.col("old_pending_action"))
        | ~F.col("error_message").eqNullSafe(F.col("old_error_message"))
        | ~F.col("last_savepoint_path").eqNullSafe(F.col("old_last_savepoint_path"))
    )
    return reconciled.where(diff)


def stop_savepoint_capture(reconciled: DataFrame, savepoints: DataFrame) -> DataFrame:
    """Savepoint rows to insert for completed graceful stops, unless (deployment, path) exists."""
    new = reconciled.where(F.col("captured_savepoint").isNotNull()).select(
        F.col("id").alias("deployment_id"), F.col("captured_savepoint").alias("path"), F.lit("stop").alias("source"))
    return new.join(savepoints.select("deployment_id", "path"), ["deployment_id", "path"], "left_anti")


def allowed_actions(df: DataFrame) -> DataFrame:
    """Per row, which actions are offered. Everything is off while an action is pending or the row is deleted/deleting."""
    st = F.col("status")
    app = F.coalesce(F.col("deployment_mode") == FL.APPLICATION, F.lit(False))
    blocked = F.coalesce(st.isin(FL.DELETED, FL.DELETING), F.lit(False)) | F.coalesce(F.col("pending_action") != "", F.lit(False))
    ok = lambda c: F.coalesce(c, F.lit(False)) & ~blocked
    return df.select(
        "id",
        "deployment_name",
        ok(app & (st == FL.RUNNING)).alias("can_stop"),
        ok(app & (st == FL.RUNNING)).alias("can_force_stop"),
        ok(app & (st == FL.SUSPENDED)).alias("can_resume"),
        ok(app & st.isin(FL.FAILED, FL.UNKNOWN)).alias("can_run"),
        ok(st.isin(FL.SUSPENDED, FL.FAILED)).alias("can_edit"),
        ok(app & (st == FL.RUNNING)).alias("can_savepoint"),
        ok(st != FL.DELETED).alias("can_delete"),
    )


def dashboard_available(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Whether the dashboard can be opened; a deleted row's snapshot is not looked at."""
    j = with_snapshot(registry, status)
    alive = F.coalesce(F.col("status") != FL.DELETED, F.lit(True))
    return j.select("id", "deployment_name", (alive & FL.dashboard_available(F.size("resources"), F.col("jm_status"))).alias("dashboard_available"))


def in_transition(df: DataFrame) -> DataFrame:
    """Table-level: is any row in transition (and how many)."""
    flag = FL.in_transition(F.col("status"), F.col("pending_action"))
    return df.agg(
        F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_in_transition"),
        F.count_if(flag).alias("n_in_transition"),
    )


def health_tones(status: DataFrame) -> DataFrame:
    return status.select(
        "name",
        "namespace",
        FL.tone(F.col("lifecycle_state"), FL.LIFECYCLE_TONES).alias("lifecycle_tone"),
        FL.tone(F.col("jm_status"), FL.JOB_MANAGER_TONES).alias("job_manager_tone"),
        FL.tone(F.col("job_state"), FL.JOB_TONES).alias("job_tone"),
    )


CLUSTER_FIELDS = ["lifecycle_state", "jm_status", "job_state", "spec_job_state", "error", "upgrade_path", "n_history"]


def list_deployments(registry: DataFrame, status: DataFrame, jars: DataFrame, name: str | None = None) -> DataFrame:
    """Live rows, each reconciled with its snapshot first, with their (live) artifact, newest first; optionally one name."""
    d = live(registry)
    if name is not None:
        d = d.where(F.col("deployment_name") == name)
    own = ["config", "resources", "jar_id", "environment_variables", "job_parallelism", "state_bucket_name"]
    r = reconcile(d, status, keep=[*own, *CLUSTER_FIELDS])
    j = live(jars).select(F.col("id").alias("jar_id"), F.col("name").alias("jar_name"))
    return r.join(j, "jar_id", "left").orderBy(F.col("created_at").desc(), F.col("id").desc())


def deployment_view(listed: DataFrame) -> DataFrame:
    """API shape of a listed deployment, newest first; optional fields are NULL when empty."""
    res0 = F.get(F.col("resources"), 0)
    truthy = lambda c: F.when(F.coalesce(c != "", F.lit(False)), c)
    known = F.lit(False)
    for c in CLUSTER_FIELDS:
        known = known | F.col(c).isNotNull()
    return listed.select(
        "id", "deployment_name", "namespace", "status", "pending_action", "deployment_mode", "config", "created_at",
        F.when(known, F.struct(*CLUSTER_FIELDS)).alias("kubernetes_status"),
        res0.getField("name").alias("resource_name"),
        res0.getField("uid").alias("resource_uid"),
        res0.getField("apiVersion").alias("resource_api_version"),
        (F.coalesce(F.col("n_history") > 0, F.lit(False)) | F.col("upgrade_path").isNotNull()).alias("has_savepoint"),
        F.when(F.col("jar_name").isNotNull(), F.col("jar_id")).alias("jar_id"),
        "jar_name",
        "environment_variables",
        F.when(F.col("job_parallelism") != 0, F.col("job_parallelism")).alias("job_parallelism"),
        truthy(F.col("state_bucket_name")).alias("state_bucket_name"),
        truthy(F.col("last_savepoint_path")).alias("last_savepoint_path"),
    ).orderBy(F.col("created_at").desc(), F.col("id").desc())


def status_summary(df: DataFrame) -> DataFrame:
    st = F.col("status")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == FL.RUNNING).alias("running"),
        F.count_if(st == FL.SUSPENDED).alias("stopped"),
        F.count_if(st == FL.FAILED).alias("failed"),
        F.count_if(st == FL.DELETED).alias("deleted"),
    )


def status_tab_counts(df: DataFrame) -> DataFrame:
    """Count per dashboard tab; tabs with no rows show 0, 'all' counts every row. One pass: the total is the rollup's last row."""
    spark = df.sparkSession
    tabs = spark.createDataFrame([(i, t) for i, t in enumerate(STATUS_TABS)], "tab_order int, tab string")
    counts = df.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g"))
    counts = counts.select(F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("tab"), "n", "g")
    counts = counts.where((F.col("g") == 1) | (F.col("tab") != "all"))
    return tabs.join(counts, "tab", "left").select("tab", F.coalesce("n", F.lit(0)).alias("count"), "tab_order")


def search_deployments(df: DataFrame, search: str, status_filter: str = "all") -> DataFrame:
    cond = F.lower(F.col("deployment_name")).contains(F.lit(search.lower()))
    if status_filter != "all":
        cond = cond & (F.col("status") == F.lit(status_filter))
    return df.where(cond)


def page_of(df: DataFrame, order: list[Column], page: int, per_page: int = PAGE_SIZE, total: int | None = None) -> DataFrame:
    """One page with its rows' 1-based positions; the requested page is clamped to [1, max(1, ceil(n / per_page))].

    ``total`` spares counting ``df``. The sort keeps only the rows up to the page's end in each task.
    """
    n = df.count() if total is None else total
    p = min(max(page, 1), max(1, -(-n // per_page)))
    skip = (p - 1) * per_page
    rows = df.orderBy(*order).offset(skip).limit(per_page)
    at = F.row_number().over(Window.orderBy(*order))  # over one page's rows
    return rows.withColumn("position", (at + skip).cast("long")).withColumn("page", F.lit(p).cast("long"))
