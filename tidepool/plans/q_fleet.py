"""Queries of fleet-state reconciliation, listing and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet as FO
from ..sources import cluster, registry
from . import query
from .oracle import register


def _registry(spark, sf):
    return FO.live(registry.deployments(spark, sf))


def _status(spark, sf):
    return FO.cr_status(cluster.custom_resources(spark, sf))


def _reconciled(spark, sf):
    return FO.reconcile(_registry(spark, sf), _status(spark, sf))


# ---------------------------------------------------------------- SQL building blocks (oracle side)

CR_SQL = """cr AS (
  SELECT name, namespace, NULLIF(lifecycle_state, '') AS lifecycle_state, NULLIF(jm_status, '') AS jm_status,
         NULLIF(job_state, '') AS job_state, NULLIF(spec_job_state, '') AS spec_job_state, NULLIF(error, '') AS error,
         NULLIF(upgrade_path, '') AS upgrade_path, n_history
  FROM v_cr)"""

MAPPED_SQL = """CASE
  WHEN lifecycle_state = 'ROLLING_BACK' THEN 'rolling_back'
  WHEN lifecycle_state = 'DELETING' THEN 'deleting'
  WHEN lifecycle_state = 'FAILED' THEN 'failed'
  WHEN deployment_mode = 'session' THEN
    CASE WHEN lifecycle_state IN ('DEPLOYED', 'STABLE') THEN 'running' WHEN lifecycle_state = 'CREATED' THEN 'creating' END
  WHEN job_state = 'RUNNING' THEN 'running'
  WHEN job_state = 'FINISHED' THEN CASE WHEN spec_job_state = 'suspended' THEN 'suspended' ELSE 'succeeded' END
  WHEN job_state = 'FAILED' OR lifecycle_state = 'FAILING' THEN 'failed'
  WHEN error IS NOT NULL THEN
    CASE WHEN (contains(error, 'Job Not Found') OR contains(error, 'Missing'))
              AND (lifecycle_state IS NULL OR lifecycle_state IN ('CREATED', 'DEPLOYED', 'RECONCILING'))
              AND (job_state IS NULL OR job_state NOT IN ('FAILED', 'FAILING'))
         THEN 'creating' ELSE 'failed' END
  WHEN lifecycle_state = 'SUSPENDED' THEN 'suspended'
  WHEN lifecycle_state IN ('CREATED', 'DEPLOYED') THEN 'creating'
END"""


def _strip(m: str) -> str:
    return f"CASE WHEN strpos({m}, ': ') > 1 AND contains(split_part({m}, ': ', 1), '.') THEN substr({m}, strpos({m}, ': ') + 2) ELSE {m} END"


_MSG = "json_extract_string(error, '$.message')"
ERRMSG_SQL = f"""CASE
  WHEN error IS NULL THEN NULL
  WHEN starts_with(error, '{{') AND json_valid(error) AND NULLIF({_MSG}, '') IS NOT NULL THEN {_strip(_MSG)}
  WHEN starts_with(error, '{{') AND json_valid(error) THEN error
  ELSE {_strip('error')}
END"""

RECON_SQL = f"""WITH {CR_SQL},
j AS (
  SELECT d.*, cr.lifecycle_state, cr.jm_status, cr.job_state, cr.spec_job_state, cr.error, cr.upgrade_path, cr.n_history,
         cr.name IS NOT NULL AS has_cr
  FROM v_deployments d LEFT JOIN cr ON cr.name = d.deployment_name AND cr.namespace = d.namespace
  WHERE d.deleted_at IS NULL),
m AS (SELECT *, {MAPPED_SQL} AS mapped, {ERRMSG_SQL} AS new_error FROM j),
a AS (
  SELECT *,
    CASE
      WHEN status = 'deleted' THEN 'unchanged'
      WHEN NOT has_cr AND coalesce(pending_action, '') = '' THEN 'deleted'
      WHEN pending_action = 'delete' THEN CASE WHEN NOT has_cr THEN 'deleted' ELSE 'unchanged' END
      WHEN coalesce(pending_action, '') <> '' THEN
        CASE WHEN (pending_action IN ('stop', 'force_stop') AND mapped = 'suspended')
                  OR (pending_action = 'resume' AND mapped = 'running') OR mapped = 'failed'
             THEN 'resolved' ELSE 'unchanged' END
      WHEN mapped IS NOT NULL AND mapped <> status THEN 'synced'
      ELSE 'unchanged'
    END AS action,
    pending_action = 'stop' AND mapped = 'suspended' AND upgrade_path IS NOT NULL AS capture
  FROM m),
recon AS (
  SELECT id, deployment_name, namespace, deployment_mode, created_at, status AS old_status,
    CASE WHEN action = 'deleted' THEN 'deleted' WHEN action IN ('resolved', 'synced') THEN mapped ELSE status END AS status,
    CASE WHEN action IN ('deleted', 'resolved') THEN NULL ELSE pending_action END AS pending_action,
    CASE WHEN action = 'deleted' THEN NULL WHEN action IN ('resolved', 'synced') THEN new_error ELSE error_message END AS error_message,
    CASE WHEN action = 'resolved' AND capture THEN upgrade_path ELSE last_savepoint_path END AS last_savepoint_path,
    CASE WHEN action = 'resolved' AND capture THEN upgrade_path END AS captured_savepoint,
    action, pending_action AS old_pending_action, error_message AS old_error_message,
    last_savepoint_path AS old_last_savepoint_path
  FROM a)"""

RECON_COLS = (
    "id, deployment_name, namespace, old_status, status, pending_action, error_message, last_savepoint_path, "
    "captured_savepoint, action, old_pending_action, old_error_message, old_last_savepoint_path"
)

# ---------------------------------------------------------------- queries


@query("cr_status")
def cr_status(spark, sf):
    return _status(spark, sf)


register("cr_status", f"WITH {CR_SQL} SELECT * FROM cr")


@query("resolve_status")
def resolve_status(spark, sf):
    j = FO.with_snapshot(_registry(spark, sf), _status(spark, sf)).where("has_cr")
    return j.select("id", "deployment_name", FO.mapped_status(F.col("deployment_mode")).alias("mapped_status"))


register(
    "resolve_status",
    f"""WITH {CR_SQL}
    SELECT d.id, d.deployment_name, {MAPPED_SQL.replace('deployment_mode', 'd.deployment_mode')} AS mapped_status
    FROM v_deployments d JOIN cr ON cr.name = d.deployment_name AND cr.namespace = d.namespace
    WHERE d.deleted_at IS NULL""",
)


@query("error_message")
def error_message(spark, sf):
    from ..functions import fleet as FL

    s = _status(spark, sf)
    return s.select("name", "namespace", "error", FL.error_message(F.col("error")).alias("error_message"))


register("error_message", f"WITH {CR_SQL} SELECT name, namespace, error, {ERRMSG_SQL} AS error_message FROM cr")


@query("reconcile")
def reconcile(spark, sf):
    """Registry LEFT JOIN snapshots -> new status, pending action, error and savepoint path per deployment."""
    return _reconciled(spark, sf).select(*[c.strip() for c in RECON_COLS.split(",")])


register("reconcile", f"{RECON_SQL} SELECT {RECON_COLS} FROM recon")


@query("missing_deployments")
def missing_deployments(spark, sf):
    return FO.missing_deployments(_registry(spark, sf), _status(spark, sf))


register(
    "missing_deployments",
    """SELECT id, deployment_name, namespace, status AS old_status, 'deleted' AS status, CAST(NULL AS VARCHAR) AS error_message
    FROM v_deployments d
    WHERE deleted_at IS NULL AND coalesce(pending_action, '') = '' AND status <> 'deleted'
      AND NOT EXISTS (SELECT 1 FROM v_cr c WHERE c.name = d.deployment_name AND c.namespace = d.namespace)""",
)


@query("stop_savepoint_capture")
def stop_savepoint_capture(spark, sf):
    return FO.stop_savepoint_capture(_reconciled(spark, sf), registry.savepoints(spark, sf))


register(
    "stop_savepoint_capture",
    f"""{RECON_SQL}
    SELECT id AS deployment_id, captured_savepoint AS path, 'stop' AS source FROM recon r
    WHERE captured_savepoint IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM v_savepoints s WHERE s.deployment_id = r.id AND s.path = r.captured_savepoint)""",
)


@query("changed_rows")
def changed_rows(spark, sf):
    return FO.changed_rows(_reconciled(spark, sf)).select(*[c.strip() for c in RECON_COLS.split(",")])


register(
    "changed_rows",
    f"""{RECON_SQL} SELECT {RECON_COLS} FROM recon
    WHERE status IS DISTINCT FROM old_status OR pending_action IS DISTINCT FROM old_pending_action
       OR error_message IS DISTINCT FROM old_error_message OR last_savepoint_path IS DISTINCT FROM old_last_savepoint_path""",
)


@query("allowed_actions")
def allowed_actions(spark, sf):
    """Actions offered for each deployment as it stands after reconciliation."""
    return FO.allowed_actions(_reconciled(spark, sf))


_BLOCK = "(status IN ('deleted', 'deleting') OR coalesce(pending_action, '') <> '')"
_APP = "deployment_mode = 'application'"
register(
    "allowed_actions",
    f"""{RECON_SQL} SELECT id, deployment_name,
      {_APP} AND status = 'running' AND NOT {_BLOCK} AS can_stop,
      {_APP} AND status = 'running' AND NOT {_BLOCK} AS can_force_stop,
      {_APP} AND status = 'suspended' AND NOT {_BLOCK} AS can_resume,
      {_APP} AND status IN ('failed', 'unknown') AND NOT {_BLOCK} AS can_run,
      status IN ('suspended', 'failed') AND NOT {_BLOCK} AS can_edit,
      {_APP} AND status = 'running' AND NOT {_BLOCK} AS can_savepoint,
      status <> 'deleted' AND NOT {_BLOCK} AS can_delete
    FROM recon""",
)


@query("dashboard_available")
def dashboard_available(spark, sf):
    return FO.dashboard_available(_registry(spark, sf), _status(spark, sf))


register(
    "dashboard_available",
    f"""WITH {CR_SQL}
    SELECT d.id, d.deployment_name, coalesce(d.status <> 'deleted' AND d.n_resources > 0 AND cr.jm_status = 'READY', false) AS dashboard_available
    FROM v_deployments d LEFT JOIN cr ON cr.name = d.deployment_name AND cr.namespace = d.namespace
    WHERE d.deleted_at IS NULL""",
)


@query("in_transition")
def in_transition(spark, sf):
    return FO.in_transition(_reconciled(spark, sf))


register(
    "in_transition",
    f"""{RECON_SQL}
    SELECT coalesce(bool_or(f), false) AS any_in_transition, count(*) FILTER (WHERE f) AS n_in_transition
    FROM (SELECT status IN ('creating', 'rolling_back', 'deleting', 'unknown') OR coalesce(pending_action, '') <> '' AS f FROM recon)""",
)


@query("health_tone")
def health_tone(spark, sf):
    return FO.health_tones(_status(spark, sf))


register(
    "health_tone",
    f"""WITH {CR_SQL}
    SELECT name, namespace,
      CASE WHEN lifecycle_state IN ('STABLE', 'DEPLOYED') THEN 'success' WHEN lifecycle_state IN ('CREATED', 'RECONCILING') THEN 'warning'
           WHEN lifecycle_state IN ('FAILED', 'ROLLING_BACK') THEN 'danger' ELSE 'neutral' END AS lifecycle_tone,
      CASE WHEN jm_status = 'READY' THEN 'success' WHEN jm_status = 'DEPLOYING' THEN 'warning'
           WHEN jm_status IN ('ERROR', 'MISSING') THEN 'danger' ELSE 'neutral' END AS job_manager_tone,
      CASE WHEN job_state IN ('RUNNING', 'FINISHED') THEN 'success'
           WHEN job_state IN ('CREATED', 'INITIALIZING', 'RESTARTING', 'RECONCILING') THEN 'warning'
           WHEN job_state IN ('FAILED', 'FAILING', 'CANCELED') THEN 'danger' ELSE 'neutral' END AS job_tone
    FROM cr""",
)

LIST_COLS = ["id", "deployment_name", "namespace", "status", "pending_action", "deployment_mode", "jar_id", "jar_name", "created_at"]


def _listed(spark, sf):
    return FO.list_deployments(registry.deployments(spark, sf), _status(spark, sf), registry.jars(spark, sf))


@query("list_deployments")
def list_deployments(spark, sf):
    """Reconciled deployments with their artifact, newest first."""
    return _listed(spark, sf).select(*LIST_COLS)


LISTED_SQL = f"""{RECON_SQL},
listed AS (SELECT r.*, d.jar_id, j.name AS jar_name FROM recon r JOIN v_deployments d USING (id)
  LEFT JOIN (SELECT * FROM v_jars WHERE deleted_at IS NULL) j ON j.id = d.jar_id)"""
register("list_deployments", f"{LISTED_SQL} SELECT {', '.join(LIST_COLS)} FROM listed ORDER BY created_at DESC, id DESC")


@query("deployment_view")
def deployment_view(spark, sf):
    """Every field of the API shape, nested ones flattened."""
    v = FO.deployment_view(_listed(spark, sf))
    c, k = (lambda f: F.col(f"config.{f}")), (lambda f: F.col(f"kubernetes_status.{f}"))
    conf, env = c("flinkConfiguration"), F.col("environment_variables")
    return v.select(
        "id", "deployment_name", "namespace", "status", "pending_action", "deployment_mode", "created_at", "resource_name", "resource_uid",
        "resource_api_version", "has_savepoint", "jar_id", "jar_name", "job_parallelism", "state_bucket_name", "last_savepoint_path",
        c("namespace").alias("cfg_namespace"), c("image").alias("cfg_image"), c("flinkVersion").alias("cfg_flink_version"), c("serviceAccount").alias("cfg_service_account"),
        c("jobManager.memory").alias("jm_memory"), c("jobManager.cpu").cast("double").alias("jm_cpu"), c("jobManager.replicas").alias("jm_replicas"),
        c("taskManager.memory").alias("tm_memory"), c("taskManager.cpu").cast("double").alias("tm_cpu"), c("taskManager.replicas").alias("tm_replicas"), c("taskManager.taskSlots").alias("tm_slots"),
        conf.getItem("parallelism.default").alias("conf_parallelism"), conf.getItem("state.backend").alias("conf_backend"),
        env.getItem("STAGE").alias("env_stage"), env.getItem("REGION").alias("env_region"), F.size(env).alias("n_env"),
        *[k(x).alias(f"ks_{x}") for x in FO.CLUSTER_FIELDS],
    )


_KS = ", ".join(f"CASE WHEN l.old_status <> 'deleted' THEN cr.{x} END AS ks_{x}" for x in ("lifecycle_state", "jm_status", "job_state", "spec_job_state", "error", "upgrade_path", "n_history"))
register(
    "deployment_view",
    f"""{LISTED_SQL}
    SELECT l.id, l.deployment_name, l.namespace, l.status, l.pending_action, l.deployment_mode, l.created_at,
      CASE WHEN d.n_resources > 0 THEN d.deployment_name END AS resource_name,
      CASE WHEN d.n_resources > 0 THEN d.resource_uid END AS resource_uid,
      CASE WHEN d.n_resources > 0 THEN 'flink.apache.org/v1beta1' END AS resource_api_version,
      l.old_status <> 'deleted' AND (coalesce(cr.n_history > 0, false) OR cr.upgrade_path IS NOT NULL) AS has_savepoint,
      CASE WHEN l.jar_name IS NOT NULL THEN d.jar_id END AS jar_id, l.jar_name, NULLIF(d.job_parallelism, 0) AS job_parallelism,
      CAST(NULL AS VARCHAR) AS state_bucket_name, NULLIF(l.last_savepoint_path, '') AS last_savepoint_path,
      d.namespace AS cfg_namespace, d.cfg_image, d.cfg_flink_version, d.cfg_service_account, d.jm_memory, CAST(d.jm_cpu AS DOUBLE) AS jm_cpu, d.jm_replicas,
      d.tm_memory, CAST(d.tm_cpu AS DOUBLE) AS tm_cpu, d.tm_replicas, d.tm_slots, d.conf_parallelism, d.conf_backend, d.env_stage, d.env_region,
      (d.env_stage IS NOT NULL)::INT + (d.env_region IS NOT NULL)::INT AS n_env, {_KS}
    FROM listed l JOIN v_deployments d USING (id) LEFT JOIN cr ON cr.name = l.deployment_name AND cr.namespace = l.namespace
    ORDER BY l.created_at DESC, l.id DESC""",
)


@query("status_summary")
def status_summary(spark, sf):
    return FO.status_summary(_reconciled(spark, sf))


register(
    "status_summary",
    f"""{RECON_SQL}
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'running') AS running,
      count(*) FILTER (WHERE status = 'suspended') AS stopped, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'deleted') AS deleted FROM recon""",
)


@query("status_tab_counts")
def status_tab_counts(spark, sf):
    return FO.status_tab_counts(_reconciled(spark, sf))


register(
    "status_tab_counts",
    f"""{RECON_SQL}
    SELECT t.tab, CASE WHEN t.tab = 'all' THEN (SELECT count(*) FROM recon)
                       ELSE (SELECT count(*) FROM recon r WHERE r.status = t.tab) END AS count, t.tab_order
    FROM (VALUES (0, 'all'), (1, 'creating'), (2, 'running'), (3, 'suspended'), (4, 'failed'), (5, 'deleting'), (6, 'deleted'))
         AS t(tab_order, tab)""",
)

SEARCH, FILTER = "JOB-12", "running"


@query("search_deployments")
def search_deployments(spark, sf):
    return FO.search_deployments(_reconciled(spark, sf), SEARCH, FILTER).select("id", "deployment_name", "status")


register(
    "search_deployments",
    f"""{RECON_SQL} SELECT id, deployment_name, status FROM recon
    WHERE contains(lower(deployment_name), lower('{SEARCH}')) AND status = '{FILTER}'""",
)

PAGE_SEARCH, PAGE = "job-1", 4


@query("page_deployments")
def page_deployments(spark, sf):
    """Page 4 (15 rows per page, newest first) of the deployments whose name contains 'job-1'."""
    rows = FO.search_deployments(_reconciled(spark, sf), PAGE_SEARCH).select("id", "deployment_name", "status", "created_at")
    # names decide the search, so the registry alone gives the count
    total = FO.search_deployments(_registry(spark, sf), PAGE_SEARCH).count()
    return FO.page_of(rows, [F.col("created_at").desc(), F.col("id").desc()], PAGE, total=total)


register(
    "page_deployments",
    f"""{RECON_SQL},
    f AS (SELECT id, deployment_name, status, created_at,
                 row_number() OVER (ORDER BY created_at DESC, id DESC) AS position
          FROM recon WHERE contains(lower(deployment_name), '{PAGE_SEARCH}')),
    p AS (SELECT least({PAGE}, greatest(1, CAST(ceil(count(*) / 15.0) AS BIGINT))) AS page FROM f)
    SELECT f.*, CAST(ceil(position / 15.0) AS BIGINT) AS page FROM f, p WHERE CAST(ceil(position / 15.0) AS BIGINT) = p.page""",
)
