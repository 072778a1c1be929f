"""Queries of diagnostics (D1-D8) and savepoint snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as AN
from ..operators import diagnostics as D
from ..operators import fleet as FO
from ..operators import savepoints as SP
from ..session import scratch_path
from ..sources import cluster, registry
from ..sources.views import view
from . import query
from .oracle import register
from .q_fleet import CR_SQL


def _registry(spark, sf):
    return FO.live(registry.deployments(spark, sf))


# ---------------------------------------------------------------- D1-D8

@query("conditions")
def conditions(spark, sf):
    return D.conditions(cluster.custom_resources(spark, sf))


register(
    "conditions",
    """SELECT name, namespace, CASE WHEN k = 0 THEN 'Ready' ELSE 'Progressing' END AS type,
      CASE WHEN jm_status = 'READY' THEN 'True' ELSE 'False' END AS status,
      CASE WHEN k = 0 THEN 'JobManagerReady' ELSE 'Reconciling' END AS reason,
      'condition ' || CAST(k AS VARCHAR) || ' of ' || name AS message, cond_time AS last_transition_time
    FROM (SELECT *, unnest(range(n_conditions)) AS k FROM v_cr)""",
)

POD_COLS = ["pod_name", "app", "namespace", "phase", "node", "reason", "start_time", "restart_count", "n_containers"]


@query("pod_health")
def pod_health(spark, sf):
    return D.pod_health(cluster.pods(spark, sf)).select(*POD_COLS)


register(
    "pod_health",
    """SELECT pod_name, app, namespace, phase, node, reason, start_time,
      CASE WHEN no_containers THEN 0 ELSE coalesce(c1_restarts, 0) + coalesce(c2_restarts, 0) END AS restart_count,
      CASE WHEN no_containers THEN 0 ELSE 2 END AS n_containers
    FROM v_pods""",
)


@query("container_state")
def container_state(spark, sf):
    return D.container_state(cluster.pods(spark, sf))


register(
    "container_state",
    """SELECT pod_name, CASE WHEN no_containers OR c1_state IS NULL THEN 'Unknown'
      WHEN json_extract(c1_state, '$.running') IS NOT NULL THEN 'Running'
      WHEN json_extract(c1_state, '$.waiting') IS NOT NULL THEN 'Waiting'
      WHEN json_extract(c1_state, '$.terminated') IS NOT NULL THEN 'Terminated' ELSE 'Unknown' END AS container_state
    FROM v_pods""",
)


@query("related_events")
def related_events(spark, sf):
    """Events whose object name or message contains a deployment's name (substring), same namespace."""
    return D.related_events(_registry(spark, sf), cluster.k8s_events(spark, sf))


RELATED_SQL = """related AS (
  SELECT DISTINCT d.id, e.event_id AS uid FROM v_deployments d
  JOIN v_k8s_events e ON e.namespace = d.namespace
   AND (coalesce(contains(NULLIF(e.object_name, ''), d.deployment_name), false)
        OR coalesce(contains(NULLIF(e.message, ''), d.deployment_name), false))
  WHERE d.deleted_at IS NULL
    AND NOT (coalesce(e.reason = 'Unhealthy', false) AND coalesce(contains(e.message, 'Startup probe failed'), false)))"""
register("related_events", f"WITH {RELATED_SQL} SELECT id, uid FROM related")

EVENT_VIEW_SQL = """ev AS (
  SELECT event_id AS uid, NULLIF(reason, '') AS reason, NULLIF(message, '') AS message, NULLIF(type, '') AS type,
    NULLIF(object_kind, '') AS object_kind, NULLIF(object_name, '') AS object_name, namespace,
    coalesce(NULLIF(first_ts, ''), NULLIF(event_time, '')) AS first_seen,
    coalesce(NULLIF(last_ts, ''), NULLIF(event_time, '')) AS last_seen,
    coalesce(NULLIF(count, 0), 1) AS count
  FROM v_k8s_events)"""


@query("event_view")
def event_view(spark, sf):
    return D.event_view(cluster.k8s_events(spark, sf))


register("event_view", f"WITH {EVENT_VIEW_SQL} SELECT * FROM ev")


@query("recent_events")
def recent_events(spark, sf):
    reg = _registry(spark, sf)
    ev = cluster.k8s_events(spark, sf)
    return D.recent_events(D.related_events(reg, ev), ev).select("id", "uid", "seen_ms", "rank")


register(
    "recent_events",
    f"""WITH {RELATED_SQL}, {EVENT_VIEW_SQL},
    r AS (SELECT related.id, ev.uid, epoch_ms(try_strptime(coalesce(last_seen, first_seen), '%Y-%m-%dT%H:%M:%SZ')) AS seen_ms
          FROM related JOIN ev USING (uid)),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_ms DESC NULLS LAST, uid DESC) AS rank FROM r)
    SELECT id, uid, seen_ms, rank FROM k WHERE rank <= 8""",
)

# The rules once more, written out on the oracle's side.
_RULES = [
    (["ImagePullBackOff", "ErrImagePull"], "high", "Image pull failed",
     "Kubernetes could not pull the Flink image. Verify the image name or run the image loading script for your local cluster."),
    (["CrashLoopBackOff"], "high", "Container is crashing repeatedly", "Check the JobManager logs. The application may be failing during startup."),
    (["OOMKilled"], "high", "Container ran out of memory", "Increase JobManager or TaskManager memory in the deployment configuration."),
    (["FailedScheduling"], "medium", "Pod scheduling failed", "The Kubernetes cluster may not have enough CPU or memory available."),
]
_FIRED = " UNION ALL ".join(
    f"SELECT DISTINCT id, {i} AS rule_order, '{sev}' AS severity, '{reason}' AS reason, '{msg}' AS message FROM texts WHERE "
    + " OR ".join(f"contains(t, '{m}')" for m in markers)
    for i, (markers, sev, reason, msg) in enumerate(_RULES)
)
RECS_SQL = f"""{CR_SQL}, {RELATED_SQL}, {EVENT_VIEW_SQL},
live AS (SELECT id, deployment_name, namespace FROM v_deployments WHERE deleted_at IS NULL),
st AS (SELECT live.id, concat_ws('|', cr.lifecycle_state, cr.jm_status, cr.job_state, cr.upgrade_path, v.job_note, cr.error) AS t
       FROM live JOIN cr ON cr.name = live.deployment_name AND cr.namespace = live.namespace
       JOIN v_cr v ON v.name = cr.name AND v.namespace = cr.namespace),
pt AS (SELECT live.id, concat_ws('|', pod_name, phase, node, reason, start_time,
              CASE WHEN NOT no_containers THEN concat_ws('|', c1_state, c1_last_state, c2_state, c2_last_state) END) AS t
       FROM live JOIN v_pods p ON p.app = live.deployment_name AND p.namespace = live.namespace),
et AS (SELECT related.id, concat_ws('|', reason, message, type, object_kind, object_name, first_seen, last_seen) AS t
       FROM related JOIN ev USING (uid)),
texts AS (SELECT * FROM (SELECT * FROM st UNION ALL SELECT * FROM pt UNION ALL SELECT * FROM et) WHERE id IN (SELECT id FROM st)),
recs AS ({_FIRED})"""


def _sections(spark, sf, build=D.sections):
    return build(_registry(spark, sf), cluster.custom_resources(spark, sf), cluster.pods(spark, sf), cluster.k8s_events(spark, sf))


@query("recommendations")
def recommendations(spark, sf):
    return D.recommendations(_sections(spark, sf, D.marked_sections)).select("id", "rule_order", "severity", "reason", "message")


register("recommendations", f"WITH {RECS_SQL} SELECT id, rule_order, severity, reason, message FROM recs")


@query("diagnostics_report")
def diagnostics_report(spark, sf):
    """Per deployment: status, conditions, pods, containers, related events and recommendations, a row each."""
    path = scratch_path(spark, "sections")
    _sections(spark, sf).write.parquet(path)
    return D.diagnostics_report(spark.read.parquet(path))


register(
    "diagnostics_report",
    f"""WITH {RECS_SQL}, w AS (SELECT * FROM v_cr)
    SELECT live.id, 'status' AS section, CASE WHEN cr.name IS NOT NULL THEN 0 END AS position,
      CASE WHEN cr.name IS NULL THEN 'DELETED' ELSE cr.lifecycle_state END AS name, cr.jm_status AS kind, cr.job_state AS state,
      cr.upgrade_path AS reason, cr.error AS message, CAST(NULL AS VARCHAR) AS at, CAST(cr.n_history AS BIGINT) AS n
    FROM live LEFT JOIN cr ON cr.name = live.deployment_name AND cr.namespace = live.namespace
    UNION ALL
    SELECT live.id, 'condition', k, NULL, CASE WHEN k = 0 THEN 'Ready' ELSE 'Progressing' END, CASE WHEN jm_status = 'READY' THEN 'True' ELSE 'False' END,
      CASE WHEN k = 0 THEN 'JobManagerReady' ELSE 'Reconciling' END, 'condition ' || CAST(k AS VARCHAR) || ' of ' || c.name, cond_time, NULL
    FROM live JOIN (SELECT *, unnest(range(n_conditions)) AS k FROM w) c ON c.name = live.deployment_name AND c.namespace = live.namespace
    UNION ALL
    SELECT live.id, 'pod', NULL, pod_name, node, phase, reason, NULL, start_time,
      CASE WHEN no_containers THEN 0 ELSE coalesce(c1_restarts, 0) + coalesce(c2_restarts, 0) END
    FROM live JOIN v_pods p ON p.app = live.deployment_name AND p.namespace = live.namespace
    UNION ALL
    SELECT live.id, 'container', 0, pod_name || '/' || c1_name, NULL, c1_state, c1_last_state, CAST(c1_ready AS VARCHAR), NULL, coalesce(c1_restarts, 0)
    FROM live JOIN v_pods p ON p.app = live.deployment_name AND p.namespace = live.namespace WHERE NOT no_containers
    UNION ALL
    SELECT live.id, 'container', 1, pod_name || '/' || c2_name, NULL, c2_state, c2_last_state, CAST(c2_ready AS VARCHAR), NULL, coalesce(c2_restarts, 0)
    FROM live JOIN v_pods p ON p.app = live.deployment_name AND p.namespace = live.namespace WHERE NOT no_containers
    UNION ALL
    SELECT related.id, 'event', uid, object_name, object_kind, type, reason, message, coalesce(last_seen, first_seen), count FROM related JOIN ev USING (uid)
    UNION ALL
    SELECT id, 'recommendation', rule_order, NULL, NULL, severity, reason, message, NULL, NULL FROM recs""",
)

# ---------------------------------------------------------------- E1-E5


def _triggers(spark, sf):
    """A trigger is named by deployment, namespace and time; the operators take requests of the same millisecond as one."""
    return view(spark, sf, "v_triggers")


@query("snapshot_candidate")
def snapshot_candidate(spark, sf):
    """Per savepoint trigger: the newest manual savepoint snapshot created from one second before it to its deadline."""
    return SP.snapshot_candidate(_triggers(spark, sf), cluster.state_snapshots(spark, sf))


SNAP_SQL = """t AS (SELECT DISTINCT * FROM v_triggers),
s AS (SELECT job_name AS deployment_name, namespace, epoch_ms(try_strptime(created, '%Y-%m-%dT%H:%M:%SZ')) AS created_ms, name AS snapshot_name,
         state, NULLIF(path, '') AS path, epoch_ms(try_strptime(NULLIF(result_ts, ''), '%Y-%m-%dT%H:%M:%SZ')) AS result_ms, error
       FROM v_snapshots WHERE trigger_type = 'MANUAL' AND snap_type = 'SAVEPOINT')"""
register(
    "snapshot_candidate",
    f"""WITH {SNAP_SQL},
    c AS (SELECT t.*, s.created_ms, s.snapshot_name, s.state, s.path, s.result_ms, s.error,
            row_number() OVER (PARTITION BY t.deployment_name, t.namespace, t.trigger_ms ORDER BY s.created_ms DESC, s.snapshot_name DESC) AS rn
          FROM t JOIN s ON s.deployment_name = t.deployment_name AND s.namespace = t.namespace
           AND s.created_ms BETWEEN t.trigger_ms - 1000 AND t.trigger_ms + 120000)
    SELECT t.*, c.snapshot_name, c.path AS last_savepoint_path, c.result_ms, coalesce(c.state = 'COMPLETED', false) AS completed,
      coalesce(c.state = 'FAILED', false) AS failed, CASE WHEN c.state = 'FAILED' THEN c.error END AS failure_reason
    FROM t LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (deployment_name, namespace, trigger_ms)""",
)


@query("savepoint_outcome")
def savepoint_outcome(spark, sf):
    """Outcome of every trigger when the clock stands thirty seconds after the last one."""
    t = _triggers(spark, sf)
    now = t.agg(F.max("trigger_ms")).first()[0]
    return SP.savepoint_outcome(t, cluster.state_snapshots(spark, sf), (now or 0) + 30_000)


# Follows the service poll by poll: 24 looks, five seconds apart, each at the newest snapshot that exists by then.
register(
    "savepoint_outcome",
    f"""WITH {SNAP_SQL},
    clock AS (SELECT max(trigger_ms) + 30000 AS now_ms FROM t),
    p AS (SELECT t.*, t.trigger_ms + 5000 * k AS poll_ms FROM t, (SELECT unnest(range(1, 25)) AS k), clock WHERE t.trigger_ms + 5000 * k <= now_ms),
    looks AS (SELECT p.*, s.state, s.path, s.result_ms, s.error,
        row_number() OVER (PARTITION BY p.deployment_name, p.namespace, p.trigger_ms, p.poll_ms ORDER BY s.created_ms DESC, s.snapshot_name DESC) AS rn
      FROM p JOIN s ON s.deployment_name = p.deployment_name AND s.namespace = p.namespace
        AND s.created_ms >= p.trigger_ms - 1000 AND s.created_ms <= p.poll_ms),
    ends AS (SELECT *, row_number() OVER (PARTITION BY deployment_name, namespace, trigger_ms ORDER BY poll_ms) AS nth FROM looks
      WHERE rn = 1 AND (state = 'FAILED' OR (state = 'COMPLETED' AND path IS NOT NULL AND result_ms <= poll_ms AND result_ms >= trigger_ms)))
    SELECT t.*,
      CASE WHEN e.state = 'FAILED' THEN 'error' WHEN e.state = 'COMPLETED' THEN 'success'
           WHEN now_ms < t.trigger_ms + 120000 THEN 'pending' ELSE 'timed_out' END AS outcome,
      CASE WHEN e.state = 'FAILED' THEN coalesce(NULLIF(e.error, ''), 'unknown error') END AS reason,
      CASE WHEN e.state = 'COMPLETED' THEN e.path END AS savepoint_path, e.poll_ms AS seen_ms, t.trigger_ms + 120000 AS deadline_ms
    FROM t CROSS JOIN clock LEFT JOIN (SELECT * FROM ends WHERE nth = 1) e USING (deployment_name, namespace, trigger_ms)""",
)


@query("savepoint_history")
def savepoint_history(spark, sf):
    return SP.savepoint_history(_registry(spark, sf), registry.savepoints(spark, sf))


register(
    "savepoint_history",
    """SELECT s.deployment_id, d.deployment_name, s.id, s.path, s.source, s.created_at,
      count(*) OVER (PARTITION BY s.deployment_id) AS total
    FROM v_savepoints s JOIN v_deployments d ON d.id = s.deployment_id WHERE d.deleted_at IS NULL""",
)


@query("resume_source")
def resume_source(spark, sf):
    """Per resume request: stateless, path:<older savepoint>, latest, or the rejecting error kind."""
    return SP.resume_source(view(spark, sf, "v_resume_requests"), _registry(spark, sf), registry.savepoints(spark, sf))


register(
    "resume_source",
    """WITH d AS (SELECT * FROM v_deployments WHERE deleted_at IS NULL),
    newest AS (SELECT deployment_id, id AS newest_id FROM (
      SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY created_at DESC, id DESC) AS rn FROM v_savepoints) WHERE rn = 1)
    SELECT r.request_id, r.deployment_name, r.savepoint_id, r.skip_savepoint,
      CASE WHEN d.id IS NULL THEN 'error:deployment_not_found'
           WHEN d.deployment_mode <> 'application' THEN 'error:not_application_mode'
           WHEN r.savepoint_id IS NOT NULL AND r.skip_savepoint THEN 'error:both_savepoint_and_skip'
           WHEN coalesce(d.pending_action, '') <> '' THEN 'error:action_pending'
           WHEN d.status NOT IN ('suspended', 'failed', 'unknown') THEN 'error:not_resumable'
           WHEN r.skip_savepoint THEN 'stateless'
           WHEN r.savepoint_id IS NULL THEN 'latest'
           WHEN s.path IS NULL THEN 'error:savepoint_not_found'
           WHEN n.newest_id = r.savepoint_id THEN 'latest'
           ELSE 'path:' || s.path END AS decision
    FROM v_resume_requests r
    LEFT JOIN d ON d.deployment_name = r.deployment_name
    LEFT JOIN v_savepoints s ON s.id = r.savepoint_id AND s.deployment_id = d.id
    LEFT JOIN newest n ON n.deployment_id = d.id""",
)

@query("action_requests")
def action_requests(spark, sf):
    """Requests and observations of every deployment folded in order: accepted or rejected with the reason, the state after, savepoints left."""
    return AN.fold_actions(view(spark, sf, "v_actions"), _registry(spark, sf), registry.savepoints(spark, sf))


#: The fold once more, event by event: (status, pending action) go from one event to the next.
_BUSY = "'conflict: operation in progress'"
register(
    "action_requests",
    f"""WITH RECURSIVE d AS (SELECT * FROM v_deployments WHERE deleted_at IS NULL),
    newest AS (SELECT deployment_id, arg_max(id, (created_at, id)) AS newest_id FROM v_savepoints GROUP BY deployment_id),
    e AS (SELECT a.*, d.id AS deployment_id, d.deployment_mode, s.path AS chosen_path, n.newest_id, row_number() OVER (PARTITION BY a.deployment_name ORDER BY at_ms, event_id) AS nth
      FROM v_actions a LEFT JOIN d USING (deployment_name) LEFT JOIN v_savepoints s ON s.id = a.savepoint_id AND s.deployment_id = d.id LEFT JOIN newest n ON n.deployment_id = d.id),
    f AS (
      SELECT id AS deployment_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, status, coalesce(pending_action, '') AS pending, CAST(NULL AS VARCHAR) AS source, false AS left_one, false AS left_before FROM d
      UNION ALL
      SELECT deployment_id, nth, event_id, outcome,
        CASE outcome WHEN 'resolved' THEN seen WHEN 'synced' THEN seen ELSE status END,
        CASE WHEN outcome IN ('resolved', 'synced') THEN '' WHEN outcome = 'accepted' AND kind IN ('stop', 'force_stop', 'resume', 'delete') THEN kind ELSE pending END,
        source, left_one OR source IS NOT NULL, left_one
      FROM (SELECT *, CASE WHEN path IS NULL THEN NULL WHEN kind = 'snapshot' THEN 'manual' WHEN outcome = 'resolved' AND pending = 'stop' AND seen = 'suspended' THEN 'stop' END AS source FROM (
        SELECT f.deployment_id, e.nth, e.event_id, e.kind, e.path, f.status, f.pending, f.left_one, CASE WHEN e.kind = 'gone' THEN 'deleted' WHEN starts_with(e.kind, 'saw:') THEN substr(e.kind, 5) END AS seen,
          CASE
            WHEN e.kind IN ('stop', 'force_stop', 'savepoint', 'resume') AND e.deployment_mode <> 'application' THEN 'invalid: not application mode'
            WHEN e.kind = 'resume' AND e.savepoint_id IS NOT NULL AND e.skip_savepoint THEN 'invalid: both savepoint and skip'
            WHEN e.kind IN ('stop', 'force_stop') THEN CASE WHEN f.pending <> '' THEN {_BUSY} WHEN f.status <> 'running' THEN 'conflict: not running' ELSE 'accepted' END
            WHEN e.kind = 'savepoint' THEN CASE WHEN f.status = 'running' THEN 'accepted' ELSE 'invalid: not running' END
            WHEN e.kind = 'resume' THEN CASE WHEN f.pending <> '' THEN {_BUSY} WHEN f.status NOT IN ('suspended', 'failed', 'unknown') THEN 'conflict: not resumable'
              WHEN e.savepoint_id IS NOT NULL AND e.chosen_path IS NULL THEN 'not found: savepoint' ELSE 'accepted' END
            WHEN e.kind = 'delete' THEN CASE WHEN f.status = 'deleted' THEN 'conflict: already deleted' WHEN f.pending <> '' THEN {_BUSY} ELSE 'accepted' END
            WHEN e.kind = 'edit' THEN CASE WHEN f.status NOT IN ('suspended', 'failed') THEN 'conflict: not editable' WHEN f.pending <> '' THEN {_BUSY} ELSE 'accepted' END
            WHEN e.kind = 'snapshot' OR f.status = 'deleted' THEN 'unchanged'
            WHEN e.kind = 'gone' THEN CASE f.pending WHEN 'delete' THEN 'resolved' WHEN '' THEN 'synced' ELSE 'unchanged' END
            WHEN f.pending = '' THEN CASE WHEN substr(e.kind, 5) <> f.status THEN 'synced' ELSE 'unchanged' END
            WHEN f.pending <> 'delete' AND (e.kind = 'saw:failed' OR e.kind = CASE f.pending WHEN 'resume' THEN 'saw:running' ELSE 'saw:suspended' END) THEN 'resolved'
            ELSE 'unchanged' END AS outcome
        FROM f JOIN e ON e.deployment_id = f.deployment_id AND e.nth = f.nth + 1)))
    SELECT e.event_id, e.deployment_name, e.kind, coalesce(f.outcome, 'not found: deployment') AS outcome,
      CASE WHEN e.kind = 'resume' AND f.outcome = 'accepted' THEN CASE WHEN e.skip_savepoint THEN 'stateless'
        WHEN e.savepoint_id IS NOT NULL AND (f.left_before OR e.newest_id <> e.savepoint_id) THEN 'path:' || e.chosen_path ELSE 'latest' END END AS start_from,
      f.status, NULLIF(f.pending, '') AS pending_action, CASE WHEN f.source IS NOT NULL THEN e.path END AS savepoint_path, f.source
    FROM e LEFT JOIN f USING (event_id)""",
)

UPSERT_CUTOFF = "1996-01-01 00:00:00"


@query("savepoint_upsert")
def savepoint_upsert(spark, sf):
    """Savepoints recorded before 1996 form the table; every line-item savepoint record is upserted into it."""
    existing = registry.savepoints(spark, sf).where(F.col("created_at") < F.lit(UPSERT_CUTOFF).cast("timestamp_ntz"))
    return SP.savepoint_upsert(existing, view(spark, sf, "v_savepoint_rows"))


register(
    "savepoint_upsert",
    f"""WITH e AS (SELECT deployment_id, path, source, created_at FROM v_savepoints WHERE created_at < TIMESTAMP '{UPSERT_CUTOFF}'),
    i AS (SELECT deployment_id, path, source, created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY deployment_id, path ORDER BY created_at, source) AS rn FROM v_savepoint_rows) WHERE rn = 1)
    SELECT deployment_id, path, source, created_at, false AS inserted FROM e
    UNION ALL
    SELECT deployment_id, path, source, created_at, true AS inserted FROM i
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.deployment_id = i.deployment_id AND e.path = i.path)""",
)
