"""Queries of the artifact catalog (F1-F7), configuration rules (G1-G8) and access limits (H1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as AC
from ..operators import catalog as CA
from ..operators import config_rules as CR
from ..operators import fleet as FO
from ..sources import registry
from ..sources.views import view
from . import query
from .oracle import register

# Artifact store address (deployment settings).
HOST, PORT, BUCKET = "minio.default.svc.cluster.local", "9000", "flink-jars"
SEARCH = "RING"


def _jars(spark, sf):
    return registry.jars(spark, sf)


@query("list_artifacts")
def list_artifacts(spark, sf):
    return CA.list_artifacts(_jars(spark, sf), HOST, PORT, BUCKET).select("id", "name", "object_name", "size_bytes", "created_at", "url")


register(
    "list_artifacts",
    f"""SELECT id, name, object_name, size_bytes, created_at, 'http://{HOST}:{PORT}/{BUCKET}/' || object_name AS url
    FROM v_jars WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC""",
)


@query("search_artifacts")
def search_artifacts(spark, sf):
    return CA.search_artifacts(CA.live_rows(_jars(spark, sf)), SEARCH).select("id", "name")


register("search_artifacts", f"SELECT id, name FROM v_jars WHERE deleted_at IS NULL AND contains(lower(name), lower('{SEARCH}'))")


@query("artifact_totals")
def artifact_totals(spark, sf):
    return CA.artifact_totals(CA.live_rows(_jars(spark, sf)))


register("artifact_totals", "SELECT count(*) AS n_artifacts, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM v_jars WHERE deleted_at IS NULL")


@query("human_size")
def human_size(spark, sf):
    return CA.human_sizes(_jars(spark, sf))


# Independent statement: pick the unit by thresholds, round the exact quotient half-up to one decimal.
register(
    "human_size",
    """WITH u AS (SELECT id, size_bytes,
        CASE WHEN size_bytes < 1024 THEN 0 WHEN size_bytes < 1048576 THEN 1 WHEN size_bytes < 1073741824 THEN 2
          WHEN size_bytes < 1099511627776 THEN 3 WHEN size_bytes < 1125899906842624 THEN 4 ELSE 5 END AS i
      FROM v_jars),
    r AS (SELECT *, round(CAST(size_bytes AS DECIMAL(38, 10)) / CAST(power(1024, i) AS DECIMAL(38, 0)), 1) AS v FROM u)
    SELECT id, size_bytes,
      CASE WHEN size_bytes = 0 THEN '0 B'
           ELSE regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][i + 1] END AS size_text
    FROM r""",
)


@query("safe_object_name")
def safe_object_name(spark, sf):
    j = _jars(spark, sf).withColumn("prefix", F.concat(F.lit("obj"), F.col("id").cast("string")))
    return CA.safe_object_names(j, "prefix")


register(
    "safe_object_name",
    "SELECT id, name, 'obj' || CAST(id AS VARCHAR) || '-' || regexp_replace(name, '[^a-zA-Z0-9.\\-_]', '_', 'g') AS object_name FROM v_jars",
)


@query("artifact_references")
def artifact_references(spark, sf):
    return CA.artifact_references(_jars(spark, sf), registry.deployments(spark, sf))


register(
    "artifact_references",
    """SELECT j.id, j.name, count(d.id) AS n_active, count(d.id) = 0 AS deletable
    FROM v_jars j LEFT JOIN v_deployments d
      ON d.jar_id = j.id AND d.deleted_at IS NULL AND d.status NOT IN ('deleted', 'failed')
    WHERE j.deleted_at IS NULL GROUP BY j.id, j.name""",
)


@query("live_rows")
def live_rows(spark, sf):
    return CA.live_rows(_jars(spark, sf)).select("id", "name", "object_name")


register("live_rows", "SELECT id, name, object_name FROM v_jars WHERE deleted_at IS NULL")


def _deployments(spark, sf):
    return FO.live(registry.deployments(spark, sf))


EFFECTIVE_COLS = ["id", "namespace", "image", "flink_version", "service_account", "jm_memory", "jm_cpu", "jm_replicas",
                  "tm_memory", "tm_cpu", "tm_replicas", "tm_slots", "n_flink_conf"]


@query("effective_config")
def effective_config(spark, sf):
    e = CR.effective_config(_deployments(spark, sf), registry.defaults(spark))
    return e.withColumn("n_flink_conf", F.size("flink_configuration")).select(*EFFECTIVE_COLS)


# The seeded defaults, written out again so that the two sides check each other.
_D = dict(image="flink:1.19-kafka", flink_version="v1_19", service_account="flink", namespace="default",
          job_manager_memory="1024m", job_manager_cpu="0.5", job_manager_replicas=1,
          task_manager_memory="1024m", task_manager_cpu="0.5", task_manager_replicas=1, task_manager_slots=1)


def _dflt(col: str, default, kind: str) -> str:
    lit = f"'{default}'" if isinstance(default, str) and kind == "string" else str(default)
    empty = "''" if kind == "string" else "0"
    return f"CASE WHEN {col} IS NULL OR {col} = {empty} THEN {lit} ELSE {col} END"


EFFECTIVE_SQL = f"""SELECT id,
  {_dflt('namespace', _D['namespace'], 'string')} AS namespace,
  {_dflt('cfg_image', _D['image'], 'string')} AS image,
  {_dflt('cfg_flink_version', _D['flink_version'], 'string')} AS flink_version,
  {_dflt('cfg_service_account', _D['service_account'], 'string')} AS service_account,
  {_dflt('jm_memory', _D['job_manager_memory'], 'string')} AS jm_memory,
  CAST({_dflt('jm_cpu', _D['job_manager_cpu'], 'number')} AS DOUBLE) AS jm_cpu,
  {_dflt('jm_replicas', _D['job_manager_replicas'], 'number')} AS jm_replicas,
  {_dflt('tm_memory', _D['task_manager_memory'], 'string')} AS tm_memory,
  CAST({_dflt('tm_cpu', _D['task_manager_cpu'], 'number')} AS DOUBLE) AS tm_cpu,
  {_dflt('tm_replicas', _D['task_manager_replicas'], 'number')} AS tm_replicas,
  {_dflt('tm_slots', _D['task_manager_slots'], 'number')} AS tm_slots,
  (conf_parallelism IS NOT NULL)::INT + (conf_backend IS NOT NULL)::INT AS n_flink_conf,
  job_parallelism
FROM v_deployments WHERE deleted_at IS NULL"""
register("effective_config", f"SELECT {', '.join(EFFECTIVE_COLS)} FROM ({EFFECTIVE_SQL})")


def _updates(spark, sf):
    u = view(spark, sf, "v_updates")
    entries = F.array(
        F.struct(F.lit("parallelism.default").alias("key"), F.col("upd_conf_parallelism").alias("value")),
        F.struct(F.lit("state.backend").alias("key"), F.col("upd_conf_backend").alias("value")),
        F.struct(F.lit("execution.checkpointing.unaligned").alias("key"), F.col("upd_conf_unaligned").alias("value")),
    )
    given = lambda a: F.map_from_entries(F.filter(a, lambda e: e["value"].isNotNull()))
    env = F.array(F.struct(F.lit("STAGE").alias("key"), F.col("upd_env_stage").alias("value")))
    return u.withColumn("upd_flink_configuration", given(entries)).withColumn("upd_environment_variables", F.when(F.col("upd_env_given"), given(env)))


@query("merge_config")
def merge_config(spark, sf):
    m = CR.merge_config(_deployments(spark, sf), _updates(spark, sf))
    conf = F.col("flink_configuration")
    return m.select(
        "id", "image", "jm_memory", "jm_cpu", "jm_replicas", "tm_memory", "tm_cpu", "tm_replicas", "tm_slots", "job_parallelism",
        F.col("environment_variables").getItem("STAGE").alias("env_stage"), F.col("environment_variables").getItem("REGION").alias("env_region"),
        F.size("environment_variables").alias("n_env"),
        conf.getItem("parallelism.default").alias("conf_parallelism"), conf.getItem("state.backend").alias("conf_backend"),
        conf.getItem("execution.checkpointing.unaligned").alias("conf_unaligned"), F.size(conf).alias("n_conf"),
    )


MERGE_SQL = """SELECT d.id, coalesce(u.upd_image, d.cfg_image) AS image, coalesce(u.upd_jm_memory, d.jm_memory) AS jm_memory,
  CAST(coalesce(u.upd_jm_cpu, d.jm_cpu) AS DOUBLE) AS jm_cpu, coalesce(u.upd_jm_replicas, d.jm_replicas) AS jm_replicas,
  coalesce(u.upd_tm_memory, d.tm_memory) AS tm_memory, CAST(coalesce(u.upd_tm_cpu, d.tm_cpu) AS DOUBLE) AS tm_cpu,
  CASE WHEN u.upd_env_given THEN u.upd_env_stage ELSE d.env_stage END AS env_stage,
  CASE WHEN NOT u.upd_env_given THEN d.env_region END AS env_region,
  CASE WHEN u.upd_env_given THEN (u.upd_env_stage IS NOT NULL)::INT ELSE (d.env_stage IS NOT NULL)::INT + (d.env_region IS NOT NULL)::INT END AS n_env,
  coalesce(u.upd_tm_replicas, d.tm_replicas) AS tm_replicas, coalesce(u.upd_tm_slots, d.tm_slots) AS tm_slots,
  coalesce(u.upd_job_parallelism, d.job_parallelism) AS job_parallelism,
  coalesce(u.upd_conf_parallelism, d.conf_parallelism) AS conf_parallelism,
  coalesce(u.upd_conf_backend, d.conf_backend) AS conf_backend,
  u.upd_conf_unaligned AS conf_unaligned,
  (coalesce(u.upd_conf_parallelism, d.conf_parallelism) IS NOT NULL)::INT
    + (coalesce(u.upd_conf_backend, d.conf_backend) IS NOT NULL)::INT + (u.upd_conf_unaligned IS NOT NULL)::INT AS n_conf
FROM v_deployments d JOIN v_updates u ON u.deployment_id = d.id WHERE d.deleted_at IS NULL"""
register("merge_config", MERGE_SQL)


_STORE = {"s3.endpoint": "http://store:9000"}


@query("checkpoint_overlay")
def checkpoint_overlay(spark, sf):
    """Entries of every deployment's final configuration; some deployments set entries that clash with the checkpoint defaults."""
    e = CR.effective_config(_deployments(spark, sf), registry.defaults(spark)).join(_deployments(spark, sf).select("id", "deployment_name", "jar_id"), "id")
    own = F.array(F.struct(F.lit("execution.checkpointing.interval").alias("key"), F.when(F.col("id") % 5 == 1, (F.col("id") % 7 * 1000 + 5000).cast("string")).alias("value")),
                  F.struct(F.lit("state.backend.type").alias("key"), F.when(F.col("id") % 3 == 0, "rocksdb").alias("value")),
                  F.struct(F.lit("taskmanager.numberOfTaskSlots").alias("key"), F.when(F.col("id") % 11 == 4, "9").alias("value")),
                  F.struct(F.lit("state.savepoints.dir").alias("key"), F.when(F.col("id") % 13 == 2, "s3://elsewhere").alias("value")))
    given = F.map_from_entries(F.filter(own, lambda x: x["value"].isNotNull()))
    cfg = e.withColumn("has_artifact", F.col("jar_id").isNotNull()).withColumn("flink_configuration", F.map_concat("flink_configuration", given))
    return CR.checkpoint_configuration(cfg, _STORE).select("id", F.explode("configuration").alias("key", "value"))


register(
    "checkpoint_overlay",
    f"""WITH e AS (SELECT e.*, d.deployment_name, d.jar_id, d.conf_parallelism, d.conf_backend FROM (SELECT id, tm_slots FROM ({EFFECTIVE_SQL})) e JOIN v_deployments d USING (id)),
    layers AS (
      SELECT id, 1 AS layer, 'taskmanager.numberOfTaskSlots' AS key, CAST(tm_slots AS VARCHAR) AS value FROM e
      UNION ALL SELECT id, 1, 'user.artifacts.raw-http-enabled', CASE WHEN jar_id IS NOT NULL THEN 'true' END FROM e
      UNION ALL SELECT id, 2, k, v FROM e, (VALUES ('s3.endpoint', 'http://store:9000'), ('s3.path.style.access', 'true'), ('state.backend.type', 'hashmap'),
        ('execution.checkpointing.interval', '30000'), ('execution.checkpointing.mode', 'EXACTLY_ONCE'), ('execution.checkpointing.min-pause', '10000')) AS f(k, v)
      UNION ALL SELECT id, 2, 'state.checkpoints.dir', 's3://flink-' || left(deployment_name, 57) || '/checkpoints' FROM e
      UNION ALL SELECT id, 2, 'state.savepoints.dir', 's3://flink-' || left(deployment_name, 57) || '/savepoints' FROM e
      UNION ALL SELECT id, 3, 'parallelism.default', conf_parallelism FROM e
      UNION ALL SELECT id, 3, 'state.backend', conf_backend FROM e
      UNION ALL SELECT id, 3, 'execution.checkpointing.interval', CASE WHEN id % 5 = 1 THEN CAST(id % 7 * 1000 + 5000 AS VARCHAR) END FROM e
      UNION ALL SELECT id, 3, 'state.backend.type', CASE WHEN id % 3 = 0 THEN 'rocksdb' END FROM e
      UNION ALL SELECT id, 3, 'taskmanager.numberOfTaskSlots', CASE WHEN id % 11 = 4 THEN '9' END FROM e
      UNION ALL SELECT id, 3, 'state.savepoints.dir', CASE WHEN id % 13 = 2 THEN 's3://elsewhere' END FROM e)
    SELECT id, key, arg_max(value, layer) AS value FROM layers WHERE value IS NOT NULL GROUP BY id, key""",
)


@query("config_violations")
def config_violations(spark, sf):
    return CR.config_violations(_deployments(spark, sf))


_DNS = "^[a-z0-9]([-a-z0-9]*[a-z0-9])?$"
_MEM = "^[1-9][0-9]*(m|g|M|G)$"
_MEM_MSG = 'must be number + unit. E.g., "1600m", "2g"'
_DNS_MSG = "must be lowercase alphanumeric, may contain hyphens, cannot start/end with hyphen"
_V = [
    ("deploymentName", "is required", "deployment_name IS NULL"),
    ("deploymentName", _DNS_MSG, f"NOT regexp_full_match(deployment_name, '{_DNS}')"),
    ("deploymentName", "must be 1-63 characters", "length(deployment_name) < 1 OR length(deployment_name) > 63"),
    ("namespace", _DNS_MSG, f"NOT regexp_full_match(namespace, '{_DNS}')"),
    ("jarId", "must be a positive integer", "jar_id <= 0"),
    ("jobParallelism", "must be between 1 and 1024", "job_parallelism < 1 OR job_parallelism > 1024"),
    ("config.image", "is not allowed to be empty", "cfg_image = ''"),
    ("config.flinkVersion", "is not allowed to be empty", "cfg_flink_version = ''"),
    ("config.serviceAccount", "is not allowed to be empty", "cfg_service_account = ''"),
    ("config.jobManager.memory", _MEM_MSG, f"NOT regexp_full_match(jm_memory, '{_MEM}')"),
    ("config.jobManager.cpu", "must be between 0.1 and 32", "jm_cpu < 0.1 OR jm_cpu > 32"),
    ("config.jobManager.replicas", "must be 1", "jm_replicas <> 1"),
    ("config.taskManager.memory", _MEM_MSG, f"NOT regexp_full_match(tm_memory, '{_MEM}')"),
    ("config.taskManager.cpu", "must be between 0.1 and 32", "tm_cpu < 0.1 OR tm_cpu > 32"),
    ("config.taskManager.replicas", "must be between 1 and 100", "tm_replicas < 1 OR tm_replicas > 100"),
    ("config.taskManager.taskSlots", "must be between 1 and 32", "tm_slots < 1 OR tm_slots > 32"),
    ("jarId", "is required for application mode", "deployment_mode = 'application' AND jar_id IS NULL"),
]
register(
    "config_violations",
    " UNION ALL ".join(
        f"SELECT id, '{f}' AS field, '{m}' AS message FROM v_deployments WHERE deleted_at IS NULL AND coalesce({c}, false)"
        for f, m, c in _V
    ),
)


@query("slot_capacity")
def slot_capacity(spark, sf):
    """Effective configurations whose parallelism exceeds task managers x slots."""
    return CR.slot_capacity(CR.effective_config(_deployments(spark, sf), registry.defaults(spark)))


register(
    "slot_capacity",
    f"""SELECT id, job_parallelism, CAST(tm_replicas * tm_slots AS BIGINT) AS total_slots FROM ({EFFECTIVE_SQL})
    WHERE job_parallelism <> 0 AND job_parallelism > tm_replicas * tm_slots""",
)


# Stand-in names: some longer than the folder name holds, a few of those alike in their first 57 characters.
_LONG_NAMES = ("CASE WHEN id % 40 = 0 THEN rpad('long-' || CAST(id % 3 AS STRING), 58, 'x') || '-' || CAST(id AS STRING) "
               "WHEN id % 41 = 0 THEN rpad(deployment_name || '-', 60, 'y') ELSE deployment_name END")


@query("state_location")
def state_location(spark, sf):
    return CR.state_locations(_deployments(spark, sf).select("id", F.expr(_LONG_NAMES).alias("deployment_name")))


register(
    "state_location",
    f"""WITH n AS (SELECT id, {_LONG_NAMES} AS deployment_name FROM v_deployments WHERE deleted_at IS NULL),
    l AS (SELECT *, 'flink-' || left(deployment_name, 57) AS state_location FROM n)
    SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM l o WHERE o.state_location = l.state_location AND o.deployment_name <> l.deployment_name)
                     THEN 'shared with another name' WHEN length(deployment_name) > 57 THEN 'name does not fit' END AS violation FROM l""",
)


@query("duplicate_keys")
def duplicate_keys(spark, sf):
    """Uniqueness audits: deployment names, (deployment, savepoint path), object names, usernames, emails."""
    users = view(spark, sf, "v_users")
    named = view(spark, sf, "v_jars").withColumn("entry", F.concat("entry_class", F.lit("/"), (F.col("id") % 500).cast("string")))
    parts = [
        CR.duplicate_keys("deployment_name", registry.deployments(spark, sf), ["deployment_name"]),
        CR.duplicate_keys("savepoint", view(spark, sf, "v_savepoint_rows"), ["deployment_id", "path"]),
        CR.duplicate_keys("object_name", _jars(spark, sf), ["object_name"]),
        CR.duplicate_keys("username", users, ["username"]),
        CR.duplicate_keys("email", users, ["email"]),
        CR.duplicate_keys("entry", named, ["entry"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register(
    "duplicate_keys",
    """SELECT 'deployment_name' AS key_kind, deployment_name AS key_value, count(*) AS n FROM v_deployments GROUP BY deployment_name HAVING count(*) > 1
    UNION ALL SELECT 'savepoint', CAST(deployment_id AS VARCHAR) || '|' || path, count(*) FROM v_savepoint_rows GROUP BY deployment_id, path HAVING count(*) > 1
    UNION ALL SELECT 'object_name', object_name, count(*) FROM v_jars GROUP BY object_name HAVING count(*) > 1
    UNION ALL SELECT 'username', username, count(*) FROM v_users GROUP BY username HAVING count(*) > 1
    UNION ALL SELECT 'email', email, count(*) FROM v_users GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT 'entry', entry, count(*) FROM (SELECT entry_class || '/' || CAST(id % 500 AS VARCHAR) AS entry FROM v_jars)
      WHERE entry IS NOT NULL GROUP BY entry HAVING count(*) > 1""",
)


@query("registration_conflicts")
def registration_conflicts(spark, sf):
    """Sign-up requests (one per customer, new username, recycled email) that clash on email OR username."""
    users = view(spark, sf, "v_users")
    req = users.select(
        F.col("id").alias("request_id"),
        F.concat(F.col("username"), F.lit("x")).alias("username"),
        F.concat(F.lit("user"), (F.col("id") % 1000).cast("string"), F.lit("@example.org")).alias("email"),
    )
    return CR.registration_conflicts(req, users.select("username", "email"))


register(
    "registration_conflicts",
    """WITH req AS (SELECT id AS request_id, username || 'x' AS username, 'user' || CAST(id % 1000 AS VARCHAR) || '@example.org' AS email FROM v_users)
    SELECT * FROM req r WHERE EXISTS (SELECT 1 FROM v_users u WHERE u.email = r.email OR u.username = r.username)""",
)


@query("env_entries")
def env_entries(spark, sf):
    return CR.env_entries(_deployments(spark, sf))


register(
    "env_entries",
    """SELECT id, 'STAGE' AS name, env_stage AS value FROM v_deployments WHERE deleted_at IS NULL AND env_stage IS NOT NULL
    UNION ALL SELECT id, 'REGION', env_region FROM v_deployments WHERE deleted_at IS NULL AND env_region IS NOT NULL""",
)


@query("over_limit")
def over_limit(spark, sf):
    """Login and registration attempts beyond the limit of their fixed window, per source key."""
    return AC.over_limit(view(spark, sf, "v_access"))


register(
    "over_limit",
    """WITH a AS (SELECT *, CASE kind WHEN 'login' THEN 5 ELSE 10 END AS lim,
        time_bucket(CASE kind WHEN 'login' THEN INTERVAL 2 MINUTE ELSE INTERVAL 60 MINUTE END, ts, TIMESTAMP '1970-01-01') AS window_start
      FROM v_access),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_key, kind, window_start ORDER BY ts, event_id) AS rn FROM a)
    SELECT source_key, kind, window_start, ts, event_id, lim AS "limit" FROM r WHERE rn > lim""",
)
