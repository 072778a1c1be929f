"""Deployment configuration: defaults, merges, validation rules, capacity, naming, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import format as FM
from ..session import FINE_PARTS

# Validation patterns, bounds and messages (\z: nothing may follow, not even a line feed).
DNS_PATTERN = r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?\z"
MEMORY_PATTERN = r"^[1-9][0-9]*(m|g|M|G)\z"
MEMORY_MESSAGE = 'must be number + unit. E.g., "1600m", "2g"'
NAME_MAX = 63
PARALLELISM_RANGE = (1, 1024)
CPU_RANGE = (0.1, 32)
TM_REPLICAS_RANGE = (1, 100)
SLOTS_RANGE = (1, 32)


def _falsy(c: Column, kind: str) -> Column:
    """JavaScript falsiness of a present value: NULL, '' or 0."""
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (c == 0)


def _or_default(c: Column, default, kind: str) -> Column:
    return F.when(_falsy(c, kind), F.lit(default)).otherwise(c)


def defaults_row(defaults: DataFrame) -> dict:
    """The lowest-id defaults row (one row, by construction of the query)."""
    r = defaults.orderBy("id").limit(1).collect()
    if not r:
        raise ValueError("no configuration defaults row")
    return r[0].asDict()


def effective_config(deployments: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per field: the requested value unless falsy ('' / 0 / missing), else the default."""
    d = defaults_row(defaults)
    c = lambda f: F.col(f"config.{f}")
    return deployments.select(
        "id",
        _or_default(F.col("namespace"), d["namespace"], "string").alias("namespace"),
        _or_default(c("image"), d["image"], "string").alias("image"),
        _or_default(c("flinkVersion"), d["flink_version"], "string").alias("flink_version"),
        _or_default(c("serviceAccount"), d["service_account"], "string").alias("service_account"),
        _or_default(c("jobManager.memory"), d["job_manager_memory"], "string").alias("jm_memory"),
        _or_default(c("jobManager.cpu"), d["job_manager_cpu"], "number").cast("double").alias("jm_cpu"),
        _or_default(c("jobManager.replicas"), d["job_manager_replicas"], "number").alias("jm_replicas"),
        _or_default(c("taskManager.memory"), d["task_manager_memory"], "string").alias("tm_memory"),
        _or_default(c("taskManager.cpu"), d["task_manager_cpu"], "number").cast("double").alias("tm_cpu"),
        _or_default(c("taskManager.replicas"), d["task_manager_replicas"], "number").alias("tm_replicas"),
        _or_default(c("taskManager.taskSlots"), d["task_manager_slots"], "number").alias("tm_slots"),
        F.coalesce(c("flinkConfiguration"), F.create_map().cast("map<string,string>")).alias("flink_configuration"),
        "job_parallelism",
    )


def merge_config(deployments: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply edits: image replaced when given; both manager objects merged field by field (all seven fields);
    configuration map merged key by key with the new value winning; environment variables replaced as a
    whole when given; other fields kept. NULL in an edit means not given."""
    j = deployments.join(updates, deployments["id"] == updates["deployment_id"])
    old = lambda f: F.col(f"config.{f}")
    merged_conf = F.map_zip_with(
        F.coalesce(old("flinkConfiguration"), F.create_map().cast("map<string,string>")),
        F.coalesce(F.col("upd_flink_configuration"), F.create_map().cast("map<string,string>")),
        lambda k, x, y: F.coalesce(y, x),
    )
    return j.select(
        "id",
        F.coalesce("upd_image", old("image")).alias("image"),
        F.coalesce("upd_jm_memory", old("jobManager.memory")).alias("jm_memory"),
        F.coalesce("upd_jm_cpu", old("jobManager.cpu")).cast("double").alias("jm_cpu"),
        F.coalesce("upd_jm_replicas", old("jobManager.replicas")).alias("jm_replicas"),
        F.coalesce("upd_tm_memory", old("taskManager.memory")).alias("tm_memory"),
        F.coalesce("upd_tm_cpu", old("taskManager.cpu")).cast("double").alias("tm_cpu"),
        F.coalesce("upd_tm_replicas", old("taskManager.replicas")).alias("tm_replicas"),
        F.coalesce("upd_tm_slots", old("taskManager.taskSlots")).alias("tm_slots"),
        merged_conf.alias("flink_configuration"),
        F.coalesce("upd_environment_variables", "environment_variables").alias("environment_variables"),
        F.coalesce("upd_job_parallelism", "job_parallelism").alias("job_parallelism"),
    )


# The checkpoint entries that every deployment gets unless its own configuration says otherwise.
CHECKPOINT_DEFAULTS = {
    "s3.path.style.access": "true",
    "state.backend.type": "hashmap",
    "execution.checkpointing.interval": "30000",
    "execution.checkpointing.mode": "EXACTLY_ONCE",
    "execution.checkpointing.min-pause": "10000",
}


def checkpoint_configuration(cfg: DataFrame, storage: dict[str, str] | None = None) -> DataFrame:
    """id and configuration (map) of every deployment: entries derived from it, then the checkpoint entries, then its own, the later winning.

    ``cfg``: id, deployment_name, tm_slots, has_artifact, flink_configuration. ``storage``: entries of the object store (endpoint, credentials). The folders
    of checkpoints and savepoints are those of the deployment's own state location.
    """
    text = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    place = F.concat(F.lit("s3://"), FM.state_location(F.col("deployment_name")))
    derived = F.map_filter(F.create_map(F.lit("taskmanager.numberOfTaskSlots"), F.col("tm_slots").cast("string"), F.lit("user.artifacts.raw-http-enabled"), F.when(F.col("has_artifact"), "true")), lambda k, v: v.isNotNull())
    folders = F.create_map(F.lit("state.checkpoints.dir"), F.concat(place, F.lit("/checkpoints")), F.lit("state.savepoints.dir"), F.concat(place, F.lit("/savepoints")))
    out = derived
    for layer in (text({**(storage or {}), **CHECKPOINT_DEFAULTS}), folders, F.coalesce("flink_configuration", text({}))):
        out = F.map_zip_with(out, layer, lambda k, x, y: F.coalesce(y, x))
    return cfg.select("id", out.alias("configuration"))


def slot_capacity(cfg: DataFrame) -> DataFrame:
    """Rows whose parallelism exceeds replicas x slots (parallelism missing/0 is not checked)."""
    total = (F.col("tm_replicas") * F.col("tm_slots")).cast("long")
    return cfg.where(F.coalesce(F.col("job_parallelism") != 0, F.lit(False)) & (F.col("job_parallelism") > total)) \
        .select("id", "job_parallelism", total.alias("total_slots"))


def _rule(cond: Column, field: str, message: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def config_violations(deployments: DataFrame) -> DataFrame:
    """One row per broken rule of a submitted deployment; all rules are reported together.
    Optional fields that are absent (NULL) pass."""
    name, ns = F.col("deployment_name"), F.col("namespace")
    c = lambda f: F.col(f"config.{f}")
    given = lambda x: x.isNotNull()
    mem_bad = lambda x: given(x) & ~x.rlike(MEMORY_PATTERN)
    lo_p, hi_p = PARALLELISM_RANGE
    rules = [
        _rule(name.isNull(), "deploymentName", "is required"),
        _rule(given(name) & ~name.rlike(DNS_PATTERN), "deploymentName", "must be lowercase alphanumeric, may contain hyphens, cannot start/end with hyphen"),
        _rule(given(name) & ((F.length(name) < 1) | (F.length(name) > NAME_MAX)), "deploymentName", "must be 1-63 characters"),
        _rule(given(ns) & ~ns.rlike(DNS_PATTERN), "namespace", "must be lowercase alphanumeric, may contain hyphens, cannot start/end with hyphen"),
        _rule(given(F.col("jar_id")) & (F.col("jar_id") <= 0), "jarId", "must be a positive integer"),
        _rule(given(F.col("job_parallelism")) & ((F.col("job_parallelism") < lo_p) | (F.col("job_parallelism") > hi_p)), "jobParallelism", "must be between 1 and 1024"),
        _rule(c("image") == "", "config.image", "is not allowed to be empty"),
        _rule(c("flinkVersion") == "", "config.flinkVersion", "is not allowed to be empty"),
        _rule(c("serviceAccount") == "", "config.serviceAccount", "is not allowed to be empty"),
        _rule(mem_bad(c("jobManager.memory")), "config.jobManager.memory", MEMORY_MESSAGE),
        _rule(given(c("jobManager.cpu")) & ((c("jobManager.cpu") < CPU_RANGE[0]) | (c("jobManager.cpu") > CPU_RANGE[1])), "config.jobManager.cpu", "must be between 0.1 and 32"),
        _rule(given(c("jobManager.replicas")) & (c("jobManager.replicas") != 1), "config.jobManager.replicas", "must be 1"),
        _rule(mem_bad(c("taskManager.memory")), "config.taskManager.memory", MEMORY_MESSAGE),
        _rule(given(c("taskManager.cpu")) & ((c("taskManager.cpu") < CPU_RANGE[0]) | (c("taskManager.cpu") > CPU_RANGE[1])), "config.taskManager.cpu", "must be between 0.1 and 32"),
        _rule(given(c("taskManager.replicas")) & ((c("taskManager.replicas") < TM_REPLICAS_RANGE[0]) | (c("taskManager.replicas") > TM_REPLICAS_RANGE[1])), "config.taskManager.replicas", "must be between 1 and 100"),
        _rule(given(c("taskManager.taskSlots")) & ((c("taskManager.taskSlots") < SLOTS_RANGE[0]) | (c("taskManager.taskSlots") > SLOTS_RANGE[1])), "config.taskManager.taskSlots", "must be between 1 and 32"),
        _rule((F.col("deployment_mode") == "application") & F.col("jar_id").isNull(), "jarId", "is required for application mode"),
    ]
    out = deployments.select("id", F.explode(F.array_compact(F.array(*rules))).alias("v"))
    return out.select("id", "v.field", "v.message")


def state_locations(deployments: DataFrame) -> DataFrame:
    """State folder of each deployment, with what is wrong with it: names that do not fit the folder
    name, and folders that several names share."""
    loc = deployments.select("id", "deployment_name", FM.state_location(F.col("deployment_name")).alias("state_location"))
    held = loc.groupBy("state_location").agg(F.count_distinct("deployment_name").alias("n"))
    shared = held.where("n > 1").select("state_location", F.lit(True).alias("shared"))
    bad = F.when(F.col("shared"), "shared with another name").when(FM.state_too_long(F.col("deployment_name")), "name does not fit")
    return loc.join(shared, "state_location", "left").select("id", "deployment_name", "state_location", bad.alias("violation"))


def duplicate_keys(kind: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Uniqueness audit: key values held by more than one row. As in a unique index, NULLs never clash.

    Nearly all values are distinct, so counting them before the shuffle saves nothing and holds them all: rows are dealt first, and finely.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    dealt = df.select(*keys).repartition(FINE_PARTS, *keys)
    return dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1) \
        .select(F.lit(kind).alias("key_kind"), key.alias("key_value"), "n")


def registration_conflicts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests whose email OR username is already taken: two semi joins (each a hash join), unioned."""
    by_email = requests.join(users.select("email").distinct(), "email", "left_semi")
    by_name = requests.join(users.select("username").distinct(), "username", "left_semi")
    return by_email.unionByName(by_name).distinct()


def env_entries(deployments: DataFrame) -> DataFrame:
    return deployments.select("id", F.explode("environment_variables").alias("name", "value")) \
        .select("id", "name", F.col("value").cast("string").alias("value"))
