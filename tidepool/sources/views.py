"""Stand-in inputs derived from the driver's tables.

The driver's tables (TPC-H-like plus ``events`` and ``documents``) contain none
of the domain tables this library works on, so each domain table is *derived*
from them by plain row expressions: messages on a topic, container log lines,
the deployment registry, cluster snapshots, pods, cluster events, savepoints,
artifacts and access events. These views only shape rows into the schema a job
expects; the jobs themselves live in ``tidepool.operators`` and never look at
how the rows were made.

Each view is written once as SQL expression text with a few dialect hooks, so
that Spark (``selectExpr``) and the DuckDB oracle see exactly the same rows.
Nested, JSON-shaped documents (CRs, pods, events, snapshots, log streams) are
assembled on the Spark side from the same flat columns; the oracle uses the
flat columns directly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Dialect:
    """Timestamp helpers, the only place where Spark and DuckDB SQL differ here."""

    def __init__(self, name: str):
        self.name = name

    def us(self, ts: str) -> str:  # epoch microseconds of a TIMESTAMP_NTZ
        if self.name == "spark":
            return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"
        return f"epoch_us({ts})"

    def ms(self, ts: str) -> str:  # epoch milliseconds of a TIMESTAMP_NTZ, truncated
        return f"CAST(floor({self.us(ts)} / 1000) AS BIGINT)"

    def logts(self, ts: str) -> str:  # log4j %d{yyyy-MM-dd HH:mm:ss,SSS}
        if self.name == "spark":
            return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss,SSS')"
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S,%g')"

    def iso(self, ts: str) -> str:  # ISO-8601 with Z, second precision
        if self.name == "spark":
            return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"

    def add(self, ts: str, unit: str, n: str) -> str:  # unit: SECOND | MINUTE | HOUR | DAY
        if self.name == "spark":
            return f"timestampadd({unit}, {n}, {ts})"
        return f"({ts} + to_{unit.lower()}s(CAST({n} AS BIGINT)))"

    def least_is(self, col: str, value: str) -> str:  # min(col) = 'value' within a group; Spark would sort all rows for the minimum of a string
        if self.name == "spark":
            return f"(bool_or({col} = '{value}') AND NOT bool_or({col} < '{value}'))"
        return f"min({col}) = '{value}'"

    def tab(self) -> str:
        return "'\t'" if self.name == "spark" else "chr(9)"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")


@dataclass
class Part:
    table: str
    cols: list[str]
    where: str | None = None
    group_by: list[str] = field(default_factory=list)


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _messages(d: Dialect) -> list[Part]:
    return [
        Part("documents", ["doc_id AS id", "text AS message"]),
        Part(
            "events",
            [
                "1000000000000 + event_id AS id",
                "CASE WHEN event_type = 'signup' AND event_id % 101 = 0 THEN CAST(NULL AS STRING) "
                f"ELSE event_type || '-' || {_s('event_id')} END AS message",
            ],
        ),
        Part("customer", ["2000000000000 + c_custkey AS id", "c_name || ' ' || c_mktsegment AS message"]),
    ]


_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' "
    "WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"
)


def _log_labels() -> list[str]:
    return [
        f"'job-' || {_s('user_id % 20')} AS app",
        "CASE WHEN event_id % 2 = 0 THEN 'jobmanager' ELSE 'taskmanager' END AS component",
        "'default' AS namespace",
        f"'job-' || {_s('user_id % 20')} || '-' || "
        f"CASE WHEN event_id % 2 = 0 THEN 'jobmanager' ELSE 'taskmanager' END || '-' || {_s('user_id % 3')} AS pod",
    ]


def _logs(d: Dialect) -> list[Part]:
    main_line = (
        f"{d.logts('ts')} || ' ' || rpad({_LEVEL}, 5, ' ') || ' ' || 'org.example.' || event_type || '.Handler'"
        f" || ' - ' || 'user ' || {_s('user_id')} || ' did ' || event_type || ' ' || props"
    )
    trace_line = f"{d.tab()} || 'at org.example.' || event_type || '.Handler.run(Handler.java:' || {_s('event_id % 500')} || ')'"
    return [
        Part("events", _log_labels() + ["event_id", f"{d.us('ts')} * 1000 AS ts_ns", f"{main_line} AS line"]),
        Part(
            "events",
            _log_labels() + ["event_id", f"{d.us('ts')} * 1000 + 1 AS ts_ns", f"{trace_line} AS line"],
            where="event_id % 17 = 0",
        ),
    ]


_STATUS = (
    "CASE o_orderstatus || o_orderpriority "
    "WHEN 'F1-URGENT' THEN 'running' WHEN 'F2-HIGH' THEN 'suspended' WHEN 'F3-MEDIUM' THEN 'failed' "
    "WHEN 'F4-NOT SPECIFIED' THEN 'deleted' WHEN 'F5-LOW' THEN 'succeeded' "
    "WHEN 'O1-URGENT' THEN 'creating' WHEN 'O2-HIGH' THEN 'running' WHEN 'O3-MEDIUM' THEN 'deleting' "
    "WHEN 'O4-NOT SPECIFIED' THEN 'unknown' WHEN 'O5-LOW' THEN 'rolling_back' "
    "WHEN 'P1-URGENT' THEN 'running' WHEN 'P2-HIGH' THEN 'suspended' WHEN 'P3-MEDIUM' THEN 'failed' "
    "WHEN 'P4-NOT SPECIFIED' THEN 'creating' ELSE 'running' END"
)


def _deployments(d: Dialect) -> list[Part]:
    name = f"'job-' || {_s('o_orderkey')}"
    ns = "CASE WHEN o_custkey % 5 = 0 THEN 'analytics' ELSE 'default' END"
    return [
        Part(
            "orders",
            [
                "o_orderkey AS id",
                f"{name} AS deployment_name",
                f"{ns} AS namespace",
                f"{_STATUS} AS status",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'session' ELSE 'application' END AS deployment_mode",
                "CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_custkey END AS jar_id",
                "CASE o_orderkey % 11 WHEN 0 THEN 'stop' WHEN 1 THEN 'force_stop' WHEN 2 THEN 'resume' "
                "WHEN 3 THEN 'delete' ELSE CAST(NULL AS STRING) END AS pending_action",
                "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'task crashed' "
                "WHEN o_orderkey % 29 = 0 THEN 'old failure' ELSE CAST(NULL AS STRING) END AS error_message",
                "CAST(o_orderkey % 13 AS INT) AS job_parallelism",
                f"CASE WHEN o_orderkey % 4 = 0 THEN 's3://flink-job-' || {_s('o_orderkey')} || '/savepoints/savepoint-old' "
                "ELSE CAST(NULL AS STRING) END AS last_savepoint_path",
                "o_orderdate AS created_at",
                "o_orderdate AS updated_at",
                "CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate END AS deleted_at",
                # resources: at most one FlinkDeployment resource
                "CASE WHEN o_orderkey % 17 = 0 OR o_orderstatus || o_orderpriority = 'F4-NOT SPECIFIED' "
                "THEN 0 ELSE 1 END AS n_resources",
                f"'uid-' || {_s('o_orderkey')} AS resource_uid",
                # configuration as submitted (NULL = not given)
                "CASE o_orderkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' "
                f"ELSE 'flink:1.19-kafka-r' || {_s('o_custkey % 4')} END AS cfg_image",
                "CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS STRING) ELSE 'v1_19' END AS cfg_flink_version",
                "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'flink' END AS cfg_service_account",
                "CASE o_orderkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN '2g' WHEN 3 THEN '0m' "
                "WHEN 4 THEN '1600m' WHEN 5 THEN '512Mi' ELSE '1024M' END AS jm_memory",
                "CAST(CAST(o_custkey % 37 AS DOUBLE) * 0.25 AS DECIMAL(4,2)) AS jm_cpu",
                "CASE o_orderkey % 10 WHEN 5 THEN 2 WHEN 6 THEN CAST(NULL AS INT) ELSE 1 END AS jm_replicas",
                "CASE o_custkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '4g' WHEN 2 THEN '1728m' "
                "WHEN 3 THEN 'lots' ELSE '2048m' END AS tm_memory",
                "CAST(CAST(o_orderkey % 41 AS DOUBLE) AS DECIMAL(4,2)) AS tm_cpu",
                "CAST(o_custkey % 4 AS INT) AS tm_replicas",
                "CAST(o_orderkey % 5 AS INT) AS tm_slots",
                # optional flink configuration entries
                f"CASE WHEN o_orderkey % 2 = 0 THEN {_s('o_orderkey % 4')} END AS conf_parallelism",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'rocksdb' END AS conf_backend",
                # optional environment variables
                "CASE WHEN o_custkey % 2 = 0 THEN 'prod' END AS env_stage",
                f"CASE WHEN o_orderkey % 4 = 1 THEN 'r' || {_s('o_custkey % 3')} END AS env_region",
            ],
        )
    ]


def _updates(d: Dialect) -> list[Part]:
    """Requested edits of deployments (G2): one per order, every field given by some of them."""
    return [
        Part(
            "orders",
            [
                "o_orderkey AS deployment_id",
                "CASE WHEN o_custkey % 3 = 0 THEN 'flink:1.20' END AS upd_image",
                "CASE WHEN o_orderkey % 5 = 1 THEN '3g' END AS upd_jm_memory",
                "CASE WHEN o_orderkey % 6 = 4 THEN CAST(1.5 AS DECIMAL(4,2)) END AS upd_jm_cpu",
                "CASE WHEN o_orderkey % 9 = 2 THEN CAST(1 AS INT) END AS upd_jm_replicas",
                "CASE WHEN o_custkey % 6 = 3 THEN '6g' END AS upd_tm_memory",
                "CASE WHEN o_custkey % 7 = 5 THEN CAST(2.25 AS DECIMAL(4,2)) END AS upd_tm_cpu",
                "o_orderkey % 5 = 3 AS upd_env_given",
                "CASE WHEN o_custkey % 2 = 1 THEN 'test' END AS upd_env_stage",
                "CASE WHEN o_orderkey % 4 = 2 THEN CAST(3 AS INT) END AS upd_tm_replicas",
                "CASE WHEN o_custkey % 4 = 1 THEN CAST(4 AS INT) END AS upd_tm_slots",
                "CASE WHEN o_custkey % 2 = 1 THEN '8' END AS upd_conf_parallelism",
                "CASE WHEN o_orderkey % 7 = 3 THEN 'hashmap' END AS upd_conf_backend",
                "CASE WHEN o_custkey % 5 = 2 THEN 'true' END AS upd_conf_unaligned",
                "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey % 20 AS INT) END AS upd_job_parallelism",
            ],
        )
    ]


_LIFECYCLE = (
    "CASE o_custkey % 12 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'CREATED' WHEN 2 THEN 'DEPLOYED' "
    "WHEN 3 THEN 'STABLE' WHEN 4 THEN 'RECONCILING' WHEN 5 THEN 'SUSPENDED' WHEN 6 THEN 'ROLLING_BACK' "
    "WHEN 7 THEN 'DELETING' WHEN 8 THEN 'FAILED' WHEN 9 THEN 'FAILING' WHEN 10 THEN '' ELSE 'STABLE' END"
)
_JOB_STATE = (
    "CASE (o_custkey + o_orderkey) % 8 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'RUNNING' "
    "WHEN 2 THEN 'FINISHED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'FAILING' WHEN 5 THEN 'CREATED' "
    "WHEN 6 THEN 'RECONCILING' ELSE 'RUNNING' END"
)
_CR_ERROR = (
    "CASE o_orderkey % 13 "
    "WHEN 0 THEN 'org.apache.flink.SomeException: task crashed' "
    "WHEN 1 THEN '{\"type\":\"x\",\"message\":\"java.lang.IllegalStateException: Job Not Found\"}' "
    "WHEN 2 THEN '{\"code\":404}' "
    "WHEN 3 THEN 'Missing savepoint: none' "
    "WHEN 4 THEN '' "
    "WHEN 5 THEN 'plain: no dot here' "
    "ELSE CAST(NULL AS STRING) END"
)


def _cr(d: Dialect) -> list[Part]:
    """Flat columns of the FlinkDeployment custom resource snapshot; 9 in 10 deployments have one."""
    return [
        Part(
            "orders",
            [
                f"'job-' || {_s('o_orderkey')} AS name",
                "CASE WHEN o_custkey % 5 = 0 THEN 'analytics' ELSE 'default' END AS namespace",
                "CASE WHEN o_orderkey % 4 = 0 THEN 'suspended' ELSE 'running' END AS spec_job_state",
                f"{_LIFECYCLE} AS lifecycle_state",
                "CASE WHEN o_orderkey % 5 = 0 THEN 'DEPLOYING' WHEN o_orderkey % 23 = 0 THEN '' ELSE 'READY' END AS jm_status",
                f"{_JOB_STATE} AS job_state",
                f"CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 <> 0 THEN 's3://flink-job-' || {_s('o_orderkey')} "
                f"|| '/savepoints/savepoint-' || {_s('o_custkey')} END AS upgrade_path",
                "CAST(o_orderkey % 3 AS INT) AS n_history",
                f"{_CR_ERROR} AS error",
                "CASE o_orderkey % 19 WHEN 5 THEN 'restored after OOMKilled' WHEN 6 THEN 'ErrImagePull seen' END AS job_note",
                "CAST((o_orderkey + o_custkey) % 3 AS INT) AS n_conditions",
                f"{d.iso('o_orderdate')} AS cond_time",
            ],
            where="o_orderkey % 10 <> 9",
        )
    ]


def _jars(d: Dialect) -> list[Part]:
    created = d.add("TIMESTAMP '2024-01-01 00:00:00'" if d.name == "duckdb" else "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "MINUTE", "p_partkey")
    return [
        Part(
            "part",
            [
                "p_partkey AS id",
                "p_name || '.jar' AS name",
                f"'obj' || {_s('p_partkey')} || '-' || p_name || '.jar' AS object_name",
                "CASE WHEN p_partkey % 50 = 0 THEN CAST(0 AS BIGINT) "
                "WHEN p_partkey % 97 = 0 THEN CAST(p_size AS BIGINT) * 1099511627776 "
                "WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) "
                "WHEN p_partkey % 4 = 1 THEN CAST(p_size AS BIGINT) * 1024 + p_partkey "
                "WHEN p_partkey % 4 = 2 THEN CAST(p_size AS BIGINT) * 1048576 + p_partkey * 1000 "
                "ELSE CAST(p_size AS BIGINT) * 1073741824 END AS size_bytes",
                "p_partkey % 10 AS uploaded_by",
                "CASE WHEN p_partkey % 3 = 0 THEN 'org.example.Main' END AS entry_class",
                f"{created} AS created_at",
                f"{created} AS updated_at",
                f"CASE WHEN p_partkey % 13 = 0 THEN {created} END AS deleted_at",
            ],
        )
    ]


def _savepoint_rows(d: Dialect) -> list[Part]:
    """One savepoint record per line item: (deployment, path) repeats, as before a unique index."""
    return [
        Part(
            "lineitem",
            [
                "l_orderkey AS deployment_id",
                f"'s3://flink-job-' || {_s('l_orderkey')} || '/savepoints/savepoint-' || {_s('l_linenumber')} AS path",
                "CASE WHEN l_returnflag = 'R' THEN 'manual' ELSE 'stop' END AS source",
                "l_shipdate AS created_at",
            ],
        )
    ]


def _savepoints(d: Dialect) -> list[Part]:
    return [
        Part(
            "lineitem",
            [
                "l_orderkey * 8 + l_linenumber AS id",
                "l_orderkey AS deployment_id",
                f"'s3://flink-job-' || {_s('l_orderkey')} || '/savepoints/savepoint-' || {_s('l_linenumber')} AS path",
                f"CASE WHEN {d.least_is('l_returnflag', 'R')} THEN 'manual' ELSE 'stop' END AS source",
                "min(l_shipdate) AS created_at",
            ],
            group_by=["l_orderkey", "l_linenumber"],
        )
    ]


def _pods(d: Dialect) -> list[Part]:
    """One pod per line item, labelled with the deployment it belongs to; two containers each."""
    wait_state = (
        "CASE WHEN l_partkey % 9 = 0 THEN '{\"waiting\":{\"reason\":\"CrashLoopBackOff\"}}' "
        "WHEN l_partkey % 9 = 1 THEN '{\"waiting\":{\"reason\":\"ImagePullBackOff\"}}' "
        "WHEN l_partkey % 9 = 2 THEN '{\"terminated\":{\"reason\":\"Completed\",\"exitCode\":0}}' "
        "WHEN l_partkey % 9 = 3 THEN CAST(NULL AS STRING) WHEN l_partkey % 9 = 4 THEN '{\"running\":null}' "
        "ELSE '{\"running\":{\"startedAt\":\"2024-01-01T00:00:00Z\"}}' END"
    )
    last_state = (
        "CASE WHEN l_suppkey % 11 = 0 THEN '{\"terminated\":{\"reason\":\"OOMKilled\",\"exitCode\":137}}' "
        "ELSE CAST(NULL AS STRING) END"
    )
    return [
        Part(
            "lineitem",
            [
                f"'job-' || {_s('l_orderkey')} || '-taskmanager-' || {_s('l_linenumber')} AS pod_name",
                f"'job-' || {_s('l_orderkey')} AS app",
                "CASE WHEN l_suppkey % 5 = 0 THEN 'analytics' ELSE 'default' END AS namespace",
                "CASE l_linestatus WHEN 'O' THEN 'Running' ELSE 'Pending' END AS phase",
                f"CASE WHEN l_linestatus = 'O' THEN 'node-' || {_s('l_suppkey % 4')} END AS node",
                "CASE WHEN l_linestatus = 'F' AND l_partkey % 9 = 5 THEN 'Evicted' END AS reason",
                f"{d.iso('l_shipdate')} AS start_time",
                "l_linenumber = 7 AS no_containers",
                "'flink-main-container' AS c1_name",
                "l_returnflag = 'N' AS c1_ready",
                "CASE WHEN l_partkey % 6 = 0 THEN CAST(NULL AS INT) ELSE CAST(floor(l_quantity) AS INT) % 5 END AS c1_restarts",
                f"{wait_state} AS c1_state",
                f"{last_state} AS c1_last_state",
                "'log-shipper' AS c2_name",
                "true AS c2_ready",
                "CAST(l_suppkey % 2 AS INT) AS c2_restarts",
                "'{\"running\":{}}' AS c2_state",
                "CAST(NULL AS STRING) AS c2_last_state",
            ],
        )
    ]


_K8S_REASON = (
    "CASE event_type WHEN 'error' THEN 'BackOff' WHEN 'purchase' THEN 'FailedScheduling' "
    "WHEN 'click' THEN 'Unhealthy' WHEN 'signup' THEN 'Pulled' ELSE 'Started' END"
)


def _k8s_events(d: Dialect) -> list[Part]:
    target = f"'job-' || {_s('user_id')}"
    msg = (
        "CASE event_type "
        f"WHEN 'error' THEN 'Back-off restarting failed container flink-main-container in pod ' || {target} || '-taskmanager-1 (CrashLoopBackOff)' "
        "WHEN 'purchase' THEN '0/3 nodes are available: insufficient memory' "
        f"WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'Startup probe failed: connection refused' ELSE 'Liveness probe failed for ' || {target} END "
        f"WHEN 'signup' THEN 'Successfully pulled image for ' || {target} "
        "ELSE 'Started container' END"
    )
    last = d.add("ts", "SECOND", "CAST(floor(value * 60) AS BIGINT)")
    return [
        Part(
            "events",
            [
                "event_id",
                f"{_K8S_REASON} AS reason",
                f"{msg} AS message",
                "CASE WHEN event_type IN ('error', 'purchase', 'click') THEN 'Warning' ELSE 'Normal' END AS type",
                "CASE WHEN event_id % 4 = 0 THEN 'FlinkDeployment' ELSE 'Pod' END AS object_kind",
                f"CASE WHEN event_id % 4 = 0 THEN {target} ELSE {target} || '-pod' END AS object_name",
                "CASE WHEN user_id % 5 = 0 THEN 'analytics' ELSE 'default' END AS namespace",
                f"CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE {d.iso('ts')} END AS first_ts",
                f"CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS STRING) ELSE {d.iso(last)} END AS last_ts",
                f"CASE WHEN event_id % 3 = 0 THEN {d.iso('ts')} END AS event_time",
                "CAST(event_id % 4 AS INT) AS count",
            ],
        )
    ]


def _snapshot_created(d: Dialect) -> str:
    return d.add(d.add("l_shipdate", "HOUR", "l_linenumber"), "SECOND", "l_partkey % 3600")


_SNAPSHOT_NS = "CASE WHEN l_suppkey % 7 = 0 THEN 'analytics' ELSE 'default' END AS namespace"


def _snapshots(d: Dialect) -> list[Part]:
    """One snapshot per line item, and for some of them a second one twenty seconds later."""
    created = _snapshot_created(d)

    def cols(suffix: str, made: str, flag: str) -> list[str]:
        result = d.add(made, "SECOND", "(l_suppkey % 40) * 4")
        return [
            f"'sp-' || {_s('l_orderkey')} || '-' || {_s('l_linenumber')} || '-' || {_s('l_partkey')} || '{suffix}' AS name",
            f"'job-' || {_s('l_orderkey')} AS job_name",
            _SNAPSHOT_NS,
            "CASE WHEN l_linenumber % 4 = 0 THEN 'PERIODIC' ELSE 'MANUAL' END AS trigger_type",
            "CASE WHEN l_suppkey % 5 = 0 THEN 'CHECKPOINT' ELSE 'SAVEPOINT' END AS snap_type",
            f"CASE WHEN l_partkey % 23 = 0 THEN 'not-a-time' ELSE {d.iso(made)} END AS created",
            f"CASE {flag} WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS state",
            f"CASE WHEN {flag} <> 'R' THEN 's3://flink-job-' || {_s('l_orderkey')} || '/savepoints/savepoint-' "
            f"|| {_s('l_linenumber')} || '{suffix}' END AS path",
            f"CASE WHEN {flag} = 'N' THEN {d.iso(result)} END AS result_ts",
            f"CASE WHEN {flag} = 'R' AND l_suppkey % 3 <> 0 THEN 'disk full on node ' || {_s('l_suppkey')} END AS error",
        ]

    second = "CASE WHEN l_returnflag = 'N' THEN 'R' ELSE 'N' END"
    return [Part("lineitem", cols("", created, "l_returnflag")),
            Part("lineitem", cols("b", d.add(created, "SECOND", "20"), second), where="l_partkey % 6 = 1")]


def _triggers(d: Dialect) -> list[Part]:
    """Several savepoint triggers per deployment: around the snapshots of its line items, and one thirty days after its creation."""
    made = d.ms(_snapshot_created(d))
    name = f"'job-' || {_s('l_orderkey')} AS deployment_name"
    return [
        Part("lineitem", [name, _SNAPSHOT_NS, f"{made} - (l_suppkey % 8) * 21000 + l_partkey % 1500 AS trigger_ms"]),
        Part("lineitem", [name, _SNAPSHOT_NS, f"{made} - 45000 + l_partkey % 900 AS trigger_ms"], where="l_linenumber % 3 = 0"),
        Part(
            "orders",
            [
                f"'job-' || {_s('o_orderkey')} AS deployment_name",
                "CASE WHEN o_custkey % 5 = 0 THEN 'analytics' ELSE 'default' END AS namespace",
                f"{d.ms(d.add('o_orderdate', 'DAY', '30'))} + o_custkey % 2000 AS trigger_ms",
            ],
        ),
    ]


def _json_logs(d: Dialect) -> list[Part]:
    """Fields of the compact JSON log layout, one event per line."""
    return [
        Part(
            "events",
            _log_labels()
            + [
                "event_id",
                f"{d.ms('ts')} AS time_millis",
                f"{_LEVEL} AS level",
                "'org.example.' || event_type || '.Handler' AS logger_name",
                f"'worker-' || {_s('event_id % 4')} AS thread",
                f"'user ' || {_s('user_id')} || ' did ' || event_type AS message",
            ],
        )
    ]


def _resume_requests(d: Dialect) -> list[Part]:
    """One resume request per order: a deployment (or an unknown name), an optional savepoint id, skip flag."""
    return [
        Part(
            "orders",
            [
                "o_orderkey AS request_id",
                f"CASE WHEN o_orderkey % 53 = 0 THEN 'ghost-' ELSE 'job-' END || {_s('o_orderkey')} AS deployment_name",
                "CASE o_orderkey % 4 WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 1 THEN o_orderkey * 8 + 1 "
                "WHEN 2 THEN CAST(999999999999 AS BIGINT) ELSE o_orderkey * 8 + 2 END AS savepoint_id",
                "o_custkey % 5 = 0 AS skip_savepoint",
            ],
        )
    ]


def _actions(d: Dialect) -> list[Part]:
    """Requests on deployments and what the cluster shows in between: one for each line item, some on unknown deployments, in hours and days apart."""
    pick = "(min(l_partkey) + l_linenumber * 5) % 17"
    return [
        Part(
            "lineitem",
            [
                "l_orderkey * 8 + l_linenumber AS event_id",
                f"CASE WHEN l_orderkey % 61 = 0 THEN 'ghost-' ELSE 'job-' END || {_s('l_orderkey')} AS deployment_name",
                f"{d.ms('min(l_shipdate)')} + l_linenumber * 1000 AS at_ms",
                f"CASE {pick} WHEN 0 THEN 'stop' WHEN 1 THEN 'stop' WHEN 2 THEN 'force_stop' WHEN 3 THEN 'savepoint' WHEN 4 THEN 'resume' WHEN 5 THEN 'resume' WHEN 6 THEN 'resume' "
                "WHEN 7 THEN 'delete' WHEN 8 THEN 'edit' WHEN 9 THEN 'saw:running' WHEN 10 THEN 'saw:running' WHEN 11 THEN 'saw:suspended' WHEN 12 THEN 'saw:suspended' "
                "WHEN 13 THEN 'saw:failed' WHEN 14 THEN 'saw:creating' WHEN 15 THEN 'gone' ELSE 'snapshot' END AS kind",
                f"CASE WHEN {pick} = 5 THEN l_orderkey * 8 + 1 + min(l_suppkey) % 3 WHEN {pick} = 6 THEN l_orderkey * 8 + 9 END AS savepoint_id",
                f"{pick} = 4 AND min(l_suppkey) % 3 = 0 OR {pick} = 5 AND min(l_suppkey) % 5 = 0 AS skip_savepoint",
                f"CASE WHEN {pick} IN (11, 16) OR {pick} = 12 AND min(l_suppkey) % 2 = 0 THEN 's3://flink-job-' || {_s('l_orderkey')} || '/savepoints/new-' || {_s('l_linenumber')} END AS path",
            ],
            group_by=["l_orderkey", "l_linenumber"],
        )
    ]


def _access(d: Dialect) -> list[Part]:
    """Login/registration attempts: one per event, replayed one per second in event order."""
    base = "TIMESTAMP '2024-01-01 00:00:00'" if d.name == "duckdb" else "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    return [
        Part(
            "events",
            [
                f"'ip-' || {_s('user_id % 50')} AS source_key",
                f"{d.add(base, 'SECOND', 'event_id')} AS ts",
                "CASE WHEN event_type = 'signup' THEN 'register' ELSE 'login' END AS kind",
                "event_id",
            ],
        )
    ]


def _users(d: Dialect) -> list[Part]:
    return [
        Part(
            "customer",
            [
                "c_custkey AS id",
                f"lower(replace(c_name, '#', '')) || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE {_s('c_custkey % 7')} END AS username",
                f"'user' || {_s('c_custkey % 900')} || '@example.org' AS email",
            ],
        )
    ]


VIEWS = {
    "v_messages": _messages,
    "v_logs": _logs,
    "v_json_logs": _json_logs,
    "v_deployments": _deployments,
    "v_updates": _updates,
    "v_cr": _cr,
    "v_jars": _jars,
    "v_savepoint_rows": _savepoint_rows,
    "v_savepoints": _savepoints,
    "v_pods": _pods,
    "v_k8s_events": _k8s_events,
    "v_snapshots": _snapshots,
    "v_triggers": _triggers,
    "v_resume_requests": _resume_requests,
    "v_actions": _actions,
    "v_access": _access,
    "v_users": _users,
}


def view_sql(name: str, d: Dialect = DUCK) -> str:
    parts = []
    for p in VIEWS[name](d):
        q = f"SELECT {', '.join(p.cols)} FROM {p.table}"
        if p.where:
            q += f" WHERE {p.where}"
        if p.group_by:
            q += f" GROUP BY {', '.join(p.group_by)}"
        parts.append(q)
    return "\nUNION ALL\n".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark twin of ``view_sql``: the same expressions through ``selectExpr``."""
    out = None
    for p in VIEWS[name](SPARK):
        df = table(spark, sf_dir, p.table)
        if p.where:
            df = df.where(p.where)
        if p.group_by:
            names = [c.rsplit(" AS ", 1)[1] for c in p.cols]
            df = df.groupBy(*p.group_by).agg(*[F.expr(c) for c in p.cols]).select(*names)
        else:
            df = df.selectExpr(*p.cols)
        out = df if out is None else out.unionByName(df)
    return out
