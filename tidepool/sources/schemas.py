"""Fixed schemas of topics, registry tables, cluster snapshots and logs.

Every reader passes one of these explicitly; schema inference is never used,
so an absent JSON field is simply NULL.
"""

from pyspark.sql import types as T

# Topics
SOURCE_TOPIC = T.StructType([T.StructField("message", T.StringType())])
SINK_TOPIC = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("message_upper", T.StringType()),
        T.StructField("message_length", T.IntegerType()),
        T.StructField("category", T.StringType()),
    ]
)

# Registry tables
RESOURCE = "struct<kind:string,name:string,namespace:string,uid:string,apiVersion:string>"
JOB_MANAGER = "struct<memory:string,cpu:decimal(4,2),replicas:int>"
TASK_MANAGER = "struct<memory:string,cpu:decimal(4,2),replicas:int,taskSlots:int>"
DEPLOYMENT_CONFIG = (
    "struct<namespace:string,image:string,flinkVersion:string,serviceAccount:string,"
    f"jobManager:{JOB_MANAGER},taskManager:{TASK_MANAGER},flinkConfiguration:map<string,string>>"
)
DEPLOYMENTS_DDL = (
    "id bigint, deployment_name string, namespace string, status string, "
    f"config {DEPLOYMENT_CONFIG}, resources array<{RESOURCE}>, error_message string, "
    "deployment_mode string, jar_id bigint, environment_variables map<string,string>, job_parallelism int, "
    "pending_action string, state_bucket_name string, last_savepoint_path string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
)
SAVEPOINTS_DDL = (
    "id bigint, deployment_id bigint, path string, source string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
)
JARS_DDL = (
    "id bigint, name string, object_name string, size_bytes bigint, uploaded_by bigint, entry_class string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
)
DEFAULTS_DDL = (
    "id bigint, image string, flink_version string, service_account string, namespace string, "
    "job_manager_memory string, job_manager_cpu decimal(4,2), job_manager_replicas int, "
    "task_manager_memory string, task_manager_cpu decimal(4,2), task_manager_replicas int, task_manager_slots int"
)

# Cluster snapshots (JSON documents). Fields declared STRING keep nested JSON objects as text.
CONDITION = "struct<type:string,status:string,reason:string,message:string,lastTransitionTime:string>"
CR_DDL = (
    "metadata struct<name:string, namespace:string>, spec struct<job:struct<state:string>>, "
    "status struct<lifecycleState:string, jobManagerDeploymentStatus:string, "
    f"jobStatus:string, error:string, conditions:array<{CONDITION}>>"
)
#: The fields of ``jobStatus`` that rules read; its whole text stays searchable.
JOB_STATUS_DDL = "state string, upgradeSavepointPath string, savepointInfo struct<savepointHistory:array<string>>"
CONTAINER = "struct<name:string,ready:boolean,restartCount:int,state:string,lastState:string>"
POD_DDL = (
    "metadata struct<name:string, namespace:string, labels:map<string,string>>, spec struct<nodeName:string>, "
    f"status struct<phase:string, reason:string, startTime:string, containerStatuses:array<{CONTAINER}>>"
)
EVENT_DDL = (
    "reason string, message string, type string, involvedObject struct<kind:string,name:string,namespace:string>, "
    "firstTimestamp string, lastTimestamp string, eventTime string, count int"
)
SNAPSHOT_DDL = (
    "metadata struct<name:string, namespace:string, creationTimestamp:string, labels:map<string,string>>, "
    "status struct<state:string, path:string, resultTimestamp:string, error:string>"
)
TRIGGERS_DDL = "deployment_name string, namespace string, trigger_ms bigint"

# Logs
LOG_STREAMS_DDL = "stream map<string,string>, `values` array<array<string>>"
LOGS_DDL = "app string, component string, namespace string, pod string, ts_ns bigint, line string"
ENVELOPE_DDL = "log string, stream string, time string"
JSON_LOG_DDL = "timeMillis bigint, level string, loggerName string, thread string, message string"

# Access events (rate-limit audit)
ACCESS_DDL = "source_key string, ts timestamp_ntz, kind string"
