"""Column functions of fleet-state reconciliation (status mapping, error text, tones, guards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Application statuses, modes and pending actions.
RUNNING, SUSPENDED, FAILED, SUCCEEDED = "running", "suspended", "failed", "succeeded"
CREATING, DELETING, DELETED, ROLLING_BACK, UNKNOWN = "creating", "deleting", "deleted", "rolling_back", "unknown"
APPLICATION, SESSION = "application", "session"
TRANSITIONING = [CREATING, ROLLING_BACK, DELETING, UNKNOWN]

# Markers of a temporarily missing job in an operator error.
TEMPORARY_ERROR_MARKERS = ["Job Not Found", "Missing"]


def _eq(c: Column, v: str) -> Column:
    """Strict equality with NULL treated as 'not equal' (JavaScript ===)."""
    return F.coalesce(c == F.lit(v), F.lit(False))


def _in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def resolve_status(lifecycle: Column, job_state: Column, spec_state: Column, error: Column, mode: Column) -> Column:
    """Map an operator snapshot to an application status, or NULL when inconclusive.

    Rules apply in order; the first one that fires wins. ``error`` is the raw error
    text (plain string or JSON object text); ``lifecycle`` etc. are NULL when absent.
    """
    starting = lifecycle.isNull() | _in(lifecycle, ["CREATED", "DEPLOYED", "RECONCILING"])
    not_failed = ~_in(job_state, ["FAILED", "FAILING"])
    temporary = F.lit(False)
    for marker in TEMPORARY_ERROR_MARKERS:
        temporary = temporary | F.coalesce(error.contains(marker), F.lit(False))
    return (
        F.when(_eq(lifecycle, "ROLLING_BACK"), ROLLING_BACK)
        .when(_eq(lifecycle, "DELETING"), DELETING)
        .when(_eq(lifecycle, "FAILED"), FAILED)
        .when(_eq(mode, SESSION), F.when(_in(lifecycle, ["DEPLOYED", "STABLE"]), RUNNING).when(_eq(lifecycle, "CREATED"), CREATING))
        .when(_eq(job_state, "RUNNING"), RUNNING)
        .when(_eq(job_state, "FINISHED"), F.when(_eq(spec_state, "suspended"), SUSPENDED).otherwise(SUCCEEDED))
        .when(_eq(job_state, "FAILED") | _eq(lifecycle, "FAILING"), FAILED)
        .when(error.isNotNull(), F.when(temporary & starting & not_failed, CREATING).otherwise(FAILED))
        .when(_eq(lifecycle, "SUSPENDED"), SUSPENDED)
        .when(_in(lifecycle, ["CREATED", "DEPLOYED"]), CREATING)
    )


def _strip_class_prefix(msg: Column) -> Column:
    """'a.b.Cls: text' -> 'text' when the part before the first ': ' contains a dot."""
    idx = F.locate(": ", msg)
    head = F.substring_index(msg, ": ", 1)
    return F.when((idx > 1) & head.contains("."), msg.substr(idx + 2, F.lit(1 << 30))).otherwise(msg)


def error_message(error: Column) -> Column:
    """User-facing error text of an operator error (plain string or JSON object text)."""
    is_object = error.startswith("{") & F.get_json_object(error, "$").isNotNull()
    inner = F.get_json_object(error, "$.message")
    return (
        F.when(error.isNull() | (error == ""), F.lit(None).cast("string"))
        .when(is_object & inner.isNotNull() & (inner != ""), _strip_class_prefix(inner))
        .when(is_object, error)
        .otherwise(_strip_class_prefix(error))
    )


# Tone classes of lifecycle, job-manager and job states.
LIFECYCLE_TONES = {"success": ["STABLE", "DEPLOYED"], "warning": ["CREATED", "RECONCILING"], "danger": ["FAILED", "ROLLING_BACK"]}
JOB_MANAGER_TONES = {"success": ["READY"], "warning": ["DEPLOYING"], "danger": ["ERROR", "MISSING"]}
JOB_TONES = {
    "success": ["RUNNING", "FINISHED"],
    "warning": ["CREATED", "INITIALIZING", "RESTARTING", "RECONCILING"],
    "danger": ["FAILED", "FAILING", "CANCELED"],
}


def tone(c: Column, table: dict[str, list[str]]) -> Column:
    out = None
    for name, values in table.items():
        out = (F.when if out is None else out.when)(_in(c, values), name)
    return out.otherwise("neutral")


def dashboard_available(n_resources: Column, jm_status: Column) -> Column:
    return F.coalesce(n_resources > 0, F.lit(False)) & _eq(jm_status, "READY")


def in_transition(status: Column, pending: Column) -> Column:
    return _in(status, TRANSITIONING) | (F.coalesce(pending, F.lit("")) != "")


def container_state(state_json: Column) -> Column:
    """Label of a container state object: Running / Waiting / Terminated / Unknown, checked in that order.

    A key counts by being there, also with a null value.
    """
    keys = F.json_object_keys(state_json)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return (
        F.when(state_json.isNull(), "Unknown")
        .when(has("running"), "Running")
        .when(has("waiting"), "Waiting")
        .when(has("terminated"), "Terminated")
        .otherwise("Unknown")
    )
