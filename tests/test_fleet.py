"""Status mapping (exhaustive vs. an independent Python statement), error text, reconciliation fixtures."""

import itertools

from pyspark.sql import functions as F

from tidepool.functions import fleet as FL
from tidepool.operators import fleet as FO

LIFECYCLES = [None, "CREATED", "DEPLOYED", "STABLE", "RECONCILING", "SUSPENDED", "ROLLING_BACK", "DELETING", "FAILED", "FAILING"]
JOBS = [None, "RUNNING", "FINISHED", "FAILED", "FAILING", "CREATED", "RECONCILING", "CANCELED", "RESTARTING", "INITIALIZING"]
SPECS = [None, "running", "suspended"]
ERRORS = [None, "boom", '{"message":"Job Not Found"}', "Missing x"]
MODES = ["application", "session"]


def py_status(lc, job, spec, err, mode):
    if lc == "ROLLING_BACK":
        return "rolling_back"
    if lc == "DELETING":
        return "deleting"
    if lc == "FAILED":
        return "failed"
    if mode == "session":
        return "running" if lc in ("DEPLOYED", "STABLE") else "creating" if lc == "CREATED" else None
    if job == "RUNNING":
        return "running"
    if job == "FINISHED":
        return "suspended" if spec == "suspended" else "succeeded"
    if job == "FAILED" or lc == "FAILING":
        return "failed"
    if err:
        temp = "Job Not Found" in err or "Missing" in err
        starting = lc in ("CREATED", "DEPLOYED", "RECONCILING", None)
        return "creating" if temp and starting and job not in ("FAILED", "FAILING") else "failed"
    if lc == "SUSPENDED":
        return "suspended"
    if lc in ("CREATED", "DEPLOYED"):
        return "creating"
    return None


def test_resolve_status_exhaustive(spark):
    cases = list(itertools.product(LIFECYCLES, JOBS, SPECS, ERRORS, MODES))
    df = spark.createDataFrame(cases, "lc string, job string, spec string, err string, mode string")
    out = df.select("*", FL.resolve_status(F.col("lc"), F.col("job"), F.col("spec"), F.col("err"), F.col("mode")).alias("s")).collect()
    assert len(out) == len(cases)
    for r in out:
        assert r["s"] == py_status(r["lc"], r["job"], r["spec"], r["err"], r["mode"]), r


def test_error_message_shapes(spark):
    df = spark.createDataFrame([("org.apache.flink.SomeException: task crashed",), ("plain: text",),
                                ('{"message":"a.b.C: inner"}',), ('{"code":404}',), (None,)], "e string")
    got = [r[0] for r in df.select(FL.error_message(F.col("e"))).collect()]
    assert got == ["task crashed", "plain: text", "inner", '{"code":404}', None]


REG = ("id long, deployment_name string, namespace string, status string, deployment_mode string, pending_action string, "
       "error_message string, last_savepoint_path string, created_at timestamp_ntz")
ST = ("name string, namespace string, lifecycle_state string, jm_status string, job_state string, spec_job_state string, "
      "error string, upgrade_path string, n_history int")


def _reconcile(spark, reg_rows, st_rows):
    reg = spark.createDataFrame(reg_rows, REG)
    st = spark.createDataFrame(st_rows, ST)
    return {r["id"]: r for r in FO.reconcile(reg, st).collect()}


def test_reconcile_fixtures(spark):
    reg = [
        (1, "gone", "default", "suspended", "application", None, None, None, None),
        (2, "stop-done", "default", "running", "application", "stop", None, None, None),
        (3, "resume-done", "default", "suspended", "application", "resume", None, None, None),
        (4, "crashed", "default", "running", "application", "stop", None, None, None),
        (5, "in-flight", "default", "running", "application", "stop", None, None, None),
        (6, "sync", "default", "creating", "application", None, None, None, None),
        (7, "force", "default", "running", "application", "force_stop", None, None, None),
        (8, "dead", "default", "deleted", "application", None, None, None, None),
    ]
    st = [
        ("stop-done", "default", "STABLE", "READY", "FINISHED", "suspended", None, "sp-1", 0),
        ("resume-done", "default", "STABLE", "READY", "RUNNING", "running", None, None, 0),
        ("crashed", "default", "FAILED", "READY", "FAILED", "running", "org.apache.flink.SomeException: task crashed", None, 0),
        ("in-flight", "default", "STABLE", "READY", "RUNNING", "suspended", None, None, 0),
        ("sync", "default", "STABLE", "READY", "RUNNING", "running", None, None, 0),
        ("force", "default", "STABLE", "READY", "FINISHED", "suspended", None, "leftover", 0),
    ]
    r = _reconcile(spark, reg, st)
    assert r[1]["status"] == "deleted" and r[1]["error_message"] is None
    assert (r[2]["status"], r[2]["pending_action"], r[2]["last_savepoint_path"], r[2]["captured_savepoint"]) == ("suspended", None, "sp-1", "sp-1")
    assert (r[3]["status"], r[3]["pending_action"]) == ("running", None)
    assert (r[4]["status"], r[4]["error_message"]) == ("failed", "task crashed")
    assert (r[5]["status"], r[5]["pending_action"]) == ("running", "stop")
    assert r[6]["status"] == "running"
    assert (r[7]["status"], r[7]["last_savepoint_path"]) == ("suspended", None)
    assert r[8]["status"] == "deleted" and r[8]["action"] == "unchanged"


def test_page_is_clamped(spark):
    df = spark.range(0, 31).select("id")
    rows = lambda p, **k: [(r["id"], r["position"], r["page"]) for r in FO.page_of(df, [F.col("id").desc()], p, 15, **k).collect()]
    assert rows(99) == [(0, 31, 3)] and rows(0) == [(30 - i, i + 1, 1) for i in range(15)] and rows(2, total=31)[0] == (15, 16, 2)
    assert FO.page_of(df.limit(0), [F.col("id")], 4).count() == 0


def test_tab_counts_with_odd_statuses(spark):
    df = spark.createDataFrame([("running",), ("running",), (None,), ("all",), ("other",)], "status string")
    got = {r["tab"]: r["count"] for r in FO.status_tab_counts(df).collect()}
    assert got["all"] == 5 and got["running"] == 2 and got["failed"] == 0
    assert {r["count"] for r in FO.status_tab_counts(df.limit(0)).collect()} == {0}
