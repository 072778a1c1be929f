"""Logs (flatten, literal search, levels, newest lines), sizes, names, savepoint decisions, access limits."""

import math

from pyspark.sql import functions as F

from tidepool.functions import format as FM
from tidepool.operators import access as AC
from tidepool.operators import logs as L
from tidepool.operators import savepoints as SP


def test_flatten_and_sort(spark):
    s = spark.createDataFrame([({"app": "a"}, [["2000000000", "second line"], ["1000000000", "first line"]])],
                              "stream map<string,string>, `values` array<array<string>>")
    rows = L.flatten_streams(s).orderBy("ts_ns").collect()
    assert [r["ts_ms"] for r in rows] == [1000.0, 2000.0] and rows[0]["line"] == "first line"


def test_literal_search_and_levels(spark):
    lines = ['2024-01-01 00:00:00,000 WARN  org.X - inject" | line_format "pwned',
             "2024-01-01 00:00:01,000 ERROR org.X - boom", "\tat org.X.run(X.java:1)",
             "2024-01-01 00:00:02,000 INFO  org.X - fine"]
    df = spark.createDataFrame([("a", None, "p", i, t) for i, t in enumerate(lines)], "app string, component string, pod string, ts_ns long, line string")
    assert L.contains_text(df, 'inject" | line_format "pwned').count() == 1
    got = [r["line"] for r in L.level_filter(df, ["warn", "error"]).orderBy("ts_ns").collect()]
    assert got == lines[:2]
    q = L.LogQuery(app="a", levels=[], search=None, limit=2)
    assert [r["ts_ns"] for r in L.log_query(df, q).collect()] == [0, 1]


def test_newest_n(spark):
    rows = [(f"k{i % 3}" if i % 10 else None, (i * 7919) % 5000 * 10**9 if i % 11 else None, "p", str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "app string, ts_ns long, pod string, line string")
    for n, bucket in ((1, 10**9), (7, 100 * 10**9), (50, 10**15), (5000, 10**12)):
        got = sorted((r["app"] or "", r["rank_from_newest"], r["line"]) for r in L.newest_n(df, ["app"], n, bucket_ns=bucket).collect())
        want = []
        for k in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]), reverse=True)
            want += [(k or "", i + 1, r[3]) for i, r in enumerate(own[:n])]
        assert got == sorted(want)


def _format_bytes(b):
    if b == 0:
        return "0 B"
    i = min(5, int(math.floor(math.log(b) / math.log(1024) + 1e-12)))
    from decimal import ROUND_HALF_UP, Decimal

    v = (Decimal(b) / (Decimal(1024) ** i)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
    return f"{v.normalize():f} {['B', 'KB', 'MB', 'GB', 'TB', 'PB'][i]}"


def test_human_size(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1048575, 1048576, 1073741824, 5 * 1099511627776, 1126, 1 << 62, 3 * 2**49]
    df = spark.createDataFrame([(s,) for s in sizes], "b long")
    got = [r[0] for r in df.select(FM.human_size(F.col("b"))).collect()]
    assert got == [_format_bytes(s) for s in sizes]
    assert got[:4] == ["0 B", "1 B", "1023 B", "1 KB"]


def test_names(spark):
    df = spark.createDataFrame([("my-job", "my job (v2).jar"), ("a" * 63, "x")], "n string, f string")
    r = df.select(FM.state_location(F.col("n")).alias("s"), FM.safe_object_name(F.col("f"), F.lit("uuid")).alias("o")).collect()
    assert r[0]["s"] == "flink-my-job" and len(r[1]["s"]) <= 63
    assert r[0]["o"] == "uuid-my_job__v2_.jar"


SNAP = "metadata struct<name:string, namespace:string, creationTimestamp:string, labels:map<string,string>>, status struct<state:string, path:string, resultTimestamp:string, error:string>"


def _snap(name, created, state, path, result, error=None):
    labels = {"job-reference.name": "j", "snapshot.trigger-type": "MANUAL", "snapshot.type": "SAVEPOINT"}
    return ((name, "default", created, labels), (state, path, result, error))


def test_snapshot_candidates(spark):
    trig = 1767225600000  # 2026-01-01T00:00:00Z
    trig_df = spark.createDataFrame([("j", "default", trig)], "deployment_name string, namespace string, trigger_ms long")
    stale = spark.createDataFrame([_snap("old", "2025-12-31T23:59:00Z", "COMPLETED", "s3://bucket/stale", "2025-12-31T23:59:01Z")], SNAP)
    r = SP.snapshot_candidate(trig_df, stale).collect()[0]
    assert r["completed"] is False and r["last_savepoint_path"] is None
    fresh = spark.createDataFrame([_snap("old", "2025-12-31T23:59:00Z", "COMPLETED", "s3://bucket/stale", "2025-12-31T23:59:01Z"),
                                   _snap("new", "2026-01-01T00:00:01Z", "COMPLETED", "s3://bucket/fresh", "2026-01-01T00:00:02Z")], SNAP)
    r = SP.snapshot_candidate(trig_df, fresh).collect()[0]
    assert r["completed"] and r["last_savepoint_path"] == "s3://bucket/fresh" and r["result_ms"] == trig + 2000
    failed = spark.createDataFrame([_snap("f", "2026-01-01T00:00:01Z", "FAILED", None, None, "disk full")], SNAP)
    later = trig + 3_600_000
    o = SP.savepoint_outcome(trig_df, failed, later).collect()[0]
    assert o["outcome"] == "error" and o["reason"] == "disk full" and o["seen_ms"] == trig + 5000


def test_outcomes_follow_the_polls(spark):
    trig = 1767225600000  # 2026-01-01T00:00:00Z
    two = spark.createDataFrame([("j", "default", trig), ("j", "default", trig + 2_592_000_000)], "deployment_name string, namespace string, trigger_ms long")
    snaps = [_snap("a", "2026-01-01T00:00:01Z", "COMPLETED", "s3://a", "2026-01-01T00:00:42Z"), _snap("b", "2026-01-31T00:00:01Z", "COMPLETED", "s3://b", "2026-01-31T00:01:59Z")]
    run = lambda rows, now=trig + 10**10: sorted((r["trigger_ms"] - trig, r["outcome"], r["savepoint_path"], r["seen_ms"] and r["seen_ms"] - r["trigger_ms"])
                                                 for r in SP.savepoint_outcome(two, spark.createDataFrame(rows, SNAP), now).collect())
    assert run(snaps) == [(0, "success", "s3://a", 45000), (2_592_000_000, "success", "s3://b", 120000)]
    late = [_snap("a", "2026-01-01T00:00:01Z", "COMPLETED", "s3://a", "2026-01-01T00:02:01Z")]
    assert run(late)[0] == (0, "timed_out", None, None)
    assert run(late, trig + 119_000) == [(0, "pending", None, None)]
    # a newer snapshot hides an older one that is final only afterwards
    hidden = [snaps[0], _snap("c", "2026-01-01T00:00:30Z", "IN_PROGRESS", None, None)]
    assert run(hidden)[0] == (0, "timed_out", None, None)
    stale = [_snap("a", "2026-01-01T00:00:00Z", "COMPLETED", "s3://a", "2025-12-31T23:59:59Z")]
    assert run(stale)[0] == (0, "timed_out", None, None)


def test_resume_choices(spark):
    from datetime import datetime

    deps = spark.createDataFrame([(1, "d", "application", "suspended", None)],
                                 "id long, deployment_name string, deployment_mode string, status string, pending_action string")
    sps = spark.createDataFrame([(3, 1, "sp-3", datetime(2026, 1, 1)), (5, 1, "sp-5", datetime(2026, 1, 2))],
                                "id long, deployment_id long, path string, created_at timestamp_ntz")
    reqs = spark.createDataFrame([(1, "d", None, False), (2, "d", 5, False), (3, "d", 3, False), (4, "d", 999, False),
                                  (5, "d", None, True), (6, "d", 3, True), (7, "x", None, False)],
                                 "request_id long, deployment_name string, savepoint_id long, skip_savepoint boolean")
    got = {r["request_id"]: r["decision"] for r in SP.resume_source(reqs, deps, sps).collect()}
    assert got == {1: "latest", 2: "latest", 3: "path:sp-3", 4: "error:savepoint_not_found", 5: "stateless",
                   6: "error:both_savepoint_and_skip", 7: "error:deployment_not_found"}


def test_login_limit(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1, 0, 0, 0)
    rows = [("a", t0 + timedelta(seconds=i), "login", i) for i in range(7)] + [("b", t0, "login", 100)]
    df = spark.createDataFrame(rows, "source_key string, ts timestamp_ntz, kind string, event_id long")
    got = sorted(r["event_id"] for r in AC.over_limit(df).collect())
    assert got == [5, 6]
