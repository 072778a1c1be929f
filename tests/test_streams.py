"""Enrichment stream and continuity, continuous reconciliation under re-runs and partial polls, pod log times, file sources."""

import os
import re
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepool.operators import access as AC
from tidepool.operators import logs as L
from tidepool.session import list_names, scratch_path, shared_dir
from tidepool.sources import logs as LS
from tidepool.sources import registry as REG
from tidepool.sources import schemas as S
from tidepool.sources import cluster, topics
from tidepool.streaming import enrichment as EN
from tidepool.streaming import logs as SL
from tidepool.streaming import reconcile as RS


def _records(spark, lo, hi):
    return topics.generate_messages(spark.range(lo, hi).select(F.col("id").alias("i"))).select(
        F.col("i").alias("id"), topics.encode_message(F.col("message")).alias("value"))


def test_fresh_checkpoint_repeats_and_once_each_does_not(spark):
    base = scratch_path(spark, "test-enrich")
    topics.write_topic(_records(spark, 0, 50), f"{base}/topic")
    EN.start(spark, f"{base}/topic", f"{base}/out", f"{base}/ckpt-0").awaitTermination()
    topics.write_topic(_records(spark, 50, 80), f"{base}/topic")
    EN.start(spark, f"{base}/topic", f"{base}/out", f"{base}/ckpt-1", run=1).awaitTermination()
    sink = EN.read_sink(spark, f"{base}/out")
    assert sink.count() == 130 and EN.once_each(sink).count() == 80
    sent = _records(spark, 0, 80).select(topics.decode_json(F.col("value")).alias("r")).select("r.message")
    assert EN.continuity_audit(sent, EN.once_each(sink)).where("status <> 'ok'").count() == 0
    assert EN.continuity_audit(sent, sink).where("status = 'duplicated'").count() == 50


def test_rerun_batch_overwrites_its_output(spark):
    base = scratch_path(spark, "test-enrich")
    topics.write_topic(_records(spark, 0, 20), f"{base}/topic")
    # a batch written before the query could commit it
    spark.range(5).select(F.col("id").cast("string").alias("key")).write.parquet(f"{base}/out/run=0/batch=0")
    EN.start(spark, f"{base}/topic", f"{base}/out", f"{base}/ckpt").awaitTermination()
    assert EN.read_sink(spark, f"{base}/out").count() == 20


REGISTRY = "id long, deployment_name string, namespace string, status string, deployment_mode string, pending_action string, error_message string, last_savepoint_path string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
OLD, NEW = datetime(1970, 1, 1), datetime(2100, 1, 1)


def _registry(spark, rows):
    return spark.createDataFrame([(i, f"d{i}", "default", st, "application", pend, None, None, OLD, at, None) for i, st, pend, at in rows], REGISTRY)


def _doc(i, state="RUNNING", spec="running", path=None):
    more = f', "upgradeSavepointPath": "{path}"' if path else ""
    return f'{{"metadata":{{"name":"d{i}","namespace":"default"}},"spec":{{"job":{{"state":"{spec}"}}}},"status":{{"lifecycleState":"STABLE","jobStatus":{{"state":"{state}"{more}}}}}}}'


def _status(spark, reg, base):
    return {r["id"]: (r["status"], r["pending_action"]) for r in RS.current(reg, RS.changes(spark, base)).collect()}


def _poll(spark, base, at, docs, n=None, last=True):
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    RS.write_poll(frame, f"{base}/in", at, len(docs) if n is None else n, last)


def _pass(spark, base, reg):
    return RS.reconcile_stream(spark, lambda: reg, f"{base}/in", base)


def test_partial_poll_waits_and_newest_complete_poll_wins(spark):
    base = scratch_path(spark, "test-rec")
    reg = _registry(spark, [(1, "creating", None, OLD), (2, "creating", None, OLD), (3, "running", "stop", OLD)])
    _poll(spark, base, 1000, [_doc(1), _doc(2)], 3)  # one document is missing
    assert _pass(spark, base, reg) == []
    _poll(spark, base, 1000, [_doc(1), _doc(2)], 3)  # the same two again are still two
    assert _pass(spark, base, reg) == []
    assert _status(spark, reg, base) == {1: ("creating", None), 2: ("creating", None), 3: ("running", "stop")}
    # the rest of poll 1 with poll 2, which lacks d2: only poll 2 counts
    _poll(spark, base, 1000, [_doc(3)], 3, last=False)
    _poll(spark, base, 2000, [_doc(1), _doc(3, "FINISHED", "suspended", "s3://sp")])
    assert _pass(spark, base, reg) == [(2000, 0)]
    assert _status(spark, reg, base) == {1: ("running", None), 2: ("deleted", None), 3: ("suspended", None)}
    known = spark.createDataFrame([], "deployment_id long, path string")
    assert [(r["deployment_id"], r["path"], r["source"]) for r in RS.savepoints(spark, base, known).collect()] == [(3, "s3://sp", "stop")]
    assert RS.savepoints(spark, base, spark.createDataFrame([(3, "s3://sp")], known.schema)).count() == 0
    # a user's newer edit and a new deployment come in from the registry
    edited = _registry(spark, [(1, "running", "stop", NEW), (2, "creating", None, OLD), (3, "running", "stop", OLD), (4, "creating", None, NEW)])
    _poll(spark, base, 3000, [_doc(1), _doc(4)])
    assert _pass(spark, base, edited) == [(3000, 1)]
    got = _status(spark, edited, base)
    assert got[1] == ("running", "stop") and got[2] == ("deleted", None)


def test_empty_listing_deletes_what_was_left(spark):
    base = scratch_path(spark, "test-rec")
    reg = _registry(spark, [(1, "running", None, OLD), (2, "running", "delete", OLD), (3, "running", "stop", OLD)])
    _poll(spark, base, 1000, [])
    assert _pass(spark, base, reg) == [(1000, 1)]
    assert _status(spark, reg, base) == {1: ("deleted", None), 2: ("deleted", None), 3: ("running", "stop")}


def test_an_older_poll_that_completes_late_is_superseded(spark):
    base = scratch_path(spark, "test-rec")
    reg = _registry(spark, [(1, "running", None, OLD)])
    _poll(spark, base, 1000, [], 1)
    _poll(spark, base, 2000, [_doc(1)])  # changes nothing, and still is the newest
    assert _pass(spark, base, reg) == [(2000, 0)]
    _poll(spark, base, 1000, [_doc(1, "FAILED")], 1, last=False)
    assert _pass(spark, base, reg) == []
    assert _status(spark, reg, base) == {1: ("running", None)}


def test_rerun_batch_gives_the_same_state(spark):
    base = scratch_path(spark, "test-rec")
    reg = _registry(spark, [(1, "creating", None, OLD), (2, "running", "stop", OLD)])
    _poll(spark, base, 1000, [_doc(1), _doc(2)])
    _poll(spark, base, 2000, [_doc(1, "FINISHED", "suspended"), _doc(2, "FINISHED", "suspended", "s3://x")])
    counts = lambda t: spark.createDataFrame([(t, 2, 2)], "poll_ms long, n long, n_docs long")
    for n, at in ((0, 1000), (1, 2000), (1, 2000), (0, 1000)):
        RS.apply_poll(spark, lambda: reg, counts(at), n, f"{base}/in", base)
        if n == 1:
            assert _status(spark, reg, base) == {1: ("suspended", None), 2: ("suspended", None)}
    assert RS.savepoints(spark, base, spark.createDataFrame([], "deployment_id long, path string")).count() == 1


def test_watch_ends_by_itself(spark):
    base, polled = scratch_path(spark, "test-rec"), []
    reg = _registry(spark, [(1, "creating", None, OLD), (2, "running", "stop", OLD)])

    def poll(n):
        polled.append(n)
        up = [_doc(1, "RUNNING" if n > 0 else "RECONCILING")]
        if n == 2:
            _poll(spark, base, 1000 + n, up, 2)  # never complete: says nothing
        else:
            _poll(spark, base, 1000 + n, [*up, _doc(2, "FINISHED" if n > 2 else "RUNNING", "suspended")])

    assert RS.watch(spark, lambda: reg, poll, f"{base}/in", base, every=0) == [(1000, 2), (1001, 1), (1003, 0)]
    assert polled == [0, 1, 2, 3]
    other = scratch_path(spark, "test-rec")
    assert RS.watch(spark, lambda: reg, lambda n: _poll(spark, other, 1000 + n, [_doc(2)]), f"{other}/in", other, every=0, most=2) == [(1000, 1), (1001, 1)]


def test_rfc3339_times(spark):
    rows = [("2024-01-01T00:00:00.123456789Z", 1704067200123456789), ("2024-01-01T00:00:00Z", 1704067200 * 10**9), ("2024-01-01T02:00:00.5+02:00", 1704067200500000000),
            ("yesterday", None), ("", None), (None, None), ("2024-13-01T00:00:00Z", None)]
    df = spark.createDataFrame(rows, "t string, ns long").select("ns", LS.rfc3339_ns(F.col("t")).alias("got"))
    assert all(r["ns"] == r["got"] for r in df.collect())


def test_envelope_round_trip_skips_broken_lines(spark):
    lines = spark.createDataFrame([("default", "p-1", "u", 1704067200000000001, "a"), ("default", "p-1", "u", 1704067200000000000, "b")], "namespace string, pod string, pod_uid string, ts_ns long, line string")
    env = LS.envelope_lines(lines).select("value", F.lit("/x/default_p-1_uidu/flink-main-container/0.log").alias("file_path"))
    broken = spark.createDataFrame([("{not json",), ('{"log":"x"}',), ('{"log":"x","time":"1704067200"}',)], "value string").withColumn("file_path", F.lit("/x/default_p-1_uidu/flink-main-container/0.log"))
    got = sorted((r["ts_ns"], r["line"]) for r in LS.parse_pod_log_lines(env.unionByName(broken)).collect())
    assert got == [(1704067200000000000, "b"), (1704067200000000001, "a")]


def test_look_back_is_five_minutes(spark):
    base, now = scratch_path(spark, "test-tail"), 10**18
    line = "2024-01-01 00:00:00,000 ERROR org.X - boom"
    at = [now - L.LOOKBACK_NS - 1, now - L.LOOKBACK_NS, now - 1]
    lines = spark.createDataFrame([("job-7", "taskmanager", "default", "p", t, line) for t in at], S.LOGS_DDL)
    lines.withColumn("log_date", SL.log_date(F.col("ts_ns"))).write.partitionBy("log_date").parquet(f"{base}/store")
    q = L.LogQuery(app="job-7", levels=["error"])
    live = L.apply_predicates(lines.limit(1).withColumn("ts_ns", F.lit(now)), q).withColumn("ts_ms", F.col("ts_ns") / F.lit(1e6))
    assert sorted(r["ts_ns"] for r in SL.backfill_then_tail(spark, f"{base}/store", live, q, now).collect()) == [*at[1:], now]


def test_registry_tables_are_projected(spark):
    base = scratch_path(spark, "test-reg")
    spark.createDataFrame([(1, 2, "p", "stop", "x")], "id long, deployment_id long, path string, source string, more string").write.parquet(base)
    got = REG.read_registry_table(spark, S.SAVEPOINTS_DDL, base)
    assert got.columns == ["id", "deployment_id", "path", "source", "created_at", "updated_at", "deleted_at"] and got.first()["path"] == "p"


def test_shared_folder_is_required_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_window_counts_close_behind_the_watermark(spark):
    base = scratch_path(spark, "test-access")
    t = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    rows = [("a", t(0, i), "login") for i in range(7)] + [("a", t(2), "login"), ("b", t(1), "register"), (None, datetime(2024, 1, 1, 9), "login")]
    spark.createDataFrame(rows, "source_key string, ts timestamp, kind string").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("source_key string, ts timestamp, kind string").parquet(f"{base}/in")
    AC.window_counts(stream, AC.LIMITS[0]).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["source_key"], r["attempts"], r["rejected"]) for r in spark.read.parquet(f"{base}/out").collect()) == [("a", 1, 0), ("a", 7, 2)]


def _attempts(spark, rows):
    return spark.createDataFrame([(k, t, kind, i) for i, (k, t, kind) in enumerate(rows)], "source_key string, ts timestamp_ntz, kind string, event_id long")


def test_hot_window_is_cut_by_seconds(spark):
    """A third of all attempts in one window, most in one second: those beyond the limit, and the plan ranks one second only."""
    rows = [("hot", datetime(2024, 1, 1, 0, 0, i % 60 if i < 4 else 30, i % 1000), "login") for i in range(3000)]
    rows += [(f"k{i % 900}", datetime(2024, 1, 1, 0, i % 50, i % 7), ("login", "register")[i % 2]) for i in range(6000)] + [(None, datetime(2024, 1, 1), "register")] * 12 + [("k", None, "login")] * 9 + [("k", datetime(2024, 1, 1), "other")] * 9
    want, used = [], {}
    for i, (k, t, kind) in sorted(enumerate(rows), key=lambda r: (r[1][1] is None, r[1][1] or OLD, r[0])):
        lim = {"login": (2, 5), "register": (60, 10)}.get(kind)
        if lim and t is not None:
            w = (k, kind, t.minute // lim[0])
            used[w] = used.get(w, 0) + 1
            if used[w] > lim[1]:
                want.append(i)
    df = AC.over_limit(_attempts(spark, rows).repartition(5))
    assert sorted(r["event_id"] for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1 and "CartesianProduct" not in plan


def test_rejections_stream_in_order(spark):
    base = scratch_path(spark, "test-access")
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    first = [("a", t(i), "login") for i in range(7)] + [("b", t(5), "register")]
    later = [("a", t(100), "login"), ("a", t(121), "login"), ("a", t(3700), "login"), ("b", t(3720), "register")]
    late = [("a", t(101), "login"), ("a", t(3721), "login")]  # the first one's window is behind the watermark by now
    got, schema = [], _attempts(spark, []).schema
    for n, rows in enumerate((first, later, late)):
        _attempts(spark, rows).withColumn("event_id", F.col("event_id") + n * 100).write.mode("append").parquet(f"{base}/in")
        AC.rejections(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(r["event_id"] for r in spark.read.schema("event_id long").parquet(f"{base}/out").collect()))
    assert got == [[5, 6], [5, 6, 100], [5, 6, 100]]


def test_redelivered_records_are_taken_once(spark):
    base = scratch_path(spark, "test-once")
    rows = spark.range(60).select("id", F.col("id").cast("string").alias("value"), (F.col("id") % 3).alias("partition"), F.floor(F.col("id") / 3).alias("offset"), (F.col("id") * 1000 + 10**12).alias("timestamp"))
    for part in (rows.where("id < 40"), rows.where("id >= 30"), rows):
        topics.write_topic(part, f"{base}/topic")
        topics.once(topics.read_topic_stream(spark, path=f"{base}/topic")).select("key", "topic", "partition", "offset").writeStream.format("parquet").option("path", f"{base}/out") \
            .option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(int(r["key"]) for r in spark.read.parquet(f"{base}/out").collect()) == list(range(60))


@pytest.mark.parametrize(("n", "interval"), [(0, 0.01), (1, 0.01), (250, 0.01)])
def test_generator_stream_equals_batch(spark, n, interval):
    base = scratch_path(spark, "test-gen")
    topics.generate_count(spark, n, f"{base}/out", f"{base}/c", interval, every="300 milliseconds")
    got = spark.read.schema("i long, message string, partition int").parquet(f"{base}/out") if n else spark.createDataFrame([], "i long, message string, partition int")
    want = topics.generate_messages(spark.range(n).select(F.col("id").alias("i")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_generator_is_endless_and_slow_on_request(spark):
    with pytest.raises(ValueError):
        topics.generator_stream(spark, 0)
    assert topics.generator_stream(spark, 3.0).isStreaming


def test_expired_days_are_dropped_whole(spark):
    base, day = scratch_path(spark, "test-retention"), 86_400 * 10**9
    lines = spark.createDataFrame([("job-1", "jobmanager", "default", "p", t * day // 2, f"{t}") for t in range(20)], S.LOGS_DDL)
    SL.frames_of(lines).write.text(f"{base}/frames")
    SL.store_logs(SL.read_tail(spark, f"{base}/frames"), f"{base}/store", f"{base}/c")
    now = SL.RETENTION_HOURS * 3600 * 10**9 + 3 * day + day // 2  # the cut-off is the noon of the fourth day
    seen = SL.read_log_store(spark, f"{base}/store", now_ns=now, retention=True)
    assert sorted(int(r["line"]) for r in seen.collect()) == list(range(7, 20))
    assert re.search(r"PartitionFilters: \[.*log_date.*>=", seen._jdf.queryExecution().executedPlan().toString())
    assert SL.expire(spark, f"{base}/store", now) == ["1970-01-01", "1970-01-02", "1970-01-03"]
    assert sorted(int(r["line"]) for r in SL.read_log_store(spark, f"{base}/store").collect()) == list(range(6, 20))
    assert SL.expire(spark, f"{base}/store", now) == []


def test_missing_store_gives_a_warning_and_the_tail(spark):
    now, q = 10**18, L.LogQuery(app="job-7", levels=["error"])
    line = "2024-01-01 00:00:00,000 ERROR org.X - boom"
    lines = spark.createDataFrame([("job-7", "taskmanager", "default", "p", now + 5, line)], S.LOGS_DDL)
    live = L.apply_predicates(lines, q).withColumn("ts_ms", F.col("ts_ns") / F.lit(1e6))
    got = SL.backfill_or_warn(spark, scratch_path(spark, "nowhere"), live, q, now)
    assert sorted((r["event"], r["line"]) for r in got.collect()) == [("line", line), ("warning", "History backfill unavailable")]
    assert got.columns == [*live.columns, "event"]


def test_snapshot_folder_stream(spark):
    base, ddl = scratch_path(spark, "test-docs"), "metadata struct<name:string, namespace:string>, status struct<state:string>"
    doc = lambda n, s: f'{{"metadata":{{"name":"{n}","namespace":"x"}},"status":{{"state":"{s}"}}}}'
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cluster.watch_documents(spark, f"{base}/none", ddl)
    for at, texts in ((2000, [doc("a", "new"), doc("b", "b2"), "{broken"]), (1000, [doc("a", "old"), doc("c", "c1"), '{"metadata":{}}', "{x"])):  # the older listing comes later
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(f"{base}/in/poll_ms={at}")
        cluster.follow_documents(spark, f"{base}/in", ddl, f"{base}/out", f"{base}/c")
    got = cluster.followed_documents(spark, f"{base}/out", ddl).select("metadata.name", "status.state", "poll_ms").collect()
    assert sorted(map(tuple, got)) == [("a", "new", 2000), ("b", "b2", 2000), ("c", "c1", 1000)]
    assert sorted((r["poll_ms"], r["n"]) for r in cluster.corrupt_files(spark, f"{base}/out").collect()) == [(1000, 2), (2000, 1)]


def test_local_session_without_a_folder_gets_one(tmp_path):
    """In a process of its own, without the machine's defaults: a session that names no checkpoint folder."""
    code = ("from pyspark.sql import SparkSession; from tidepool.session import shared_dir, scratch_path\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert not s.conf.get('spark.checkpoint.dir', None)\n"
            "a = shared_dir(s); assert a and a == shared_dir(s) and scratch_path(s, 'x').startswith(a)\n"
            "from tidepool.session import clear_scratch, path_exists\n"
            "b = scratch_path(s, 'x'); clear_scratch(s); s.range(3).write.parquet(b); assert path_exists(s, b); clear_scratch(s); assert not path_exists(s, b) and path_exists(s, a)\n")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_deployment_runs_by_its_configuration(spark):
    base = scratch_path(spark, "test-conf")
    topics.write_topic(_records(spark, 0, 20), f"{base}/topic")
    conf = {"state.checkpoints.dir": "s3://flink-x/checkpoints", "execution.checkpointing.interval": "300"}
    q = EN.start_deployment(spark, f"{base}/topic", f"{base}/out", conf, storage=f"{base}/store")
    q.processAllAvailable()
    topics.write_topic(_records(spark, 20, 30), f"{base}/topic")
    q.processAllAvailable()
    q.stop()
    assert EN.read_sink(spark, f"{base}/out").count() == 30 and "offsets" in list_names(spark, f"{base}/store/flink-x/checkpoints")
    EN.start_deployment(spark, f"{base}/topic", f"{base}/out", conf, storage=f"{base}/store", every=None).awaitTermination()
    assert EN.read_sink(spark, f"{base}/out").count() == 30
