"""Steps whose memory or work must not follow the number of windows, documents or names."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from tidepool.operators import access as AC
from tidepool.operators import actions as AN
from tidepool.operators import config_rules as CR
from tidepool.operators import diagnostics as D
from tidepool.operators import fleet as FO
from tidepool.operators import savepoints as SP
from tidepool.plans import q_streams as QS
from tidepool.session import list_names, scratch_path, shuffles_freed
from tidepool.sources import topics
from tidepool.sources.views import SPARK, VIEWS
from tidepool.streaming import enrichment as EN
from tidepool.streaming import reconcile as RS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _states(stream, mode, base):
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _n: batch.count()).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])


def test_one_state_covers_many_windows(spark):
    base = scratch_path(spark, "test-states")
    day = dt.datetime(2024, 1, 1)
    rows = [("k", day + dt.timedelta(seconds=10 * i), "login", i) for i in range(60)]  # five windows of twelve attempts
    spark.createDataFrame(rows, "source_key string, ts timestamp_ntz, kind string, event_id long").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("source_key string, ts timestamp_ntz, kind string, event_id long").parquet(f"{base}/in")
    assert _states(AC.rejections(stream), "append", base) == 1


def test_poll_state_has_one_row_a_poll(spark):
    base = scratch_path(spark, "test-states")
    docs = spark.createDataFrame([('{"metadata":{"name":"d%d","namespace":"n"}}' % i,) for i in range(20)], "doc string")
    RS.write_poll(docs, f"{base}/in", 1000, 20)
    assert all(n.endswith(".gz") for n in list_names(spark, f"{base}/in/poll_ms=1000") if n.startswith("part-"))
    raw = spark.readStream.schema("value string, poll_ms long").format("text").load(f"{base}/in")
    assert _states(RS.poll_counts(RS._records(raw)), "update", base) == 1


def test_pieces_begin_and_end_as_names_do(spark, monkeypatch):
    """Even when so many names are known that the filter lets everything through."""
    monkeypatch.setattr(D, "FILTER_BITS", 64)
    names = spark.createDataFrame([(f"job-{i}", "n") for i in range(2000)], "deployment_name string, namespace string")
    texts = spark.createDataFrame([(1, "n", "pod job-1234-taskmanager-1 on job-7")], "uid long, namespace string, t string")
    found = {r["cand"] for r in D.candidate_names(names, texts).collect()}
    assert found == {"job-1", "job-12", "job-123", "job-1234", "job-7"}
    short = spark.createDataFrame([("a", "n"), ("bc", "n")], "deployment_name string, namespace string")
    texts = spark.createDataFrame([(1, "n", "xa bc b")], "uid long, namespace string, t string")
    assert {"a", "bc"} <= {r["cand"] for r in D.candidate_names(short, texts).collect()}


def test_triggers_are_shuffled_once(spark):
    t = spark.createDataFrame([("j", "n", 1000), ("j", "n", 1000), (None, "n", 5)], "deployment_name string, namespace string, trigger_ms long")
    snaps = spark.createDataFrame([], "metadata struct<name:string,namespace:string,creationTimestamp:string,labels:map<string,string>>, status struct<state:string,path:string,resultTimestamp:string,error:string>")
    out = SP.snapshot_candidate(t, snaps)
    assert sorted((r["deployment_name"] or "", r["trigger_ms"]) for r in out.collect()) == [("", 5), ("j", 1000)]
    assert _plan(SP.snapshot_candidate(t, snaps)).count("Exchange hashpartitioning") <= 2


def test_savepoints_are_grouped_without_a_sort(spark):
    cols = VIEWS["v_savepoints"](SPARK)[0]
    rows = spark.createDataFrame([(1, 1, "R"), (1, 1, "A"), (2, 1, "R"), (2, 1, None), (3, 1, None), (4, 1, "S"), (4, 1, "R")], "l_orderkey long, l_linenumber long, l_returnflag string") \
        .withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz"))
    out = rows.groupBy(*cols.group_by).agg(*[F.expr(c) for c in cols.cols])
    assert {r["deployment_id"]: r["source"] for r in out.select("deployment_id", "source").collect()} == {1: "stop", 2: "manual", 3: "stop", 4: "manual"}
    assert "SortAggregate" not in _plan(out.select("deployment_id", "source"))


def test_rows_are_dealt_finely_before_they_are_held(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    assert [tuple(r) for r in CR.duplicate_keys("k", df, ["key"]).collect()] == [("k", "a", 2)]
    assert "REPARTITION_BY_NUM" in _plan(CR.duplicate_keys("k", df, ["key"])) and "REPARTITION_BY_NUM" in _plan(EN.once_each(df))
    assert EN.once_each(df).count() == 3


def test_an_event_is_dealt_once(spark):
    """Of the exchanges of a fold (not counting those read again), one holds the events, and none of those of long deployments or of savepoints is repeated."""
    events = spark.createDataFrame([(i, f"d{i % 5}", 3_600_000 * i, "resume" if i % 3 else "snapshot", 10 + i % 5 if i % 3 == 1 else None, False, "s3://x") for i in range(60)],
                                   "event_id long, deployment_name string, at_ms long, kind string, savepoint_id long, skip_savepoint boolean, path string")
    registry = spark.createDataFrame([(i, f"d{i}", "application", "failed", None) for i in range(4)], "id long, deployment_name string, deployment_mode string, status string, pending_action string")
    savepoints = spark.createDataFrame([(10 + i, i, "s3://p", dt.datetime(2024, 1, 1)) for i in range(4)], "id long, deployment_id long, path string, created_at timestamp_ntz")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for whole, most in ((AN.WHOLE, 6), (5, 11)):
            df = AN.fold_actions(events, registry, savepoints, whole)
            assert len(df.collect()) == 60
            plan = _plan(df).split("== Initial Plan ==")[0]
            assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_topic_and_sink_files_are_compressed(spark, monkeypatch):
    base = scratch_path(spark, "test-files")
    monkeypatch.setattr(topics, "FILE_RECORDS", 10)
    rows = spark.range(0, 25, 1, 1).select("id", topics.encode_message(F.concat(F.lit("m-"), F.col("id").cast("string"))).alias("value"))
    topics.write_topic(rows, f"{base}/topic")
    parts = [n for n in list_names(spark, f"{base}/topic") if n.startswith("part-")]
    assert len(parts) == 3 and all(n.endswith(".gz") for n in parts)
    EN.start(spark, f"{base}/topic", f"{base}/out", f"{base}/c").awaitTermination()
    assert all(".zstd." in n for n in list_names(spark, f"{base}/out/run=0/batch=0") if n.startswith("part-"))
    assert sorted((r["key"], r["message_upper"]) for r in EN.read_sink(spark, f"{base}/out").collect()) == sorted((str(i), f"M-{i}") for i in range(25))


def test_copies_are_dealt_once(spark):
    """One of each record, its copies and its runs from one exchange, and a key that is null counts like others."""
    rows = [("1", "a", 0), ("1", "a", 1), ("1", "a", 1), ("2", "b", 1), (None, "c", 0), (None, "c", 1)]
    df = spark.createDataFrame([(k, m, run, 0) for k, m, run in rows], "key string, message string, run int, batch int")
    out = EN.emissions(df)
    assert out.columns == ["key", "message", "copies", "runs"]
    assert {tuple(r) for r in out.collect()} == {("1", "a", 3, 2), ("2", "b", 1, 1), (None, "c", 2, 2)}
    assert _plan(EN.emissions(df)).count("Exchange") == 1


def test_a_restarted_stream_has_no_join(spark, monkeypatch):
    base = scratch_path(spark, "test-restart")
    records = spark.range(40).select("id", topics.encode_message(F.concat(F.lit("m-"), F.col("id").cast("string"))).alias("value"))
    monkeypatch.setattr(QS, "_topic_parts", lambda spark, sf: [records.where(F.col("id") % 3 == i) for i in range(3)])
    monkeypatch.setattr(QS, "scratch_path", lambda spark, kind: f"{base}/{kind}")
    out = QS.restarted_stream(spark, "")
    assert sorted((r["id"], r["message_upper"], r["copies"], r["runs"]) for r in out.collect()) == [(i, f"M-{i}", 2, 2) for i in range(40)]
    assert "Join" not in _plan(out)


def _doc(i, state="RUNNING"):
    return '{"metadata":{"name":"d%d","namespace":"n"},"status":{"jobStatus":{"state":"%s"}}}' % (i, state)


def test_documents_of_a_poll_are_parsed_once(spark, monkeypatch):
    """Also below a join, whose condition on names would else be moved to the scan and parse every document again."""
    base = scratch_path(spark, "test-parse")
    monkeypatch.setattr(RS, "FILE_RECORDS", 8)
    texts = [_doc(i) for i in range(20)] + [_doc(3), '{"metadata":{"namespace":"n"}}', "{}"]
    RS.write_poll(spark.createDataFrame([(t,) for t in texts], "doc string").coalesce(1), f"{base}/in", 1000, 20)
    assert len([n for n in list_names(spark, f"{base}/in/poll_ms=1000") if n.startswith("part-")]) == 4
    docs = RS._arrived(spark, f"{base}/in", 1000)
    names = RS.poll_names(docs)
    status = RS.poll_status(docs)
    assert names.agg(F.count("name")).first()[0] == 20 and _plan(names).count("from_json(") == 2
    assert {r["name"]: r["job_state"] for r in status.where("name is not null").collect()} == {f"d{i}": "RUNNING" for i in range(20)}
    registry = spark.createDataFrame([("d1", "n"), ("gone", "n")], "deployment_name string, namespace string")
    joined = FO.with_snapshot(registry, status)
    assert _plan(joined).count("from_json(") == 3  # the record, its document and the text of its job's status
    assert {r["deployment_name"]: r["has_cr"] for r in joined.collect()} == {"d1": True, "gone": False}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_poll_state_has_few_parts(spark, monkeypatch):
    """However many shuffle partitions the session has; the tables of a pass keep those, and its shuffles go when it ends."""
    base = scratch_path(spark, "test-parts")
    registry = spark.createDataFrame([(1, "d1", "n", "creating", "application", None, None, None, None, None, None)],
                                     "id long, deployment_name string, namespace string, status string, deployment_mode string, pending_action string, error_message string, last_savepoint_path string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")
    RS.write_poll(spark.createDataFrame([(_doc(1),)], "doc string"), f"{base}/in", 1000, 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    freed = []
    monkeypatch.setattr(RS, "apply_poll", lambda spark, *a, f=RS.apply_poll: freed.append(spark.conf.get(CLEANUP)) or f(spark, *a))
    assert RS.reconcile_stream(spark, lambda: registry, f"{base}/in", base) == [(1000, 0)]
    assert len([n for n in list_names(spark, f"{base}/ckpt/state/0") if n.isdigit()]) == RS.STATE_PARTS < int(before) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(freed) == {"true"} and spark.conf.get(CLEANUP) == "false"


def test_shuffle_files_go_with_their_query(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    data = lambda: {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}
    kept = data()
    with shuffles_freed(spark):
        assert spark.range(1000).select((F.col("id") % 7).alias("k")).distinct().agg(F.count("k")).first()[0] == 7
    until = time.time() + 20
    while data() - kept and time.time() < until:
        time.sleep(0.2)
    assert not data() - kept


def test_polls_are_filtered_by_the_name_of_the_view(spark):
    docs, _, _ = QS._polled(spark, "/root/testdata/sf0.001")
    assert docs.columns == ["doc", "name"] and "get_json_object" not in _plan(docs.where("length(name) % 2 = 0"))
    assert docs.where("NOT name <=> get_json_object(doc, '$.metadata.name')").count() == 0
