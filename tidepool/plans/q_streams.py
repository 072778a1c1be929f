"""Streaming queries (A1, A10, A11a-d, A13, B1, B9, B10, B14, C8, H1 twin) and the file sources.

Each callable writes its input files under a fresh folder of the shared checkpoint
folder, runs the stream to completion, and returns the sink as a table; the oracle is
the batch statement of the same computation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as AC
from ..operators import config_rules as CR
from ..operators import fleet as FO
from ..operators import logs as L
from ..session import scratch_path
from ..sources import cluster, topics
from ..sources import logs as LS
from ..sources import registry as REG
from ..sources import schemas as S
from ..sources.views import table, view
from ..streaming import enrichment as EN
from ..streaming import logs as SL
from ..streaming import reconcile as RS
from . import query
from .oracle import register
from .q_fleet import RECON_SQL
from .q_topics import ENRICH_SQL


#: Times of polls and records, in epoch milliseconds.
POLL_1, POLL_2, POLL_3 = 2_000_000_000_000, 2_000_000_060_000, 2_000_000_120_000


def _topic_parts(spark, sf):
    """The message topic in three arrival waves (by source table), as records with their place in the topic and their time."""
    m = view(spark, sf, "v_messages").select("id", topics.encode_message(F.col("message")).alias("value"), (F.col("id") % 3).alias("partition"), F.floor(F.col("id") / 3).alias("offset"),
                                             (F.lit(POLL_1) + F.col("id") % 1_800_000).alias("timestamp"))
    return [m.where(F.col("id") < 10**12), m.where((F.col("id") >= 10**12) & (F.col("id") < 2 * 10**12)), m.where(F.col("id") >= 2 * 10**12)]


def _result(df, *more):
    return df.select(F.col("key").cast("long").alias("id"), "message", "message_upper", "message_length", "category", *more)


def _decoded(raw):
    dec = raw.select(F.col("key").cast("long").alias("id"), topics.decode_json(F.col("value")).alias("m"), "topic", "partition", "offset")
    return dec.select("id", "m.message", "topic", "partition", "offset")


def _run(df, base):
    df.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()


@query("topic_source")
def topic_source(spark, sf):
    """Unbounded topic scan from the earliest record (file twin), decoded with the declared schema."""
    base = scratch_path(spark, "topic")
    for part in _topic_parts(spark, sf):
        topics.write_topic(part, f"{base}/topic")
    _run(_decoded(topics.read_topic_stream(spark, path=f"{base}/topic")), base)
    return spark.read.parquet(f"{base}/out")


_PLACED_SQL = "SELECT id, message, 'source' AS topic, CAST(id % 3 AS INTEGER) AS partition, CAST(floor(id / 3) AS BIGINT) AS \"offset\" FROM v_messages"
register("topic_source", _PLACED_SQL)


@query("delivery_once")
def delivery_once(spark, sf):
    """A topic that delivers a third of its records twice and some three times, across restarts: each is taken once."""
    base = scratch_path(spark, "once")
    parts = _topic_parts(spark, sf)
    again = [p.where("id % 3 = 1") for p in parts]
    for wave in ([parts[0], again[0]], [parts[1], again[0].where("id % 2 = 1")], [parts[2], again[1], again[2]]):
        for part in wave:
            topics.write_topic(part, f"{base}/topic")
        _run(_decoded(topics.once(topics.read_topic_stream(spark, path=f"{base}/topic"))), base)
    return spark.read.parquet(f"{base}/out")


register("delivery_once", _PLACED_SQL)


@query("generator_stream")
def generator_stream(spark, sf):
    """The generator as a stream, stopped after as many records as there are events."""
    base = scratch_path(spark, "generator")
    n = table(spark, sf, "events").count()
    topics.generate_count(spark, n, f"{base}/out", f"{base}/ckpt", interval=1 / max(n, 1))
    return spark.read.schema("i long, message string, partition int").parquet(f"{base}/out")


register(
    "generator_stream",
    "SELECT i, CASE i % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'hello there friend' ELSE 'this is a much longer test message to exercise the category enrichment' END "
    "|| '-' || CAST(i AS VARCHAR) AS message, CAST(i % 3 AS INTEGER) AS partition FROM (SELECT row_number() OVER () - 1 AS i FROM events)",
)


class _Enrichment:
    """Folders of one enrichment stream and its waves of input."""

    def __init__(self, spark, sf):
        base = scratch_path(spark, "enrich")
        self.spark, self.topic, self.out, self.checkpoint = spark, f"{base}/topic", f"{base}/out", f"{base}/ckpt"
        self.parts = _topic_parts(spark, sf)

    def feed(self, *waves):
        for i in waves:
            topics.write_topic(self.parts[i], self.topic)

    def start(self, run=0, every="200 milliseconds"):
        return EN.start(self.spark, self.topic, self.out, f"{self.checkpoint}-{run}", run, every)

    def sink(self):
        return _result(EN.read_sink(self.spark, self.out))


def _finish(q):
    q.processAllAvailable()
    q.stop()


def _configuration(spark, sf):
    """The checkpoint configuration of one deployment, whose own interval wins over the default."""
    d = FO.live(REG.deployments(spark, sf)).orderBy("id").limit(1)
    e = CR.effective_config(d, REG.defaults(spark)).join(d.select("id", "deployment_name", "jar_id"), "id")
    own = F.map_concat("flink_configuration", F.create_map(F.lit("execution.checkpointing.interval"), F.lit("5000")))
    cfg = e.withColumn("has_artifact", F.col("jar_id").isNotNull()).withColumn("flink_configuration", own)
    return CR.checkpoint_configuration(cfg).first()["configuration"]


@query("checkpointed_stream")
def checkpointed_stream(spark, sf):
    """The enrichment stream of one deployment on the checkpoint folder of its configuration, fed in three waves, one availableNow run per wave."""
    e = _Enrichment(spark, sf)
    conf = _configuration(spark, sf)
    for i in range(3):
        e.feed(i)
        EN.start_deployment(spark, e.topic, e.out, conf, storage=e.checkpoint, every=None).awaitTermination()
    return e.sink()


register("checkpointed_stream", ENRICH_SQL)


@query("restarted_stream")
def restarted_stream(spark, sf):
    """The enrichment stream of one deployment, started by its checkpoint configuration, through every way to stop and start it again.

    It commits what arrived and stops; it is stopped at once in mid-flight and started again on its checkpoint; it takes more while it runs; and a start on a fresh
    checkpoint reads everything again. The sink then holds the second run's copies too: ``runs`` counts in how many runs a record was emitted.
    """
    e = _Enrichment(spark, sf)
    conf = {"state.checkpoints.dir": f"{e.checkpoint}/checkpoints", "execution.checkpointing.interval": "200"}
    go = lambda: EN.start_deployment(spark, e.topic, e.out, conf)
    e.feed(0)
    _finish(go())
    e.feed(1)
    go().stop()
    q = go()
    q.processAllAvailable()
    e.feed(2)
    _finish(q)
    _finish(e.start(run=1))
    return _result(EN.emissions(EN.read_sink(spark, e.out)), "copies", "runs").where("id is not null")


# a record lost, repeated within a run or missed by the second run shows in copies or runs
register("restarted_stream", f"SELECT *, 2 AS copies, 2 AS runs FROM ({ENRICH_SQL})")


@query("stop_with_savepoint")
def stop_with_savepoint(spark, sf):
    """A running query is stopped once it has committed what arrived, and started again on its checkpoint: nothing lost or repeated."""
    e = _Enrichment(spark, sf)
    e.feed(0)
    _finish(e.start())
    e.feed(1, 2)
    _finish(e.start())
    return e.sink()


register("stop_with_savepoint", ENRICH_SQL)


@query("force_stop")
def force_stop(spark, sf):
    """A running query is stopped at once, in mid-flight or not, and started again on its checkpoint; the sink overwrites a batch run twice."""
    e = _Enrichment(spark, sf)
    e.feed(0)
    e.start().stop()
    e.feed(1, 2)
    _finish(e.start())
    return e.sink()


register("force_stop", ENRICH_SQL)


@query("savepoint_now")
def savepoint_now(spark, sf):
    """A running query commits what arrived while it keeps running, then takes more."""
    e = _Enrichment(spark, sf)
    e.feed(0)
    q = e.start()
    q.processAllAvailable()
    e.feed(1, 2)
    _finish(q)
    return e.sink()


register("savepoint_now", ENRICH_SQL)


@query("resume")
def resume(spark, sf):
    """After a stop the query starts on a fresh checkpoint: a second run reads everything again, and each record is taken once."""
    e = _Enrichment(spark, sf)
    e.feed(0, 1)
    _finish(e.start())
    e.feed(2)
    _finish(e.start(run=1))
    return _result(EN.once_each(EN.read_sink(spark, e.out)))


register("resume", ENRICH_SQL)


@query("continuity_audit")
def continuity_audit(spark, sf):
    """Sent messages against the sink of a stream whose topic lost some, repeats some and holds some never sent."""
    e = _Enrichment(spark, sf)
    m = view(spark, sf, "v_messages")
    kept = m.where("id % 97 <> 5").unionByName(m.where("id % 89 = 3"))
    extra = m.where("id % 83 = 7").select("id", F.concat(F.lit("never sent "), F.col("id").cast("string")).alias("message"))
    topics.write_topic(kept.unionByName(extra).select("id", topics.encode_message(F.col("message")).alias("value")), e.topic)
    e.start(every=None).awaitTermination()
    return EN.continuity_audit(m, e.sink())


register(
    "continuity_audit",
    """WITH r AS (SELECT message FROM v_messages WHERE id % 97 <> 5 UNION ALL SELECT message FROM v_messages WHERE id % 89 = 3
      UNION ALL SELECT 'never sent ' || CAST(id AS VARCHAR) FROM v_messages WHERE id % 83 = 7),
    n AS (SELECT message, sum(s) AS sent, sum(g) AS received FROM (SELECT message, 1 AS s, 0 AS g FROM v_messages UNION ALL SELECT message, 0, 1 FROM r) GROUP BY message)
    SELECT message, CAST(sent AS BIGINT) AS sent, CAST(received AS BIGINT) AS received,
      CASE WHEN sent = received THEN 'ok' WHEN sent = 0 THEN 'extra' WHEN received < sent THEN 'missing' ELSE 'duplicated' END AS status FROM n""",
)


# ---------------------------------------------------------------- log streams

TAIL_QUERY = L.LogQuery(app="job-7", levels=["warn", "error"])
LEVEL_SQL = r"NULLIF(regexp_extract(line, '^\S+\s+\S+\s+([A-Z]+)\s+\S+\s+-\s+', 1), '')"
TAIL_SQL = (f"SELECT app, component, namespace, pod, ts_ns, ts_ns / 1e6 AS ts_ms, line, {LEVEL_SQL} AS level "
            f"FROM v_logs WHERE app = 'job-7' AND {LEVEL_SQL} IN ('WARN', 'ERROR')")
HIGH_WATER_NS = 1705708800 * 10**9  # 2024-01-20T00:00:00Z


def _write_frames(spark, sf, path, where=None):
    lines = LS.log_lines(spark, sf)
    if where is not None:
        lines = lines.where(where)
    SL.frames_of(lines).write.mode("append").text(path)
    # malformed frames (truncated JSON) that the tail must skip
    spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").where("event_id % 101 = 0") \
        .select(F.concat(F.lit('{"streams": [{"stream": '), F.col("event_id").cast("string")).alias("value")) \
        .write.mode("append").text(path)


@query("log_tail")
def log_tail(spark, sf):
    """Label and level predicates on the live tail; malformed frames are skipped."""
    base = scratch_path(spark, "tail")
    _write_frames(spark, sf, f"{base}/frames")
    return SL.tail(spark, f"{base}/frames", TAIL_QUERY, f"{base}/out", f"{base}/ckpt")


register("log_tail", TAIL_SQL)


@query("log_store_sink")
def log_store_sink(spark, sf):
    """Stream every log line into the day-partitioned store and read it back (retention off)."""
    base = scratch_path(spark, "store")
    _write_frames(spark, sf, f"{base}/frames")
    SL.store_logs(SL.read_tail(spark, f"{base}/frames"), f"{base}/store", f"{base}/ckpt")
    return SL.read_log_store(spark, f"{base}/store").select("app", "component", "namespace", "pod", "ts_ns", "line", "log_date")


register(
    "log_store_sink",
    "SELECT app, component, namespace, pod, ts_ns, line, "
    "CAST(DATE '1970-01-01' + CAST(floor(ts_ns / 86400000000000) AS INTEGER) AS VARCHAR) AS log_date FROM v_logs",
)


@query("log_backfill_then_tail")
def log_backfill_then_tail(spark, sf):
    """The look-back before now from the log store, then the live tail from now on."""
    base = scratch_path(spark, "backfill")
    _write_frames(spark, sf, f"{base}/hist", F.col("ts_ns") < HIGH_WATER_NS)
    SL.store_logs(SL.read_tail(spark, f"{base}/hist"), f"{base}/store", f"{base}/ckpt-store")
    _write_frames(spark, sf, f"{base}/live", F.col("ts_ns") >= HIGH_WATER_NS)
    live = SL.tail(spark, f"{base}/live", TAIL_QUERY, f"{base}/out", f"{base}/ckpt-tail")
    return SL.backfill_then_tail(spark, f"{base}/store", live, TAIL_QUERY, HIGH_WATER_NS)


register("log_backfill_then_tail", f"{TAIL_SQL} AND ts_ns >= {HIGH_WATER_NS} - 300000000000")


RETENTION_NOW_NS = 1707525000 * 10**9  # 2024-02-10T00:30:00Z, 720 hours after 2024-01-11T00:30:00Z


@query("log_store_retention")
def log_store_retention(spark, sf):
    """The store once its expired days are dropped, read with retention: whole days, and the rest of the day that the cut-off falls into."""
    base = scratch_path(spark, "retention")
    _write_frames(spark, sf, f"{base}/frames")
    SL.store_logs(SL.read_tail(spark, f"{base}/frames"), f"{base}/store", f"{base}/ckpt")
    SL.expire(spark, f"{base}/store", RETENTION_NOW_NS)
    return SL.read_log_store(spark, f"{base}/store", now_ns=RETENTION_NOW_NS, retention=True).select("app", "component", "namespace", "pod", "ts_ns", "line")


register("log_store_retention", f"SELECT app, component, namespace, pod, ts_ns, line FROM v_logs WHERE ts_ns >= {RETENTION_NOW_NS} - 720 * 3600000000000")


@query("log_backfill_degraded")
def log_backfill_degraded(spark, sf):
    """The tail beside a store with a broken file: one warning in place of the look-back, then the live lines."""
    base = scratch_path(spark, "degraded")
    _write_frames(spark, sf, f"{base}/hist", F.col("ts_ns") < HIGH_WATER_NS)
    SL.store_logs(SL.read_tail(spark, f"{base}/hist"), f"{base}/store", f"{base}/ckpt-store")
    day = SL.log_date(F.lit(HIGH_WATER_NS - 1))
    spark.range(1).select(F.lit("no parquet").alias("value"), day.alias("log_date"), F.lit(10**6).alias("batch")).write.partitionBy("log_date", "batch").mode("append").text(f"{base}/store")
    _write_frames(spark, sf, f"{base}/live", F.col("ts_ns") >= HIGH_WATER_NS)
    live = SL.tail(spark, f"{base}/live", TAIL_QUERY, f"{base}/out", f"{base}/ckpt-tail")
    return SL.backfill_or_warn(spark, f"{base}/store", live, TAIL_QUERY, HIGH_WATER_NS)


register(
    "log_backfill_degraded",
    f"""SELECT *, 'line' AS event FROM ({TAIL_SQL}) WHERE ts_ns >= {HIGH_WATER_NS}
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'History backfill unavailable', NULL, 'warning'""",
)


# ---------------------------------------------------------------- continuous reconciliation

#: Between the polls users ask for stops; from the first to the second poll some resources go and some fail.
_ASKED = "TIMESTAMP_NTZ'2033-05-18 03:33:50'"
_GONE = "CAST(split_part(name, '-', 2) AS BIGINT) % 7 = 3"
_FAILS = "CAST(split_part(name, '-', 2) AS BIGINT) % 6 = 1"


def _polled(spark, sf):
    docs = cluster.cr_documents(spark, sf, keep=("name",))
    reg = REG.deployments(spark, sf)
    asked = F.col("id") % 13 == 5
    edited = reg.withColumn("pending_action", F.when(asked, "stop").otherwise(F.col("pending_action"))).withColumn("updated_at", F.when(asked, F.expr(_ASKED)).otherwise(F.col("updated_at")))
    return docs, reg, edited


@query("reconcile_stream")
def reconcile_stream(spark, sf):
    """Two complete polls that differ, with records delivered twice, and a third that never completes, with registry edits in between."""
    base = scratch_path(spark, "reconcile")
    docs, reg, edited = _polled(spark, sf)
    n = docs.count()
    RS.write_poll(docs, f"{base}/in", POLL_1, n)
    RS.reconcile_stream(spark, lambda: reg, f"{base}/in", base)
    failing = F.regexp_replace("doc", '"lifecycleState":"[A-Z_]*"', '"lifecycleState":"FAILED"')
    second = docs.where(f"NOT {_GONE}").withColumn("doc", F.when(F.expr(_FAILS), failing).otherwise(F.col("doc")))
    n2, even, odd = second.count(), second.where("length(name) % 2 = 0"), second.where("length(name) % 2 = 1")
    RS.write_poll(even, f"{base}/in", POLL_2, n2)
    RS.write_poll(even, f"{base}/in", POLL_2, n2)
    RS.reconcile_stream(spark, lambda: edited, f"{base}/in", base)  # not complete, however many records there are
    RS.write_poll(odd, f"{base}/in", POLL_2, n2, last=False)
    RS.write_poll(docs.where("length(name) % 2 = 0"), f"{base}/in", POLL_3, n, last=False)
    RS.reconcile_stream(spark, lambda: edited, f"{base}/in", base)
    out = RS.current(FO.live(edited), RS.changes(spark, base))
    return out.select("id", "status", "pending_action", "error_message", "last_savepoint_path")


_CR2 = f"""cr2 AS (SELECT name, namespace, CASE WHEN {_FAILS} AND lifecycle_state IS NOT NULL THEN 'FAILED' ELSE lifecycle_state END AS lifecycle_state,
  jm_status, job_state, spec_job_state, error, upgrade_path, n_history FROM (
    SELECT name, namespace, CASE WHEN {_FAILS} AND raw IS NOT NULL THEN 'FAILED' ELSE lifecycle_state END AS lifecycle_state, jm_status, job_state, spec_job_state, error, upgrade_path, n_history
    FROM (SELECT cr.*, v.lifecycle_state AS raw FROM cr JOIN v_cr v USING (name, namespace))) WHERE NOT {_GONE})"""
_REG2 = """reg2 AS (SELECT d.* EXCLUDE (status, pending_action, error_message, last_savepoint_path),
        CASE WHEN d.id % 13 = 5 THEN d.status ELSE r.status END AS status,
        CASE WHEN d.id % 13 = 5 THEN 'stop' ELSE r.pending_action END AS pending_action,
        CASE WHEN d.id % 13 = 5 THEN d.error_message ELSE r.error_message END AS error_message,
        CASE WHEN d.id % 13 = 5 THEN d.last_savepoint_path ELSE r.last_savepoint_path END AS last_savepoint_path
      FROM v_deployments d JOIN recon r USING (id))"""
_SECOND = "WITH " + RECON_SQL[RECON_SQL.index("j AS (") :].replace("FROM v_deployments d LEFT JOIN cr ON", "FROM reg2 d LEFT JOIN cr2 cr ON") + " SELECT * FROM recon"
register("reconcile_stream", f"{RECON_SQL}, {_REG2}, {_CR2}, second AS ({_SECOND}) SELECT id, status, pending_action, error_message, last_savepoint_path FROM second")


@query("reconcile_empty_listing")
def reconcile_empty_listing(spark, sf):
    """A complete poll, then an empty one: what is left of the registry and the savepoints that stops had left."""
    base = scratch_path(spark, "reconcile")
    docs, reg, edited = _polled(spark, sf)
    RS.write_poll(docs, f"{base}/in", POLL_1, docs.count())
    RS.reconcile_stream(spark, lambda: reg, f"{base}/in", base)
    RS.write_poll(docs.where("false"), f"{base}/in", POLL_2, 0)
    RS.reconcile_stream(spark, lambda: edited, f"{base}/in", base)
    out = RS.current(FO.live(edited), RS.changes(spark, base)).select("id", "status", "pending_action")
    stopped = RS.savepoints(spark, base, REG.savepoints(spark, sf)).select(F.col("deployment_id").alias("id"), F.col("path").alias("stop_savepoint"))
    return out.join(stopped, "id", "left")


register(
    "reconcile_empty_listing",
    f"""{RECON_SQL}, {_REG2}, cr2 AS (SELECT * FROM cr WHERE false), second AS ({_SECOND})
    SELECT s.id, s.status, s.pending_action, r.captured_savepoint AS stop_savepoint FROM second s JOIN recon r USING (id)""",
)

#: Fleet of the watch: every k-th poll finds one more quarter of the creating deployments running; ten listings are on offer.
_WATCHED, _LISTINGS = 4, 10


@query("reconcile_until_settled")
def reconcile_until_settled(spark, sf):
    """Polls while something is in transition: the stream ends by itself at the first poll that leaves nothing there."""
    base = scratch_path(spark, "watch")
    reg = FO.live(REG.deployments(spark, sf)).where("deployment_mode = 'application'") \
        .withColumn("status", F.lit("creating")).withColumn("pending_action", F.lit(None).cast("string"))
    up = F.col("id") % _WATCHED
    n = reg.count()

    def poll(k: int) -> None:
        if k >= _LISTINGS:
            raise RuntimeError("polled beyond the last listing")
        running = F.when(up <= k, "RUNNING").otherwise("RECONCILING")
        doc = F.struct(F.struct(F.col("deployment_name").alias("name"), "namespace").alias("metadata"), F.struct(F.struct(F.lit("running").alias("state")).alias("job")).alias("spec"),
                       F.struct(F.lit("DEPLOYED").alias("lifecycleState"), F.struct(running.alias("state")).alias("jobStatus")).alias("status"))
        RS.write_poll(reg.select(F.to_json(doc).alias("doc")), f"{base}/in", POLL_1 + k * 4000, n)

    applied = RS.watch(spark, lambda: reg, poll, f"{base}/in", base, every=0)
    return spark.createDataFrame(applied, "poll_ms long, n_in_transition long")


register(
    "reconcile_until_settled",
    f"""SELECT {POLL_1} + k * 4000 AS poll_ms, count(*) FILTER (id % {_WATCHED} > k) AS n_in_transition
    FROM v_deployments, (SELECT unnest(range({_WATCHED})) AS k) WHERE deleted_at IS NULL AND deployment_mode = 'application' GROUP BY k""",
)


# ---------------------------------------------------------------- pod log files (B1)


@query("pod_log_source")
def pod_log_source(spark, sf):
    """Tail kubelet log files of every pod; labels from the path and the running-pod table."""
    base = scratch_path(spark, "podlogs")
    lines = LS.log_lines(spark, sf).withColumn("pod_uid", F.lit("u1"))
    env = LS.envelope_lines(lines)
    # broken lines, as a crashed runtime leaves them: cut short, without a time, with one that is none
    cut = F.when(F.crc32("value") % 3 == 0, F.expr("left(value, 20)")).when(F.crc32("value") % 3 == 1, F.lit('{"log":"x","stream":"stdout"}')) \
        .otherwise(F.lit('{"log":"x","stream":"stdout","time":"yesterday"}'))
    broken = env.where(F.crc32("value") % 50 == 0).withColumn("value", cut)
    env.unionByName(broken).write.partitionBy("pod_dir", "container").text(f"{base}/pods")
    pods = LS.log_lines(spark, sf).select(F.col("pod").alias("name"), "namespace", "app", "component").distinct() \
        .withColumn("phase", F.when(F.col("name").endswith("-2"), "Pending").otherwise("Running"))
    s = LS.attach_pod_labels(LS.read_pod_logs(spark, f"{base}/pods"), pods)
    s.select("app", "component", "namespace", "pod", "ts_ns", "line").writeStream.format("parquet") \
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


register("pod_log_source", "SELECT app, component, namespace, pod, ts_ns, line FROM v_logs WHERE NOT ends_with(pod, '-2')")


# ---------------------------------------------------------------- access limits (H1 twin)


@query("over_limit_stream")
def over_limit_stream(spark, sf):
    """Attempts and rejected attempts of every key and closed window, from the watermarked stream of attempts."""
    base = scratch_path(spark, "access")
    a = view(spark, sf, "v_access").select("source_key", F.col("ts").cast("timestamp").alias("ts"), "kind")
    # the stream's end: one late attempt of each kind closes all windows before it
    end = spark.createDataFrame([(None, lim.kind) for lim in AC.LIMITS], "source_key string, kind string") \
        .crossJoin(F.broadcast(a.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts"))))
    a.unionByName(end).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"{base}/in")
    for lim in AC.LIMITS:
        AC.window_counts(stream, lim).writeStream.format("parquet").option("path", f"{base}/out/{lim.kind}").option("checkpointLocation", f"{base}/ckpt-{lim.kind}") \
            .trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(*[f"{base}/out/{lim.kind}" for lim in AC.LIMITS])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


register(
    "over_limit_stream",
    """SELECT *, greatest(attempts - CASE kind WHEN 'login' THEN 5 ELSE 10 END, 0) AS rejected FROM (
      SELECT source_key, kind, time_bucket(CASE kind WHEN 'login' THEN INTERVAL 2 MINUTE ELSE INTERVAL 60 MINUTE END, ts, TIMESTAMP '1970-01-01') AS window_start,
        count(*) AS attempts
      FROM v_access GROUP BY 1, 2, 3)""",
)


@query("over_limit_rejections")
def over_limit_rejections(spark, sf):
    """Every rejected attempt from the stream of attempts, which arrive in three waves in order of time."""
    base = scratch_path(spark, "rejections")
    a = view(spark, sf, "v_access")
    cuts = a.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).selectExpr("a + (z - a) / 3 AS b", "a + 2 * (z - a) / 3 AS c").first()
    waves = [F.col("ts") < F.lit(cuts["b"]), (F.col("ts") >= F.lit(cuts["b"])) & (F.col("ts") < F.lit(cuts["c"])), F.col("ts") >= F.lit(cuts["c"])]
    for wave in waves:
        a.where(wave).write.mode("append").parquet(f"{base}/in")
        AC.rejections(spark.readStream.schema(a.schema).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out") \
            .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


register(
    "over_limit_rejections",
    """WITH a AS (SELECT *, CASE kind WHEN 'login' THEN 5 ELSE 10 END AS lim,
        time_bucket(CASE kind WHEN 'login' THEN INTERVAL 2 MINUTE ELSE INTERVAL 60 MINUTE END, ts, TIMESTAMP '1970-01-01') AS window_start
      FROM v_access),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_key, kind, window_start ORDER BY ts, event_id) AS rn FROM a)
    SELECT source_key, kind, window_start, ts, event_id, lim AS "limit" FROM r WHERE rn > lim""",
)


# ---------------------------------------------------------------- file sources


@query("registry_tables")
def registry_tables(spark, sf):
    """Registry exports written as parquet and read with their fixed schemas: live savepoints per deployment and artifact."""
    base = scratch_path(spark, "registry")
    for name, df in (("deployments", REG.deployments(spark, sf)), ("savepoints", REG.savepoints(spark, sf)), ("jars", REG.jars(spark, sf))):
        df.write.parquet(f"{base}/{name}")
    d = REG.read_registry_table(spark, S.DEPLOYMENTS_DDL, f"{base}/deployments")
    sp = REG.read_registry_table(spark, S.SAVEPOINTS_DDL, f"{base}/savepoints").groupBy(F.col("deployment_id").alias("id")).agg(F.count(F.lit(1)).alias("n_savepoints"))
    j = REG.read_registry_table(spark, S.JARS_DDL, f"{base}/jars").select(F.col("id").alias("jar_id"), F.col("name").alias("jar_name"), "size_bytes")
    out = d.join(sp, "id", "left").join(j, "jar_id", "left")
    return out.select("id", "deployment_name", F.col("config.jobManager.cpu").cast("double").alias("jm_cpu"), F.size("resources").alias("n_resources"), "jar_name", "size_bytes",
                      F.coalesce("n_savepoints", F.lit(0)).alias("n_savepoints"), "created_at")


register(
    "registry_tables",
    """SELECT d.id, d.deployment_name, CAST(d.jm_cpu AS DOUBLE) AS jm_cpu, d.n_resources, j.name AS jar_name, j.size_bytes,
      coalesce(s.n, 0) AS n_savepoints, d.created_at
    FROM v_deployments d LEFT JOIN v_jars j ON j.id = d.jar_id
    LEFT JOIN (SELECT deployment_id, count(*) AS n FROM v_savepoints GROUP BY deployment_id) s ON s.deployment_id = d.id""",
)


@query("snapshot_documents")
def snapshot_documents(spark, sf):
    """Custom resources, pods, events and state snapshots written as JSON files and read with their schemas."""
    base = scratch_path(spark, "documents")
    docs = {"cr": (cluster.cr_file_documents(spark, sf), S.CR_DDL), "pod": (cluster.pod_documents(spark, sf), S.POD_DDL),
            "event": (cluster.event_documents(spark, sf), S.EVENT_DDL), "snapshot": (cluster.snapshot_documents(spark, sf), S.SNAPSHOT_DDL)}
    read = {}
    for kind, (df, ddl) in docs.items():
        df.select("doc").write.option("compression", "gzip").text(f"{base}/{kind}")
        read[kind] = cluster.read_documents(spark, f"{base}/{kind}", ddl)
    fields = {
        "cr": ("metadata.name", "metadata.namespace", "status.lifecycleState", "status.error"),
        "pod": ("metadata.name", "metadata.namespace", "status.phase", "status.startTime"),
        "event": ("involvedObject.name", "involvedObject.namespace", "reason", "message"),
        "snapshot": ("metadata.name", "metadata.namespace", "status.state", "status.path"),
    }
    out = None
    for kind, cols in fields.items():
        part = read[kind].select(F.lit(kind).alias("kind"), *[F.col(c).alias(n) for c, n in zip(cols, ("name", "namespace", "state", "text"), strict=True)])
        out = part if out is None else out.unionByName(part)
    return out


register(
    "snapshot_documents",
    """SELECT 'cr' AS kind, name, namespace, lifecycle_state AS state, error AS text FROM v_cr
    UNION ALL SELECT 'pod', pod_name, namespace, phase, start_time FROM v_pods
    UNION ALL SELECT 'event', object_name, namespace, reason, message FROM v_k8s_events
    UNION ALL SELECT 'snapshot', name, namespace, state, path FROM v_snapshots""",
)


@query("snapshot_stream")
def snapshot_stream(spark, sf):
    """Two listings of custom resources that arrive as files, some cut short: the newest document of each, and the number of broken texts of each listing."""
    base = scratch_path(spark, "snapshots")
    # each document is built once a listing: the name it is chosen and cut by comes with it
    docs = cluster.cr_file_documents(spark, sf, keep=("name",))
    nth = F.split_part("name", F.lit("-"), F.lit(2)).cast("long")
    later = docs.where(nth % 5 == 2).withColumn("doc", F.regexp_replace("doc", '"lifecycleState":"[A-Z_]*"', '"lifecycleState":"SUSPENDED"'))
    for at, wave in ((POLL_1, docs), (POLL_2, later)):
        texts = F.when(nth % 7 == 1, F.array("doc", F.expr("left(doc, 30)"))).otherwise(F.array("doc"))
        wave.select(F.explode(texts).alias("doc")).write.option("compression", "gzip").text(f"{base}/in/poll_ms={at}")
        cluster.follow_documents(spark, f"{base}/in", S.CR_DDL, f"{base}/out", f"{base}/ckpt")
    newest = cluster.followed_documents(spark, f"{base}/out", S.CR_DDL).select(F.col("metadata.name").alias("name"), F.col("metadata.namespace").alias("namespace"), F.col("status.lifecycleState").alias("state"), "poll_ms", F.lit(1).cast("long").alias("n"))
    broken = cluster.corrupt_files(spark, f"{base}/out").groupBy("poll_ms").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return newest.unionByName(broken.select(none.alias("name"), none.alias("namespace"), F.lit("corrupt").alias("state"), "poll_ms", "n"))


register(
    "snapshot_stream",
    f"""WITH d AS (SELECT *, CAST(split_part(name, '-', 2) AS BIGINT) AS nth FROM v_cr)
    SELECT name, namespace, CASE WHEN nth % 5 = 2 AND lifecycle_state IS NOT NULL THEN 'SUSPENDED' ELSE lifecycle_state END AS state, CASE WHEN nth % 5 = 2 THEN {POLL_2} ELSE {POLL_1} END AS poll_ms, 1 AS n FROM d
    UNION ALL SELECT NULL, NULL, 'corrupt', {POLL_1}, count(*) FROM d WHERE nth % 7 = 1 HAVING count(*) > 0
    UNION ALL SELECT NULL, NULL, 'corrupt', {POLL_2}, count(*) FROM d WHERE nth % 7 = 1 AND nth % 5 = 2 HAVING count(*) > 0""",
)
