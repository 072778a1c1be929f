"""Diagnostics over cluster snapshots: conditions, pod health, related events, recommendations.

Scale notes. Pods attach to deployments by an equi-join on (app label, namespace).
Events relate to a deployment when the deployment name occurs as a *substring* of the
event's object name or message; instead of a nested-loop ``contains`` join, every event
text is cut into the substrings that could be a deployment name (runs of characters
that occur in names, of lengths that occur), a Bloom filter of the names drops nearly all of those in place, and the rest
is equi-joined with the names. That is exact and stays a hash join at any size; lengths, characters and filter come as scalar subqueries of
the same query; lengths are as few as the naming rule allows (63), and the filter's size is fixed.
Everything a report says is one row of a section, with the markers found in it as bits, so
recommendations are an OR over the rows (combined map-side) and no list is collected into a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fleet as FL
from ..sources import schemas as S

RECENT_EVENTS = 8

# The recommendation rules, in order (markers, severity, reason, message).
RULES = [
    (["ImagePullBackOff", "ErrImagePull"], "high", "Image pull failed",
     "Kubernetes could not pull the Flink image. Verify the image name or run the image loading script for your local cluster."),
    (["CrashLoopBackOff"], "high", "Container is crashing repeatedly",
     "Check the JobManager logs. The application may be failing during startup."),
    (["OOMKilled"], "high", "Container ran out of memory",
     "Increase JobManager or TaskManager memory in the deployment configuration."),
    (["FailedScheduling"], "medium", "Pod scheduling failed",
     "The Kubernetes cluster may not have enough CPU or memory available."),
]
# A startup-probe failure is noise, not a related event.
NOISE_REASON = "Unhealthy"
NOISE_TEXT = "Startup probe failed"


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def conditions(cr: DataFrame) -> DataFrame:
    """One row per status condition of each custom resource."""
    e = cr.select(F.col("metadata.name").alias("name"), F.col("metadata.namespace").alias("namespace"),
                  F.explode("status.conditions").alias("c"))
    return e.select(
        "name", "namespace",
        _blank(F.col("c.type")).alias("type"), _blank(F.col("c.status")).alias("status"),
        _blank(F.col("c.reason")).alias("reason"), _blank(F.col("c.message")).alias("message"),
        _blank(F.col("c.lastTransitionTime")).alias("last_transition_time"),
    )


def pod_health(pods: DataFrame) -> DataFrame:
    """Per pod: phase, node, reason, start, total restarts (missing counts 0), containers."""
    cs = F.coalesce(F.col("status.containerStatuses"), F.array().cast(f"array<{S.CONTAINER}>"))
    return pods.select(
        _blank(F.col("metadata.name")).alias("pod_name"),
        F.col("metadata.labels").getItem("app").alias("app"),
        F.col("metadata.namespace").alias("namespace"),
        _blank(F.col("status.phase")).alias("phase"),
        _blank(F.col("spec.nodeName")).alias("node"),
        _blank(F.col("status.reason")).alias("reason"),
        _blank(F.col("status.startTime")).alias("start_time"),
        F.aggregate(cs, F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(c["restartCount"], F.lit(0)).cast("long")).alias("restart_count"),
        F.size(cs).alias("n_containers"),
        cs.alias("containers"),
    )


def container_state(pods: DataFrame) -> DataFrame:
    """Label of the first container's state per pod."""
    first = F.get(F.col("status.containerStatuses"), 0)
    return pods.select(F.col("metadata.name").alias("pod_name"), FL.container_state(first.getField("state")).alias("container_state"))


def event_view(events: DataFrame) -> DataFrame:
    """first/last seen fall back to the event time; a missing or zero count is 1."""
    return events.select(
        "uid",
        _blank(F.col("reason")).alias("reason"),
        _blank(F.col("message")).alias("message"),
        _blank(F.col("type")).alias("type"),
        _blank(F.col("involvedObject.kind")).alias("object_kind"),
        _blank(F.col("involvedObject.name")).alias("object_name"),
        F.col("involvedObject.namespace").alias("namespace"),
        F.coalesce(_blank(F.col("firstTimestamp")), _blank(F.col("eventTime"))).alias("first_seen"),
        F.coalesce(_blank(F.col("lastTimestamp")), _blank(F.col("eventTime"))).alias("last_seen"),
        F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.lit(1)).alias("count"),
    )


#: Bits of the name filter, a power of two of at most 2 ** 22 (three probes of a 64-bit hash): half a megabyte, whatever the fleet.
FILTER_BITS = 1 << 22


def _probes(text: Column, namespace: Column) -> list[Column]:
    h = F.xxhash64(text, namespace)
    return [F.shiftrightunsigned(h, shift).bitwiseAND(FILTER_BITS - 1) for shift in (0, 21, 42)]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def name_filter(names: DataFrame) -> Column:
    """Bloom filter of (deployment_name, namespace) as a scalar: an array of FILTER_BITS / 64 words."""
    at = names.select(F.explode(F.array(*_probes(F.col("deployment_name"), F.col("namespace")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
    every = names.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()  # a fixed number of words


def candidate_names(names: DataFrame, texts: DataFrame) -> DataFrame:
    """uid, _ns, cand: the substrings of ``texts`` (uid, namespace, t) that may be a name in their namespace.

    Runs of characters that occur in names are cut into pieces of lengths that occur, which begin with the two characters and end with the one that a name does, and
    pieces that the filter of names does not know go before anything is shuffled. What is left holds every name; of other pieces, a share that grows with the fleet (0.1 % for 150,000 names).
    """
    lengths = names.agg(F.array_sort(F.collect_set(F.length("deployment_name")))).scalar()
    # pairs of characters that occur, at most
    begin = names.agg(F.collect_set(F.left("deployment_name", F.lit(2)))).scalar()
    finish = names.agg(F.collect_set(F.right("deployment_name", F.lit(1)))).scalar()
    chars = names.select(F.explode(F.split("deployment_name", "")).alias("ch")).where("ch <> ''").distinct()
    escaped = F.when(F.col("ch").rlike("[A-Za-z0-9]"), F.col("ch")).otherwise(F.concat(F.lit("\\"), "ch"))
    pattern = chars.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(escaped)), ""), F.lit("]+"))).scalar()
    # without names the pattern is "[]+", which is none
    runs = texts.withColumn("lens", lengths).where(F.size("lens") > 0)
    runs = runs.select("uid", "namespace", "lens", F.explode(F.regexp_extract_all("t", pattern, 0)).alias("run")).where(F.length("run") >= F.col("lens")[0])
    # only a name of one character begins with less than two
    at = F.filter(F.sequence(F.lit(1), F.length("run")), lambda i: F.array_contains("begin", F.substring(F.col("run"), i, F.lit(2))) | F.array_contains("begin", F.substring(F.col("run"), i, F.lit(1))))
    runs = runs.withColumn("begin", begin).withColumn("finish", finish).withColumn("starts", at).where(F.size("starts") > 0)
    cut = F.flatten(F.transform("starts", lambda i: F.transform(F.filter("lens", lambda n: n <= F.length("run") - i + 1), lambda n: F.substring(F.col("run"), i, n))))
    cut = F.filter(cut, lambda c: F.array_contains("finish", F.right(c, F.lit(1))))
    cands = runs.select("uid", F.col("namespace").alias("_ns"), F.explode(F.array_distinct(cut)).alias("cand"))
    known, bits = F.lit(True), name_filter(names)
    for at in _probes(F.col("cand"), F.col("_ns")):
        known = known & (F.get(bits, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0)
    return cands.where(known)


def related_events(deployments: DataFrame, events: DataFrame) -> DataFrame:
    """(deployment id, event uid) for every event whose object name or message contains the
    deployment name, in the deployment's namespace; startup-probe noise is dropped."""
    names = deployments.select("id", "deployment_name", "namespace").where(F.length("deployment_name") > 0)
    ev = event_view(events).where(
        ~(F.coalesce(F.col("reason") == NOISE_REASON, F.lit(False)) & F.coalesce(F.col("message").contains(NOISE_TEXT), F.lit(False))))
    texts = ev.select("uid", "namespace", F.explode(F.array("object_name", "message")).alias("t")).where(F.col("t").isNotNull())
    cands = candidate_names(names, texts)
    hits = cands.join(names, (F.col("cand") == F.col("deployment_name")) & (F.col("_ns") == F.col("namespace")))
    return hits.select("id", "uid").distinct()


def recent_events(related: DataFrame, events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """Per deployment, the ``n`` newest related events by coalesce(last, first seen).

    ``row_number() <= n`` over a window lets Spark plan a per-partition group limit
    before the shuffle, so a deployment with very many events ships only n rows per task.
    """
    ev = event_view(events)
    seen = F.unix_millis(F.try_to_timestamp(F.coalesce("last_seen", "first_seen")))
    j = related.join(ev, "uid").withColumn("seen_ms", seen)
    w = Window.partitionBy("id").orderBy(F.col("seen_ms").desc_nulls_last(), F.col("uid").desc())
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _marks(*texts: Column) -> Column:
    """Bit i is set if a marker of rule i occurs in one of the texts."""
    bits = F.lit(0)
    for i, (markers, *_rest) in enumerate(RULES):
        hit = F.lit(False)
        for m in markers:
            for t in texts:
                hit = hit | F.coalesce(t.contains(m), F.lit(False))
        bits = bits.bitwiseOR(F.when(hit, 1 << i).otherwise(0))
    return bits


#: A report row: what it is about, its place in the section, its fields, and the markers found in it.
SECTION_COLS = ["id", "section", "position", "name", "kind", "state", "reason", "message", "at", "n", "marks"]


def _row(section: str, marks: Column, **fields: Column) -> list[Column]:
    text = {c: F.lit(None).cast("string") for c in ("name", "kind", "state", "reason", "message", "at")}
    number = {c: F.lit(None).cast("long") for c in ("position", "n")}
    cols = {"section": F.lit(section), **text, **number, **fields, "marks": marks}
    return [(cols[c].cast("long") if c in number else cols[c]).alias(c) for c in SECTION_COLS[1:]]


def _pod_marks() -> Column:
    return _marks(*[F.col(c) for c in ("pod_name", "phase", "node", "reason", "start_time")])


def _container_marks(c: Column) -> Column:
    return _marks(c["name"], c["state"], c["lastState"])


def _event_marks() -> Column:
    return _marks(*[F.col(c) for c in ("reason", "message", "type", "object_kind", "object_name", "first_seen", "last_seen")])


def _status_marks() -> Column:
    return _marks(*[F.col(c) for c in ("lifecycle_state", "jm_status", "job_text", "error")])


def marked_sections(deployments: DataFrame, cr: DataFrame, pods: DataFrame, events: DataFrame) -> DataFrame:
    """What ``recommendations`` needs of ``sections``: id, section, position and marks, of each status and of the pods and events with a marker.

    Every text is searched where it is read, so joins shuffle names and bits and no texts; the containers of a pod are part of it.
    """
    from .fleet import cr_status

    names = deployments.select("id", "deployment_name", "namespace")
    status = cr_status(cr, keep=[F.col("status.jobStatus").alias("job_text")]).select(F.col("name").alias("deployment_name"), "namespace", _status_marks().alias("marks"))
    st = names.join(status, ["deployment_name", "namespace"]).select("id", F.lit("status").alias("section"), F.lit(0).cast("long").alias("position"), "marks")
    none = F.lit(None).cast("long").alias("position")
    bits = F.aggregate("containers", _pod_marks(), lambda acc, c: acc.bitwiseOR(_container_marks(c)))
    by_app = pod_health(pods).select(F.col("app").alias("deployment_name"), "namespace", bits.alias("marks")).where("marks <> 0").groupBy("deployment_name", "namespace").agg(F.bit_or("marks").alias("marks"))
    pod = by_app.join(names, ["deployment_name", "namespace"]).select("id", F.lit("pod").alias("section"), none, "marks")
    by_uid = event_view(events).select("uid", _event_marks().alias("marks")).where("marks <> 0").groupBy("uid").agg(F.bit_or("marks").alias("marks"))
    ev = related_events(names, events).join(by_uid, "uid").select("id", F.lit("event").alias("section"), none, "marks")
    return st.unionByName(pod).unionByName(ev)


def sections(deployments: DataFrame, cr: DataFrame, pods: DataFrame, events: DataFrame) -> DataFrame:
    """One row per status, condition, pod, container and related event of each deployment.

    A marker occurs in the JSON text of {status, pods, events} exactly when it occurs in one of their
    string values (it holds no JSON-escaped characters and no field name contains one); the whole text of
    ``jobStatus`` is searched, whatever fields it has. Conditions are not part of that text.
    Each source is read once: a pod carries its containers, a custom resource its conditions.
    """
    from .fleet import cr_status

    names = deployments.select("id", "deployment_name", "namespace")
    status = cr_status(cr, keep=[F.col("status.jobStatus").alias("job_text"), F.col("status.conditions").alias("conditions")])
    st = names.join(status.withColumnRenamed("name", "deployment_name").withColumn("has_cr", F.lit(True)), ["deployment_name", "namespace"], "left")
    state = _row("status", _status_marks(),
                 name=F.when(F.col("has_cr"), F.col("lifecycle_state")).otherwise("DELETED"), kind=F.col("jm_status"), state=F.col("job_state"),
                 reason=F.col("upgrade_path"), message=F.col("error"), n=F.col("n_history"), position=F.when(F.col("has_cr"), 0))
    cond = F.transform(F.coalesce("conditions", F.array().cast(f"array<{S.CONDITION}>")), lambda c, i: F.struct(*_row(
        "condition", F.lit(0), kind=_blank(c["type"]), state=_blank(c["status"]), reason=_blank(c["reason"]), message=_blank(c["message"]),
        at=_blank(c["lastTransitionTime"]), position=i)))
    st_rows = st.select("id", F.explode(F.concat(F.array(F.struct(*state)), cond)).alias("r"))
    ph = pod_health(pods).join(names.withColumnRenamed("deployment_name", "app"), ["app", "namespace"])
    pod = _row("pod", _pod_marks(), name=F.col("pod_name"), state=F.col("phase"),
               kind=F.col("node"), reason=F.col("reason"), at=F.col("start_time"), n=F.col("restart_count"))
    box = F.transform("containers", lambda c, i: F.struct(*_row(
        "container", _container_marks(c), name=F.concat_ws("/", F.col("pod_name"), c["name"]), state=c["state"], reason=c["lastState"],
        message=c["ready"].cast("string"), n=F.coalesce(c["restartCount"], F.lit(0)), position=i)))
    pod_rows = ph.select("id", F.explode(F.concat(F.array(F.struct(*pod)), box)).alias("r"))
    ev = related_events(names, events).join(event_view(events), "uid")
    ev_rows = ev.select("id", F.struct(*_row(
        "event", _event_marks(),
        name=F.col("object_name"), kind=F.col("object_kind"), state=F.col("type"), reason=F.col("reason"), message=F.col("message"),
        at=F.coalesce("last_seen", "first_seen"), n=F.col("count"), position=F.col("uid"))).alias("r"))
    return st_rows.unionByName(pod_rows).unionByName(ev_rows).select("id", "r.*")


def recommendations(rows: DataFrame) -> DataFrame:
    """One row per fired rule: (id, rule_order, severity, reason, message). Only deployments that have a custom resource get any."""
    has_cr = F.bool_or((F.col("section") == "status") & F.col("position").isNotNull())
    fired = rows.groupBy("id").agg(F.bit_or("marks").alias("bits"), has_cr.alias("has_cr")).where("has_cr and bits <> 0")
    spark = rows.sparkSession
    rules = spark.createDataFrame([(i, sev, reason, msg) for i, (_m, sev, reason, msg) in enumerate(RULES)],
                                  "rule_order int, severity string, reason string, message string")
    orders = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, i) for i in range(len(RULES))]))
    # the rules are a fixed list
    return fired.select("id", F.explode(orders).alias("rule_order")).join(F.broadcast(rules), "rule_order")


def diagnostics_report(rows: DataFrame) -> DataFrame:
    """The sections and, as a section of their own, the recommendations that follow from them.

    ``rows`` is read twice, so a caller with large inputs writes ``sections`` to a table first. Within a section:
    conditions, containers and recommendations by ``position``, events newest first by ``at``.
    """
    recs = recommendations(rows).select("id", F.lit("recommendation").alias("section"), F.col("rule_order").cast("long").alias("position"), F.lit(None).cast("string").alias("name"),
                                        F.lit(None).cast("string").alias("kind"), F.col("severity").alias("state"), "reason", "message",
                                        F.lit(None).cast("string").alias("at"), F.lit(None).cast("long").alias("n"))
    return rows.drop("marks").unionByName(recs)
