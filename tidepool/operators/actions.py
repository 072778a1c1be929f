"""Action requests as data: which requests on a deployment are accepted, and what the deployment comes to.

Every deployment has a sequence of events: requests (stop, resume, savepoint, delete, edit) and what the cluster shows in between
(job states, finished snapshots). A request is accepted or rejected with a reason by the status and the pending action it meets, an accepted one
sets the pending action, and an observation resolves it; so the events are an ordered fold.

**Scale.** Events and registry meet by name, and the fold follows that dealing: an event crosses the network once, with its deployment's name, and only
one that names a savepoint goes to the savepoints of its deployment and back. What the fold keeps is one of 45 states (nine statuses, five pending
actions), so a stretch of events is a map from states to states, and stretches compose. A deployment with more than ``WHOLE`` events is dealt by its hours:
each hour gets its map (a short fold from each state in the row), the maps are folded in order (two small arrays for an hour, not for an event), and every hour is replayed
from the state it starts in. Events are thus collected by deployment and hour, or ``WHOLE`` at most. The rules are tables of transitions, fixed arrays in the plan.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fleet as FL

STATUSES = ["creating", "running", "suspended", "succeeded", "failed", "rolling_back", "deleting", "deleted", "unknown"]
PENDING = ["", "stop", "force_stop", "resume", "delete"]
STATES = list(product(STATUSES, PENDING))

REQUESTS = ["stop", "force_stop", "savepoint", "resume", "delete", "edit"]
#: What the cluster shows: the status that a snapshot maps to, no resource at all, a finished savepoint.
OBSERVED = ["saw:running", "saw:suspended", "saw:failed", "saw:creating", "gone", "snapshot"]
KINDS = REQUESTS + OBSERVED

#: Outcomes, by number in the transition table.
OUTCOMES = ["accepted", "conflict: operation in progress", "conflict: not running", "conflict: not resumable", "conflict: already deleted", "conflict: not editable",
            "invalid: not running", "resolved", "synced", "unchanged"]
MILLIS = 3_600_000
#: Events of a deployment that are folded in one go.
WHOLE = 1000


def transition(status: str, pending: str, kind: str) -> tuple[str, str, str]:
    """Outcome, new status and new pending action of one event."""
    busy = "conflict: operation in progress"
    if kind in ("stop", "force_stop"):
        outcome = busy if pending else "accepted" if status == FL.RUNNING else "conflict: not running"
        return outcome, status, kind if outcome == "accepted" else pending
    if kind == "savepoint":  # a pending action does not stand in the way
        return "accepted" if status == FL.RUNNING else "invalid: not running", status, pending
    if kind == "resume":
        outcome = busy if pending else "accepted" if status in (FL.SUSPENDED, FL.FAILED, FL.UNKNOWN) else "conflict: not resumable"
        return outcome, status, kind if outcome == "accepted" else pending
    if kind == "delete":
        outcome = "conflict: already deleted" if status == FL.DELETED else busy if pending else "accepted"
        return outcome, status, kind if outcome == "accepted" else pending
    if kind == "edit":
        outcome = "conflict: not editable" if status not in (FL.SUSPENDED, FL.FAILED) else busy if pending else "accepted"
        return outcome, status, pending
    if kind == "snapshot" or status == FL.DELETED:
        return "unchanged", status, pending
    if kind == "gone":
        return ("resolved", FL.DELETED, "") if pending == "delete" else ("synced", FL.DELETED, "") if not pending else ("unchanged", status, pending)
    seen = kind.removeprefix("saw:")
    if pending == "delete":
        return "unchanged", status, pending
    if pending:
        done = seen == FL.FAILED or (seen == FL.RUNNING if pending == "resume" else seen == FL.SUSPENDED)
        return ("resolved", seen, "") if done else ("unchanged", status, pending)
    return ("synced", seen, "") if seen != status else ("unchanged", status, pending)


def _tables() -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """By kind and state, as numbers: the next state, the outcome, and whether a graceful stop resolves in it."""
    after, outcome, stops = [], [], []
    for kind in KINDS:
        found = [transition(*state, kind) for state in STATES]
        after.append([STATES.index((status, pending)) for _, status, pending in found])
        outcome.append([OUTCOMES.index(o) for o, _, _ in found])
        stops.append([int(o == "resolved" and pending == "stop" and status == FL.SUSPENDED) for (o, status, _), (_, pending) in zip(found, STATES, strict=True)])
    return after, outcome, stops


def _numbers(rows: list[list[int]]) -> Column:
    """A table of small numbers as a literal array, row after row."""
    return F.lit([x for row in rows for x in row])


def _at(table: Column, kind: Column, state: Column) -> Column:
    return F.get(table, kind * len(STATES) + state)


def _name(names: list[str], number: Column) -> Column:
    return F.get(F.lit(names), number)


def _with_savepoints(asked: DataFrame, savepoints: DataFrame) -> DataFrame:
    """Events that name a savepoint, a row for each of that id in their deployment (or one with nulls): ``chosen_path`` and the deployment's ``newest_id``.

    Events and savepoints are dealt by deployment together, once, and go on by the events' names.
    """
    none = lambda t: F.lit(None).cast(t)
    # an event of no deployment stays by itself
    asking = asked.select("deployment_id", F.when(F.col("deployment_id").isNull(), F.xxhash64("event_id")).alias("alone"), "savepoint_id", F.struct(*asked.columns).alias("event"))
    stored = savepoints.where("deployment_id is not null").select("deployment_id", none("long").alias("alone"), F.col("id").alias("savepoint_id"), F.struct("created_at", "path").alias("stored"))
    is_stored = F.col("stored").isNotNull()
    newest = F.max(F.when(is_stored, F.struct("stored.created_at", "savepoint_id"))).over(Window.partitionBy("deployment_id", "alone"))["savepoint_id"]
    chosen = F.collect_list(F.when(is_stored, F.struct("stored.path"))).over(Window.partitionBy("deployment_id", "alone", "savepoint_id"))
    both = asking.unionByName(stored, allowMissingColumns=True).repartition("deployment_id", "alone").withColumn("chosen", chosen).withColumn("newest_id", newest)
    found = both.where("event is not null").select("event.*", "newest_id", F.explode_outer("chosen").alias("found"))
    return found.withColumn("chosen_path", F.col("found.path")).drop("found").repartition("deployment_name")


def fold_actions(events: DataFrame, registry: DataFrame, savepoints: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Every event with its outcome: event_id, deployment_name, kind, outcome, start_from, status, pending_action, savepoint_path, source.

    ``events``: event_id (unique), deployment_name, at_ms, kind, savepoint_id and skip_savepoint (of a resume request), path (of what was seen). They
    take effect by (at_ms, event_id). Checks come in the service's order: the deployment exists, it is in application mode (not asked of deletes and
    edits), the request is consistent, nothing is pending, the status fits, the chosen savepoint exists. ``status`` and ``pending_action`` are those after the event.
    ``start_from`` of an accepted resume is stateless, ``path:<p>`` of a chosen savepoint that is not the newest, or latest. A graceful stop that resolves with a path and a finished
    snapshot leave a savepoint (``savepoint_path`` with its ``source``); it is then the newest one.
    """
    after, outcome, stops = (_numbers(t) for t in _tables())
    reg = registry.select(F.col("id").alias("deployment_id"), "deployment_name", F.col("deployment_mode").alias("mode"),
                          (F.array_position(F.lit(STATUSES), F.col("status")) - 1).cast("int").alias("s0"), (F.array_position(F.lit(PENDING), F.coalesce("pending_action", F.lit(""))) - 1).cast("int").alias("p0"))
    plain = events.where("savepoint_id is null").join(reg, "deployment_name", "left").withColumns({"newest_id": F.lit(None).cast("long"), "chosen_path": F.lit(None).cast("string")})
    e = plain.unionByName(_with_savepoints(events.where("savepoint_id is not null").join(reg, "deployment_name", "left"), savepoints))
    kind = F.col("kind")
    skip = F.coalesce("skip_savepoint", F.lit(False))
    by_mode = kind.isin("stop", "force_stop", "savepoint", "resume")
    # what decides before the state does, and after it
    first = (F.when(F.col("deployment_id").isNull(), "not found: deployment").when(by_mode & (F.col("mode") != FL.APPLICATION), "invalid: not application mode")
             .when((kind == "resume") & F.col("savepoint_id").isNotNull() & skip, "invalid: both savepoint and skip"))
    then = F.when((kind == "resume") & F.col("savepoint_id").isNotNull() & ~skip & F.col("chosen_path").isNull(), "not found: savepoint")
    number = (F.array_position(F.lit(KINDS), kind) - 1).cast("int")
    # a request that is rejected whatever the state leaves it as it is
    e = e.withColumn("long", F.count(F.lit(1)).over(Window.partitionBy("deployment_name")) > whole)
    e = e.withColumn("first", first).withColumn("then", then).withColumn("number", F.when(F.col("first").isNull() & F.col("then").isNull(), number))
    item = F.struct("at_ms", "event_id", "number", number.alias("asked"), "kind", "savepoint_id", skip.alias("skip"), "chosen_path", "newest_id", "path", "first", "then")
    collected = [F.first(F.when(F.col("deployment_id").isNotNull(), F.col("s0") * len(PENDING) + F.col("p0"))).alias("start"), F.sort_array(F.collect_list(item)).alias("items")]
    step = lambda state, x: F.when(x["number"].isNull(), state).otherwise(_at(after, x["number"], state))
    # a savepoint that an event leaves, by the state it meets; none by an event of no deployment
    manual = lambda x: (x["kind"] == "snapshot") & x["path"].isNotNull() & x["first"].isNull()
    stop = lambda x, state: F.coalesce((_at(stops, x["number"], state) == 1) & x["path"].isNotNull(), F.lit(False))
    key = ["deployment_name", "deployment_id"]
    whole_ones = e.where(~F.col("long")).groupBy(*key).agg(*collected).select(*key, "items", F.col("start").alias("state"), F.lit(False).alias("left_before"))
    # the events of one long deployment in one hour; events of none are not folded and need no company
    hour = F.when(F.col("deployment_id").isNotNull(), F.floor(F.col("at_ms") / MILLIS)).otherwise(F.xxhash64("event_id"))
    # the key is one value that is never null: a null test on its parts would go below the exchange, which could then not be read again
    long_ones = e.where("long").withColumns({"who": F.struct(*key), "hour": hour})
    stretches = long_ones.repartition("who", "hour").groupBy("who", "hour").agg(*collected)
    # from every state (a null makes them nullable: an unknown kind leads to none), the state after a stretch and whether a savepoint is left in it
    through = lambda s: F.aggregate("items", F.struct(s.alias("state"), F.lit(False).alias("left")), lambda acc, x: F.struct(
        step(acc["state"], x).alias("state"), (acc["left"] | manual(x) | stop(x, acc["state"])).alias("left")))
    maps = stretches.where("start is not null").select("who", "hour", "start", F.transform(F.lit([*range(len(STATES)), None]), through).alias("m"))
    maps = maps.select("who", "start", F.struct("hour", F.col("m.state").alias("state"), F.col("m.left").alias("left")).alias("m"))
    steps = maps.groupBy("who").agg(F.first("start").alias("start"), F.sort_array(F.collect_list("m")).alias("maps"))
    entered = F.aggregate("maps", F.array(F.struct(F.col("start").alias("state"), F.lit(False).alias("left"))), lambda acc, m: F.concat(acc, F.array(F.struct(
        F.get(m["state"], F.element_at(acc, -1)["state"]).alias("state"), (F.element_at(acc, -1)["left"] | F.coalesce(F.get(m["left"], F.element_at(acc, -1)["state"]), F.lit(False))).alias("left")))))
    entries = steps.select("who", F.explode(F.arrays_zip(F.col("maps.hour").alias("hour"), F.slice(entered, 1, F.size("maps")).alias("entry"))).alias("z")).select("who", "z.hour", "z.entry")
    begun = stretches.join(entries, ["who", "hour"], "left").select("who.*", "items", F.coalesce("entry.state", "start").alias("state"), F.coalesce("entry.left", F.lit(False)).alias("left_before"))
    states = F.aggregate("items", F.array(F.col("state")), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    left = F.array_min(F.zip_with("items", F.slice("states", 1, F.size("items")), lambda x, state: F.when(manual(x) | stop(x, state), F.struct(x["at_ms"].alias("at_ms"), x["event_id"].alias("event_id")))))
    done = whole_ones.unionByName(begun).withColumn("states", states).withColumn("left", left).select(*key, "states", "left", "left_before", F.posexplode("items").alias("i", "x"))
    done = done.select(*key, "left", "left_before", F.get("states", F.col("i")).alias("before"), F.get("states", F.col("i") + 1).alias("after"), "x.*")
    # with a chosen savepoint that is missing, what the state objects to comes first
    by_state = _name(OUTCOMES, _at(outcome, F.col("asked"), F.col("before")))
    done = done.withColumn("outcome", F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("then").isNotNull() & (by_state == "accepted"), F.col("then")).otherwise(by_state))
    stopped = (F.col("outcome") == "resolved") & (_name([p for _, p in STATES], F.col("before")) == "stop") & (_name([s for s, _ in STATES], F.col("after")) == FL.SUSPENDED)
    known = F.col("deployment_id").isNotNull() & F.col("path").isNotNull()
    done = done.withColumn("source", F.when((kind == "snapshot") & known, "manual").when(stopped & known, "stop"))
    older = F.coalesce(F.col("savepoint_id") != F.col("newest_id"), F.lit(True)) | F.col("left_before") | F.coalesce(F.col("left") < F.struct("at_ms", "event_id"), F.lit(False))
    start_from = F.when((F.col("kind") == "resume") & (F.col("outcome") == "accepted"),
                        F.when(F.col("skip"), "stateless").when(F.col("savepoint_id").isNotNull() & older, F.concat(F.lit("path:"), "chosen_path")).otherwise("latest"))
    return done.select("event_id", "deployment_name", "kind", "outcome", start_from.alias("start_from"), _name([s for s, _ in STATES], F.col("after")).alias("status"),
                       F.nullif(_name([p for _, p in STATES], F.col("after")), F.lit("")).alias("pending_action"), F.when(F.col("source").isNotNull(), F.col("path")).alias("savepoint_path"), "source")
