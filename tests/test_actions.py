"""Action requests folded per deployment, candidates of related events, checkpoint configuration."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidepool.operators import actions as AN
from tidepool.operators import config_rules as CR
from tidepool.operators import diagnostics as D

EVENTS = "event_id long, deployment_name string, at_ms long, kind string, savepoint_id long, skip_savepoint boolean, path string"
REGISTRY = "id long, deployment_name string, deployment_mode string, status string, pending_action string"
SAVEPOINTS = "id long, deployment_id long, path string, created_at timestamp_ntz"
HOUR = AN.MILLIS


def _fold(spark, events, registry, savepoints=(), whole=AN.WHOLE):
    out = AN.fold_actions(spark.createDataFrame(events, EVENTS), spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(list(savepoints), SAVEPOINTS), whole)
    return {r["event_id"]: r for r in out.collect()}


def _event(i, name, at, kind, sid=None, skip=None, path=None):
    return (i, name, at, kind, sid, skip, path)


@pytest.mark.parametrize("gap", [1, HOUR])
def test_requests_in_order(spark, gap):
    """The same decisions within an hour and hours apart; ids decide ties of time."""
    kinds = ["stop", "resume", "savepoint", "saw:running", "saw:suspended", "resume", "saw:suspended", "saw:running", "delete", "edit", "saw:failed", "gone", "delete", "stop"]
    got = _fold(spark, [_event(i, "d1", 5 + i * gap, k, path="s3://p" if k == "saw:suspended" else None) for i, k in enumerate(kinds)], [(1, "d1", "application", "running", None)], whole=5)
    assert [got[i]["outcome"] for i in range(len(kinds))] == [
        "accepted", "conflict: operation in progress", "accepted", "unchanged", "resolved", "accepted", "unchanged", "resolved", "accepted", "conflict: not editable",
        "unchanged", "resolved", "conflict: already deleted", "conflict: not running"]
    assert [(got[i]["status"], got[i]["pending_action"]) for i in (0, 4, 5, 7, 8, 11)] == [("running", "stop"), ("suspended", None), ("suspended", "resume"), ("running", None), ("running", "delete"), ("deleted", None)]
    assert (got[4]["savepoint_path"], got[4]["source"]) == ("s3://p", "stop") and got[6]["source"] is None


def test_reasons_come_in_the_services_order(spark):
    day = lambda d: datetime(2024, 1, d)
    reg = [(1, "s", "session", "running", None), (2, "r", "application", "running", None), (3, "f", "application", "failed", ""), (4, "p", "application", "suspended", "stop")]
    sp = [(31, 3, "s3://old", day(1)), (32, 3, "s3://new", day(2)), (41, 4, "s3://x", day(1))]
    events = [_event(1, "ghost", 1, "stop"), _event(2, "s", 1, "stop"), _event(3, "s", 2, "resume", 1, True), _event(4, "s", 3, "delete"), _event(5, "r", 1, "resume", 1, True), _event(6, "r", 2, "resume", 99, False),
              _event(7, "p", 1, "resume", 99), _event(8, "f", 1, "resume", 41), _event(9, "f", 2, "resume", 32), _event(10, "f", 3, "saw:failed"), _event(11, "f", 4, "resume", 31, False),
              _event(12, "f", 5, "saw:running"), _event(13, "f", 6, "snapshot", path="s3://later"), _event(14, "f", 7, "saw:failed"), _event(15, "f", 8, "resume", 32), _event(16, "f", 9, "saw:failed"), _event(17, "f", 10, "resume", None, True)]
    got = _fold(spark, events, reg, sp)
    assert [got[i]["outcome"] for i in range(1, 10)] == ["not found: deployment", "invalid: not application mode", "invalid: not application mode", "accepted", "invalid: both savepoint and skip",
                                                          "conflict: not resumable", "conflict: operation in progress", "not found: savepoint", "accepted"]
    assert [got[i]["start_from"] for i in (9, 11, 15, 17)] == ["latest", "path:s3://old", "path:s3://new", "stateless"]  # a snapshot seen meanwhile is the newest
    assert got[13]["source"] == "manual" and got[1]["status"] is None


def test_long_sequences_against_a_plain_fold(spark):
    """One deployment holds most events, over many hours: stretches compose to what one pass gives."""
    rng = random.Random(3)
    events = [_event(i, "hot" if i % 4 else f"d{i % 9}", rng.randrange(40 * HOUR), rng.choice(AN.KINDS), path="s3://x") for i in range(3000)]
    reg = [(0, "hot", "application", "running", None), *((i + 1, f"d{i}", "application", rng.choice(AN.STATUSES), rng.choice([None, "", "stop", "resume"])) for i in range(9))]
    got, state = _fold(spark, events, reg), {n: (s, p or "") for _, n, _, s, p in reg}
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        outcome, *state[e[1]] = AN.transition(*state[e[1]], e[3])
        assert (got[e[0]]["outcome"], got[e[0]]["status"], got[e[0]]["pending_action"] or "") == (outcome, *state[e[1]])
    assert _fold(spark, [], reg) == {}


@pytest.mark.parametrize("whole", [3, AN.WHOLE])
def test_savepoint_of_an_earlier_hour_is_newer(spark, whole):
    """Rows that name a savepoint find it in their own deployment only, whole or dealt by hours; repeated registry and savepoint rows repeat the events."""
    reg = [(1, "a", "application", "failed", None), (2, "b", "application", "failed", None), (3, "c", "application", "failed", None), (3, "c", "application", "failed", None)]
    sp = [(7, 1, "s3://one", datetime(2024, 1, 2)), (7, 2, "s3://two", datetime(2024, 1, 1)), (8, 2, "s3://new", datetime(2024, 1, 2)), (9, 3, "s3://c", None), (9, 3, None, None)]
    events = [_event(10 * k + i, n, i * HOUR, kind, 7 if kind == "resume" else None, path="s3://later" if kind == "snapshot" else None)
              for k, n in enumerate(["a", "b", "ghost"]) for i, kind in enumerate(["resume", "saw:failed", "snapshot", "resume", "saw:failed", "resume"])]
    got = _fold(spark, events, reg, sp, whole)
    assert [got[i]["start_from"] for i in (0, 3, 5)] == ["latest", "path:s3://one", "path:s3://one"] and [got[i]["start_from"] for i in (10, 13)] == ["path:s3://two"] * 2
    assert {got[i]["outcome"] for i in range(20, 26)} == {"not found: deployment"} and all(got[i]["status"] is None and got[i]["source"] is None for i in range(20, 26))
    out = AN.fold_actions(spark.createDataFrame([_event(1, "c", 1, "resume", 9)], EVENTS), spark.createDataFrame(reg, REGISTRY), spark.createDataFrame(sp, SAVEPOINTS), whole)
    assert sorted(r["outcome"] for r in out.collect()) == ["accepted", "conflict: operation in progress", "not found: savepoint", "not found: savepoint"]


def test_few_candidates_are_left_to_shuffle(spark):
    names = spark.range(3000).select(F.col("id"), F.concat(F.lit("job-"), (F.col("id") * 7919 % 100000).cast("string")).alias("deployment_name"), F.lit("default").alias("namespace"))
    texts = spark.range(2000).select(F.col("id").alias("uid"), F.lit("default").alias("namespace"), F.concat(F.lit("container job-"), (F.col("id") * 31 % 100000).cast("string"), F.lit("-x failed in job-run-0123456789-abc")).alias("t"))
    own = {r["deployment_name"] for r in names.collect()}
    found = D.candidate_names(names, texts).collect()
    hits = {(r["uid"], n) for r in texts.collect() for n in {r["t"][i:j] for i in range(len(r["t"])) for j in range(i + 5, min(i + 10, len(r["t"])) + 1)} & own}
    assert hits <= {(r["uid"], r["cand"]) for r in found} and hits
    assert len(found) <= 1.2 * len(hits) + 20
    other = D.candidate_names(names.withColumn("namespace", F.lit("other")), texts)
    assert other.count() <= 20
    assert D.candidate_names(names.limit(0), texts).count() == 0


def test_configuration_layers(spark):
    cfg = spark.createDataFrame([(1, "a" * 70, 3, True, {"state.backend.type": "rocksdb", "s3.endpoint": "mine", "x": "y"}), (2, "b", None, False, None)],
                                "id long, deployment_name string, tm_slots int, has_artifact boolean, flink_configuration map<string,string>")
    got = {r["id"]: r["configuration"] for r in CR.checkpoint_configuration(cfg, {"s3.endpoint": "theirs"}).collect()}
    assert got[1] == {"taskmanager.numberOfTaskSlots": "3", "user.artifacts.raw-http-enabled": "true", "s3.endpoint": "mine", "s3.path.style.access": "true", "state.backend.type": "rocksdb",
                      "execution.checkpointing.interval": "30000", "execution.checkpointing.mode": "EXACTLY_ONCE", "execution.checkpointing.min-pause": "10000",
                      "state.checkpoints.dir": f"s3://flink-{'a' * 57}/checkpoints", "state.savepoints.dir": f"s3://flink-{'a' * 57}/savepoints", "x": "y"}
    assert "user.artifacts.raw-http-enabled" not in got[2] and got[2]["state.backend.type"] == "hashmap" and got[2]["s3.endpoint"] == "theirs"
