import hashlib
import re

import duckdb
import numpy as np
from corpus_fixtures import ODD, SF, frame, odd_frame, rows_of

from tidepool.llm import exact_dedup as X
from tidepool.llm import queries as Q

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), n == 0, hashlib.sha256(body.encode()).hexdigest()) for n, m in enumerate(members)]
    return sorted(out, key=repr)


def test_odd_rows_and_ties(spark):
    rows = [*ODD, (20, "ab"), (21, "a b"), (22, "b a"), (-(1 << 63), "zz"), ((1 << 63) - 1, "zz"), (None, "zz"), (30, "a b"), (None, "longest zz z"), (31, "longestzzz")]
    assert rows_of(X.exact_dedup(odd_frame(spark, rows)), *COLUMNS) == brute(rows)
    assert X.exact_dedup(frame(spark, [])).count() == 0


def test_small_buckets_split(spark):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    docs = frame(spark, rows)
    assert rows_of(X.exact_dedup(docs, capacity=8, max_depth=8), *COLUMNS) == brute(rows)
    index, directory, depth = X.build_index(docs, capacity=8, max_depth=8)
    assert index.count() == 700 and depth >= 6 and directory.count() == 1 << depth
    assert index.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 4 * 700 >> 6
    # a bucket is a range of hashes
    ranges = sorted((r[1], r[2], r[0]) for r in index.selectExpr("bucket", "h").rdd.map(lambda r: (r[0], r[1] & (1 << 64) - 1)).groupByKey().map(lambda kv: (kv[0], min(kv[1]), max(kv[1]))).collect())
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(ranges, ranges[1:], strict=False))


def test_directory_doubles_only_where_overfull():
    counts = np.zeros(64, dtype=np.int64)
    counts[0] = 100
    counts[40:44] = 5
    depth, slots = X.split_directory(counts, 10)
    assert depth == 6 and len(slots) == 64 and slots[0][1] == 6
    assert slots[-1][1] < 6 and [b for b, _ in slots] == sorted(b for b, _ in slots)
    assert X.split_directory(np.zeros(64, dtype=np.int64), 10) == (0, [(0, 0)])


def test_colliding_hashes_are_chained(spark, monkeypatch):
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: X.F.lit(7).cast("long"))
    rows = [(i, f"t{i % 5}") for i in range(20)]
    assert rows_of(X.exact_dedup(frame(spark, rows)), *COLUMNS) == brute(rows)
    index = X.build_index(frame(spark, rows))[0]
    assert sorted(r["chain"] for r in index.collect()) == [1, 2, 3, 4, 5]


def test_query_matches_sql_and_brute(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(Q.ORACLE["op8_exact_dedup"])
    at = [[c[0] for c in sql.description].index(c) for c in COLUMNS]
    want = sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=repr)
    got = rows_of(Q.op8_exact_dedup(spark, SF), *COLUMNS)
    assert got == want == brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_deduplicate_keeps_one_row_each(spark):
    rows = [*ODD, (20, "ab"), (21, "a b"), (1, "one two three four five six")]
    out = X.deduplicate(odd_frame(spark, rows))
    assert out.columns == odd_frame(spark, rows).columns
    want = sorted(((i, k) for i, _, _, kept, k in brute(rows) if kept), key=repr)
    got = sorted(((r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == want


def test_plan_is_native(spark):
    plan = X.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_hot_hashes_have_several_owners(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i % 50}") for i in range(900)] + [(5, "sametext")] * 7
    docs = frame(spark, rows)
    assert rows_of(X.exact_dedup(docs, hot=10, capacity=4, max_depth=6), *COLUMNS) == brute(rows)
    plan = X.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_owners_hold_their_bucket(spark):
    """Rows go where the directory sends them: with a directory that names one bucket, all chains are in it, and still told apart by their bytes."""
    rows = [(i, f"text {i % 40}") for i in range(200)]
    index, directory, depth = X.build_index(frame(spark, rows), capacity=1000, max_depth=6)
    assert depth == 0 and directory.count() == 1 and {r["bucket"] for r in index.collect()} == {0} and index.count() == 40
    split, directory, depth = X.build_index(frame(spark, rows), capacity=3, max_depth=6)
    slots = {r["slot"]: r["bucket"] for r in directory.collect()}
    assert len(set(slots.values())) > 8 and all(r["bucket"] == slots[(r["h"] & (1 << 64) - 1) >> (64 - depth)] for r in split.collect())
