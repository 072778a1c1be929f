import numpy as np
import pyarrow as pa

from tidepool.llm import common


def test_sample_is_the_smallest_hashes_of_each_stratum(spark):
    rows = [(i, "a" if i % 5 else "b") for i in range(3000)] + [(7, "a")] * 50 + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {(r["k"], r["s"]) for r in common.sample_ids(df, "k", "s", 100).collect()}
    hashed = df.where("k is not null and s is not null").distinct().selectExpr("k", "s", "xxhash64(cast(k as string), 7) as h").collect()
    want = set()
    for s in ("a", "b"):
        want |= {(r["k"], s) for r in sorted((r for r in hashed if r["s"] == s), key=lambda r: (r["h"], r["k"]))[:100]}
    assert got == want and len(got) == 200
    assert common.sample_ids(df, "k", "s", 5000).count() == 3000
    assert common.sample_ids(df.limit(0), "k", "s", 10).count() == 0


def test_segment_sums_over_windows():
    rng = np.random.default_rng(0)
    values = rng.random(500).astype(np.float32)
    starts = np.array([0, 10, 10, 40, 200, 499])
    ends = np.array([10, 10, 35, 200, 450, 500])
    for width in (1, 7, 64, 500):
        out = np.zeros(len(starts))
        for a, b in common.windows(len(values), width):
            common.segment_sums(values[a:b], starts, ends, a, out)
        assert np.allclose(out, [values[s:e].sum() for s, e in zip(starts, ends, strict=True)], atol=1e-4)


def test_ragged_take():
    values = [np.array(v, "<u4").tobytes() for v in ([1], [], [2, 3], [4, 5, 6])]
    ids, count = common.ragged_take(values, np.array([3, 0, 1, 2, 3]), np.array([1, 0, 0, 0, 0]))
    assert ids.tolist() == [5, 6, 1, 2, 3, 4, 5, 6] and count.tolist() == [2, 1, 0, 2, 3]


def test_groups_keep_all_rows_and_stay_small():
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["x" * (i * 100) if i % 7 else None for i in range(60)])], names=["i", "t"])
    parts = list(common.groups(batch, 5000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(60)) and len(parts) > 10
    assert len(list(common.groups(batch.slice(3, 1), 10))) == 1
