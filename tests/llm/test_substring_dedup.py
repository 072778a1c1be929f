"""Substring dedup against a count of all windows, written on its own from the rules."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import queries
from tidepool.llm import substring_dedup as S

COLUMNS = ["doc_id", "n_words", "n_removed", "kept"]


def brute(rows, window=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    counts = Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if counts[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def passages(seed, n=120, words=40):
    """Texts that share stretches of all lengths, at any offset, also within a text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 34, 35, 36, 50, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + (p := rng.choice(shared))[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize(("window", "prefix", "limit"), [(35, 8, 20_000), (35, 8, 3), (6, 6, 5), (7, 1, 4), (2, 1, 10_000)])
def test_shared_passages_against_all_windows(spark, window, prefix, limit):
    """With a low limit the suffixes of frequent prefixes are split by whole windows; both ways meet here."""
    rows = passages(window)
    assert got(S.dedup(frame(spark, rows), window=window, prefix=prefix, limit=limit)) == brute(rows, window)


def test_subtrees_in_small_batches(spark):
    """Groups are never cut where a task goes on to its next trees."""
    rows = passages(3, 60)
    texts = S._texts(frame(spark, rows), "doc_id", "text")
    live = texts.join(S.anchor_prefixes(texts).groupBy("id0", "th").agg(S.F.collect_set("at").alias("ats")), ["id0", "th"])
    found = S.snippets(live.select("id0", "th", "none", "text", "ats"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {tuple(r) for r in S.subtree_repeats(found, budget=1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == {tuple(r) for r in S.subtree_repeats(found).collect()} and small


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    rows = [*ODD, (20, passage), (21, "x " + passage + " y"), (22, passage[:-1]), (23, passage + " " + passage), (24, "the " * 34), (25, "the " * 34), (26, "all " * 36), (None, passage + "\n\nend"), (None, passage + "\n\nend")]
    assert got(S.dedup(odd_frame(spark, rows))) == brute(rows)
    assert got(S.dedup(frame(spark, []))) == []


def test_query_matches_sql_and_brute(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)), key=repr)
    assert any(r[2] for r in want) and not all(r[2] for r in want)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in queries.op11_substring_dedup(spark, SF).select(*columns).collect()), key=repr) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op11_substring_dedup']})").fetchall(), key=repr) == want


def test_nodes_stand_for_exact_sequences():
    rng = np.random.default_rng(1)
    for window in (1, 2, 3, 5, 8, 35):
        code = rng.integers(0, 3, 400)
        code[200:300] = code[:100]
        ends = np.array([150, 320, 400])
        rest = ends[np.searchsorted(ends, np.arange(400), "right")] - np.arange(400)
        own = [tuple(code[i : i + window]) if rest[i] >= window else None for i in range(400)]
        counts = Counter(own)
        assert S.repeated_starts(code, rest, window).tolist() == [w is not None and counts[w] > 1 for w in own]


def test_every_window_has_an_anchor():
    """Windows are dealt once, and equal windows by the same prefix at the same place."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 34, 35, 36, 300)]
    texts.append(texts[-1][20:400])
    words = S.Words(pa.array(texts))
    at, runs, key = words.anchors(35, 8)
    dealt = {s: int(k) for a, m, k in zip(at.tolist(), runs.tolist(), key, strict=True) for s in range(a, a + m)}
    split = [t.split() for t in texts]
    starts = {int(words.start[d]) + s: tuple(w[s : s + 35]) for d, w in enumerate(split) for s in range(len(w) - 34)}
    assert dealt.keys() == starts.keys()
    by_window = {}
    for s, w in starts.items():
        assert by_window.setdefault(w, dealt[s]) == dealt[s]
