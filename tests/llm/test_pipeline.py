import re
from collections import Counter

import corpus_pipeline
from corpus_fixtures import ODD, SF, odd_frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_simhash_dedup import brute as near
from tidepool.llm import common, queries, secret_scan
from tidepool.llm import quality_classifier as C


def test_every_stage_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(common.reread(stage(spark, states[-1], SF), "test"))
        if len(states) < len(corpus_pipeline.STAGES) + 1:
            assert states[-1].columns == columns, name
            assert [f.dataType for f in states[-1].schema] == [f.dataType for f in docs.schema]
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states[:5]]
    assert all(len(d) == s.count() for d, s in zip(rows, states, strict=False))

    held_out = common.id_fold(F.col("doc_id"), 5) == 0
    model = C.train(docs, queries.table(spark, SF, "labels"), where=~held_out)
    ids = list(rows[0])
    scores = model.scores([(rows[0][i]["text"] or "").encode() for i in ids])
    assert set(rows[1]) == {i for i, s in zip(ids, scores, strict=True) if s >= C.THRESHOLD}

    best = {}
    for i, r in rows[1].items():
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[body] = min(best.get(body, (1, 0)), (-len(r["text"] or ""), i))
    assert set(rows[2]) == {i for _, i in best.values()}

    assert set(rows[3]) == {c for _, _, c in near([(i, r["text"]) for i, r in rows[2].items()])}

    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        before = rows[3][i]["text"]
        assert r["text"] == secret_scan.redact_text(before, secret_scan.scan_text(before), "[SECRET]") and r["n_chars"] == len(r["text"])
        assert not secret_scan.base_spans(r["text"])

    t = Tokenizer.from_file(queries.BYTE_BPE)
    want = Counter({i: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in rows[4].items()})
    got = Counter()
    for r in states[5].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    # every sequence is gapless from 0 and holds no more than its capacity
    by = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("start"), F.count_distinct("offset").alias("places"), F.count("*").alias("pieces"))
    assert by.where("n <> end or start <> 0 or n > 2048 or places <> pieces").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark):
    """Nulls, ties, repeated rows and clashing columns pass every stage; so does an empty table."""
    for rows in ([*ODD, (90, "password=hunter2222 and more words"), (90, "password=hunter2222 and more words"), (91, "z*** y*** x### w### " * 40)], []):
        docs = odd_frame(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.reread(stage(spark, docs, SF), "test")
            assert docs.columns == columns, name
        left = docs.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left}
        if rows:
            ids = [r["doc_id"] for r in left]
            assert ids.count(90) <= 1 and ids.count(1) + ids.count(5) + ids.count(-9) <= 1
            assert all("hunter" not in (r["text"] or "") and r["k0"] == "x" for r in left)
        else:
            assert not packed
