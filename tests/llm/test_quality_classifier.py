import math

import numpy as np
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import quality_classifier as C
from tidepool.llm import queries as Q


def test_pairs_set_either_label_against_the_other():
    y = np.array([1] * 50 + [0] * 7)
    win, lose = C.preference_pairs(y)
    assert (y[win] == 1).all() and (y[lose] == 0).all()
    assert set(win) == set(range(50)) and set(lose) == set(range(50, 57))


def test_quantile_lies_between_neighbours():
    assert C.weighted_quantile(np.array([4.0, 1, 2, 3]), np.ones(4), 0.5) == pytest.approx(2.5)
    assert C.weighted_quantile(np.array([1.0, 2]), np.array([0.1, 0.9]), 0.1) == pytest.approx(1.5)


def test_gradient_learns_the_preference():
    rng = np.random.default_rng(0)
    y = (rng.random(200) < 0.8).astype(int)
    dense = np.zeros((200, len(C.SHAPE)))
    dense[:, 0] = np.where(y == 1, 0.1, 0.9) + rng.normal(0, 0.02, 200)
    m = C.fit(dense, np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0), y, float((y == 0).mean()))
    s = dense @ m.shape_w
    assert (s[y == 1] > m.cut).all() and (s[y == 0] < m.cut).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.99
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_query_rows(spark):
    out = Q.op7_quality_classifier(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark):
    docs = odd_frame(spark, [*ODD, (70, "a*** b*** c### " * 30), (71, "the quick brown fox " * 9)])
    labels = spark.createDataFrame([(70, 0), (71, 1), (1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = C.train(docs, labels)
    out = C.score(docs, model, ["doc_id"]).collect()
    assert len(out) == len(ODD) + 2
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert by[70] == 0 and by[71] == 1
    kept = C.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 70").count() == 0 and kept.where("doc_id = 71").count() == 1
    one = C.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in C.score(docs, one, ["doc_id"]).collect()} == {1.0}
    assert C.score(frame(spark, []), C.train(frame(spark, []), labels.limit(0)), ["doc_id"]).count() == 0


def brute_shape(text):
    """The shape features again, character by character."""
    body = text.encode()
    spaces = " \t\n\x0b\x0c\r"
    words = [w for w in "".join(" " if c in spaces else c for c in text).split(" ") if w]
    if not words:
        return [0.0] * 12 + [1.0]
    letters = sum(len(w.encode()) for w in words)
    counts = {w: words.count(w) for w in set(words)}
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    return [sum(c in "#*$%&|<>!?@^~{}[]\\/_=+" for c in text) / (letters + 100), sum("A" <= c <= "Z" for c in text) / (letters + 100), sum("0" <= c <= "9" for c in text) / (letters + 100),
            min(1.0, 2 * sum(w in ("|", "-", "*", "/", "\u2022") for w in words) / (n + 20)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n + 20), (n - len(counts)) / (n + 20), letters / (n + 20) / 10,
            sum(len(w.encode()) > 25 for w in words) / (n + 20), (max(counts.values()) - 1) / (n + 20), (len(lines) - len(set(lines))) / (len(lines) + 2), min(2.0, n / (len(lines) + 1) / 50),
            min(2.0, math.log(1 + n) / 8), 0.0] if body else None


def brute_score(model, text):
    padded, n = b"   " + text.encode(), len(text.encode())
    grams = sum(float(model.gram_w[(int.from_bytes(padded[i : i + 4], "big") * 0x9E3779B97F4A7C15 % 2**64) >> 50]) for i in range(n))
    z = sum(a * b for a, b in zip(brute_shape(text), model.shape_w.tolist(), strict=True)) + grams / (n + 100)
    z = model.slope * (z - model.cut) + math.log(0.3 / 0.7)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_against_plain_sums(spark):
    docs = Q.table(spark, SF, "documents")
    model = C.train(docs, Q.table(spark, SF, "labels"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows |= {10**9 + i: t for i, t in enumerate(["", " ", "\n\n", "a", "a a a | - \u2022", "x" * 30 + " y", "é#É \U0001f600 9", "one\ntwo\none\n"])}
    frame_ = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in C.score(frame_, model, ["doc_id"]).collect():
        assert r["score"] == pytest.approx(brute_score(model, rows[r["doc_id"]]), abs=2e-5), rows[r["doc_id"]][:50]
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_fit_is_a_minimum_of_the_pair_loss():
    """No small step from the weights found lowers the mean logistic loss of the preference pairs."""
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.5).astype(int)
    dense = rng.random((60, len(C.SHAPE))) + 0.3 * y[:, None] * rng.random(len(C.SHAPE))
    m = C.fit(dense, np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0), y, 0.5, steps=4000)
    win, lose = C.preference_pairs(y)

    def loss(w):
        return np.mean([math.log(1 + math.exp(-(dense[i] - dense[j]) @ w)) for i, j in zip(win, lose, strict=True)]) + 0.5e-4 * w @ w

    best = loss(m.shape_w)
    assert best < math.log(2)
    for _ in range(40):
        assert loss(m.shape_w + 0.05 * rng.standard_normal(len(C.SHAPE))) > best - 1e-4
