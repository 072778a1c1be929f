import re

import numpy as np
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import quality_rules as R
from tidepool.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def counts(text):
    body = (text or "").encode()
    words = body.split()
    return R.base_counts(body, words, R.word_codes(words))


@pytest.mark.parametrize("text", [None, "", " ", "a\nb\na\n\na ", "x " * 9, "x " * 8, "a b c d e f g h " * 3 + "tail", "é ü\x1c#*$ %&|<>\x85", "p q r s t u v w x " * 2, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"])
def test_base_counts(text):
    assert counts(text) == brute(text)[:5]


def test_base_counts_random():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n"), size=rng.integers(0, 200)))
        assert counts(text) == brute(text)[:5]


def test_query_base_matches_brute(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.op4_quality_rules(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= R.MIN_PROBABILITY)


def test_verdict_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = R.train(docs, labels, where="doc_id % 2 = 0", per_class=200)
    scored = R.score(docs.join(labels, "doc_id").where("doc_id % 2 = 1"), model, ["doc_id", "quality"]).where("not base_failed").toPandas()
    assert (scored[scored.quality == 1].kept).mean() > 0.99
    assert (scored[scored.quality == 0].kept).mean() < 0.05


def test_odd_rows_and_missing_labels(spark):
    docs = odd_frame(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    model = R.train(docs, labels)
    out = R.score(docs, model, ["doc_id", "text"]).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
    assert R.train(frame(spark, []), labels.limit(0)).probabilities(*R.featurise([b"x"], [R.word_codes([b"x"])]), 1)[0] > 0.99
    assert R.score(frame(spark, []), model, ["doc_id"]).count() == 0


def test_platt_orders_and_calibrates():
    z = np.linspace(-4, 4, 400)
    y = (np.random.default_rng(0).random(400) < 1 / (1 + np.exp(-2 * z))).astype(float)
    slope, offset = R._platt(z, y)
    assert slope == pytest.approx(2, abs=0.7) and abs(offset) < 0.5


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that is the same for all windows, only windows of equal words count."""
    rng = np.random.default_rng(6)
    for _ in range(50):
        words = [f"w{i}" for i in rng.integers(0, 3, 60)]
        words[40:52] = words[5:17]
        codes = R.word_codes([w.encode() for w in words])
        windows = [tuple(words[i : i + 8]) for i in range(53)]
        covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
        assert R.repeated_words(codes) == len(covered)
        with monkeypatch.context() as m:
            m.setattr(R, "_M1", np.uint64(0))
            assert R.repeated_words(codes) == len(covered)
