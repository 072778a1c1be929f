import math
from collections import defaultdict

import numpy as np
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import language_id as L
from tidepool.llm import queries as Q


def brute_bits(train: dict[str, list[bytes]], text: bytes, order: int) -> dict[str, float]:
    """Code lengths by walking dict-based context trees byte by byte."""
    out = {}
    for lang, bodies in train.items():
        seen = defaultdict(lambda: defaultdict(int))
        for body in bodies:
            padded = b"\n" * order + body
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    seen[padded[i - k : i]][padded[i]] += 1
        bits, padded = 0.0, b"\n" * order + text
        for i in range(order, len(padded)):
            for k in range(order, -1, -1):
                ctx = seen.get(padded[i - k : i])
                if ctx is None:
                    continue
                n, d = sum(ctx.values()), len(ctx)
                if padded[i] in ctx:
                    bits -= math.log2(ctx[padded[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
            else:
                bits += 8
        out[lang] = bits
    return out


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_match_walked_trees(order):
    rng = np.random.default_rng(order)
    train = {lang: [bytes(rng.choice(list(letters), size=rng.integers(1, 60))) for _ in range(6)] for lang, letters in (("aa", b"abc "), ("bb", b"bcd "), ("cc", "é".encode() + b"x"))}
    counts = [(lang, *c) for lang, bodies in train.items() for c in L.count_ngrams(bodies, order)]
    model = L.freeze(counts, order)
    texts = [b"", b"a", b"zzz", b"abcd abcd", b"\xc3\xa9x\xc3", bytes(rng.choice(list(b"abcdx \n"), size=400))]
    got = model.code_lengths(texts)
    for text, row in zip(texts, got, strict=True):
        want = brute_bits(train, text, order)
        assert row == pytest.approx([want[x] for x in model.languages], rel=1e-4, abs=1e-3)


def test_long_text_spans_windows():
    model = L.freeze([("a", *c) for c in L.count_ngrams([b"hello world"], 4)] + [("b", *c) for c in L.count_ngrams([b"hallo welt"], 4)], 4)
    once, many = model.code_lengths([b"x hello\n" * 10])[0], model.code_lengths([b"x hello\n" * 100_000])[0]
    assert many == pytest.approx(once * 10_000, rel=0.05)


def test_held_out_accuracy_and_columns(spark):
    out = Q.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(truth, on="doc_id")
    assert len(both) == len(truth) == len(out)
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, per_language=20)
    out = [tuple(r) for r in L.predict(odd_frame(spark, ODD), model, ["doc_id"]).select("doc_id", "lang_pred", "score").collect()]
    assert len(out) == len(ODD)
    unknown = sorted((r[0] for r in out if r[1] == "und" and r[2] == 0), key=str)
    assert unknown == [2, 3, 4, 7, None]
    same = {r[1:] for r in out if r[0] in (1, 5)}
    assert len(same) == 1


def test_nothing_to_learn(spark):
    empty = frame(spark, [])
    assert L.train(empty) is None
    assert [r["lang_pred"] for r in L.predict(frame(spark, [(1, "abc")]), None, ["doc_id"]).collect()] == ["und"]
    assert L.predict(empty, None, ["doc_id"]).count() == 0
