import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import quality_classifier as C


def test_every_labelled_row_is_learnt_from(spark):
    """Whichever part of the labelled rows carries a marker word, the model knows it: no row is left out by a cap."""
    n, cap = 240, 20
    rows = [(i, ("good news of the day " if i % 2 else "bad news of the day ") * 3 + f"w{i}x{i * 7919 % 997}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    model = C.train(docs, labels, per_class=cap)
    for i, text in rows:
        stream, start, end = C.grams([text.encode()])
        own = stream[end[0] - len(text.rsplit(" ", 1)[1]) : end[0]]
        assert np.count_nonzero(model.gram_w[own]) == len(own), i
    out = C.score(docs, model, ["doc_id"]).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_a_rare_label_goes_into_every_block(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 4) for i in range(330)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(330)], "doc_id long, quality int")
    model = C.train(docs, labels, per_class=50)
    assert model.constant is None and np.isfinite(model.gram_w).all() and model.slope > 0


@pytest.mark.parametrize("few", [3, 4096])
@pytest.mark.parametrize("q", [0.05, 0.3, 0.5, 0.99])
def test_quantile_of_all_rows_is_the_sorted_one(spark, few, q):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=150), np.full(20, 0.25), rng.normal(size=31) * 1e6])
    y = rng.integers(0, 2, len(values))
    mass = {0: 0.7 / (y == 0).sum(), 1: 0.3 / (y == 1).sum()}
    rows = spark.createDataFrame([(float(v), int(k)) for v, k in zip(values, y, strict=True)], "s double, y int")
    pair = C.ordered_pair(rows, mass, q, few)
    order = np.lexsort([y, values])
    assert np.mean(pair) == pytest.approx(C.weighted_quantile(values[order], np.where(y == 1, mass[1], mass[0])[order], q))
    assert pair[0] <= pair[1] and rows.where(F.col("s") == pair[0]).count() > 0


def test_texts_are_shuffled_once_and_only_of_labelled_rows(spark, monkeypatch):
    """Op7, disk: no table of texts is written and no join shuffles them; a filter that lets everything through changes nothing."""
    written = []
    reread = C.common.reread
    monkeypatch.setattr(C.common, "reread", lambda df, kind: written.append(df.columns) or reread(df, kind))
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i * 7919 % 997} ") for i in range(900)] + [(3, "once more"), (None, "no key"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(300)] + [(7, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    model = C.train(docs, labels, per_class=40)
    assert written == [["s", "y"]]
    monkeypatch.setattr(C.common, "filter_bits", lambda n: 64)
    assert np.array_equal(C.train(docs, labels, per_class=40).gram_w, model.gram_w)


def test_key_filter_knows_its_keys_and_few_others(spark):
    bits = C.common.filter_bits(1000)
    keys = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    word = C.common.key_word(C.common.key_filter(keys, "k", "y", bits), F.col("k"), bits)
    hit = C.common.has_mark(word, F.col("k"), (F.col("k") % 2).cast("int"))
    found = [r["k"] for r in spark.range(20000).select(F.col("id").alias("k")).where(hit).collect()]
    assert set(range(1000)) <= set(found) and len(found) < 1000 + 19000 * 0.05
