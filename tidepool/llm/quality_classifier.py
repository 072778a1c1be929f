"""Quality classifier: Bradley-Terry ranking learnt from preference pairs, cut at a score quantile.

A document's strength is linear in its features: shape features of the text (shares of symbols,
capitals, digits and separators, repetition of words and lines, word lengths, size) and the shares of its
hashed byte 4-grams. Every preference pair is one document of label 1 and one of label 0; the
model gives the first a win with probability sigma(strength difference), and the logistic loss on the
feature differences is minimised over ``PAIRS`` partners of every learning document. The cut is the quantile of
the learning rows' strengths at the share of label 0; ``score`` is the logistic of the strength,
scaled on the learning rows and shifted so that the cut is exactly ``THRESHOLD``.

Every labelled row that may be used is learnt from (whole texts). Rows are dealt by the hash of their id into blocks of about ``PER_CLASS`` of
each label, one Spark group each, so a task holds one block whatever the input; rows of the rarer label go into as many blocks as that takes. A block's weights
minimise the loss of its pairs, and the model's weights are the mean over all blocks (one-shot parameter mixing). Texts are shuffled once, to their blocks, where
their labels meet them; a Bloom filter of the labels' keys keeps nearly all other texts out, and one that it lets through by chance has no label in its block. Cut and scale are exact
quantiles of the model's strengths of all learning rows, found by counting in ever finer bins. Scoring is a narrow pass with a fixed-size broadcast.

Defined results: null counts as empty and is scored by the strength of an empty text. Without rows of both
labels every score is the share of label 1, or 1 without any label. Repeated rows are scored alike;
other columns are not touched; rows with null ids are scored and never learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS, PAIRS, THRESHOLD = 800, 8, 0.3
#: Characters without weight that every text has besides its own, so that short texts say less.
PRIOR = 100
BITS = 14
BUCKETS = 1 << BITS
SHAPE = ("symbols", "capitals", "digits", "separators", "adjacent", "repeats", "word_length", "long_words", "top_word", "dup_lines", "line_words", "size", "empty")
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
_SYMBOL = b"#*$%&|<>!?@^~{}[]\\/_=+"
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"


def shape(body: bytes) -> list[float]:
    """Shape features of one text, each of about 0 to 1."""
    words = body.split()
    n, size = len(words), len(body)
    if not n:
        return [0.0] * (len(SHAPE) - 1) + [1.0]
    letters = sum(map(len, words))
    marks, many = letters + PRIOR, n + PRIOR // 5
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in body.split(b"\n") if x]
    return [
        (size - len(body.translate(None, _SYMBOL))) / marks,
        (size - len(body.translate(None, _UPPER))) / marks,
        (size - len(body.translate(None, _DIGIT))) / marks,
        min(1.0, sum(seen.get(x, 0) for x in (b"|", b"-", b"*", b"/", b"\xe2\x80\xa2")) * 2 / many),
        sum(map(bytes.__eq__, words, words[1:])) / many,
        (n - len(seen)) / many,
        letters / many / 10,
        sum(len(w) > 25 for w in words) / many,
        (max(seen.values()) - 1) / many,
        (len(lines) - len(set(lines))) / (len(lines) + 2),
        min(2.0, n / (len(lines) + 1) / 50),
        min(2.0, np.log1p(n) / 8),
        0.0,
    ]


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 4-gram at each byte of the joined texts, and every text's start and end there."""
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    buffer = np.frombuffer(b"   " + b"   ".join(bodies), dtype=np.uint8).astype(np.uint64)
    n = len(buffer) - 3
    code = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(4):
        code = (code << np.uint64(8)) | buffer[j : j + n]
    starts = np.cumsum(sizes + 3) - sizes - 3
    return ((code * _MIX) >> _SHIFT).astype(np.int32), starts, starts + sizes


@dataclass
class BradleyTerry:
    """Weights of shape features and buckets; ``cut`` and ``slope`` place the logistic."""

    shape_w: np.ndarray
    gram_w: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def strengths(self, bodies: list[bytes]) -> np.ndarray:
        out = np.array([shape(b) for b in bodies]) @ self.shape_w
        stream, start, end = grams(bodies)
        total = np.zeros(len(bodies))
        for x, y in common.windows(len(stream), 1 << 20):
            common.segment_sums(self.gram_w[stream[x:y]], start, end, x, total)
        return out + total / (end - start + PRIOR)

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bodies), self.constant)
        z = self.slope * (self.strengths(bodies) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def preference_pairs(y: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (winner, loser): every document of either label meets ``pairs`` partners of the other."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(len(good), len(bad))
    i, j = np.repeat(np.arange(n), pairs), np.tile(np.arange(pairs), n)
    stride = max(1, n // pairs)
    return good[(i + j * stride) % len(good)], bad[(i + j * stride * 7 + j) % len(bad)]


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Middle between the neighbours at the quantile."""
    order = np.argsort(values, kind="stable")
    mass = np.cumsum(weights[order]) / weights.sum()
    i = int(np.searchsorted(mass, q - 1e-9))
    i = min(i, len(values) - 1)
    return float((values[order][i] + values[order][min(i + 1, len(values) - 1)]) / 2)


class _Runs:
    """Sums of ``val * x[other]`` over the entries of each key, keys from 0 to ``size`` - 1."""

    def __init__(self, key: np.ndarray, other: np.ndarray, val: np.ndarray, size: int):
        order = np.argsort(key, kind="stable")
        self.other, self.val, self.size = other[order].astype(np.intp), val[order].astype(np.float32), size
        self.keys, self.starts = np.unique(key[order], return_index=True)

    def sums(self, x: np.ndarray, buffer: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.val):
            np.take(x, self.other, out=buffer, mode="clip")
            np.multiply(buffer, self.val, out=buffer)
            out[self.keys] = np.add.reduceat(buffer, self.starts)
        return out


def fit(dense: np.ndarray, doc: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, share0: float, steps: int = 100, l2: float = 1e-4) -> BradleyTerry:
    """Minimise the mean logistic loss of the pairs; then place cut and slope."""
    win, lose = preference_pairs(y)
    n, wide = len(y), dense.shape[1]

    # the same entries by document and by bucket, so that both directions are sums of runs
    by_doc, by_idx, buffer = _Runs(doc, idx, val, n), _Runs(idx, doc, val, BUCKETS), np.empty(len(val))

    def strength(w: np.ndarray) -> np.ndarray:
        return dense @ w[:wide] + by_doc.sums(w[wide:], buffer)

    def back(r: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradient of the pairs' sum of r times the strength difference."""
        g = np.bincount(win, weights=r, minlength=n) - np.bincount(lose, weights=r, minlength=n)
        return np.concatenate([dense.T @ g, by_idx.sums(g, buffer)]) + l2 * w

    def difference(w: np.ndarray) -> np.ndarray:
        s = strength(w)
        return s[win] - s[lose]

    w = common.minimise(lambda w: back(-1 / (1 + np.exp(np.clip(difference(w), -60, 60))) / len(win), w), lambda w: back(0.25 * difference(w) / len(win), w), wide + BUCKETS, steps)
    s = strength(w)
    weight = np.where(y == 1, (1 - share0) / max(1, (y == 1).sum()), share0 / max(1, (y == 0).sum()))
    cut = weighted_quantile(s, weight, share0)
    spread = np.median(np.abs(s - cut))
    return BradleyTerry(w[:wide], w[wide:].astype(np.float32), cut, float(4 / spread) if spread > 0 else 1.0)


def ordered_pair(rows: DataFrame, mass: dict[int, float], q: float, few: int = 4096) -> tuple[float, float]:
    """The value of ``rows`` (s double, y int) at the quantile ``q`` and the next one in order, where a row weighs ``mass[y]``.

    Rows are counted in bins between the least and the greatest value, then in the bin of the quantile, until ``few`` are left there.
    """
    total = n = None
    part, below, lo, hi = rows, 0.0, None, None
    weigh = lambda r: sum(w * r[f"n{y}"] for y, w in mass.items())
    counts = [F.count_if(F.col("y") == y).alias(f"n{y}") for y in mass]
    while True:
        if n is None:
            whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), *counts).first()
            n, lo, hi, total = whole["n"], whole["lo"], whole["hi"], weigh(whole)
        if n <= few or lo == hi:
            break
        bins = part.groupBy(F.floor((F.col("s") - lo) / (hi - lo) * few).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), *counts)
        found = sorted(bins.collect(), key=lambda r: r["bin"])  # few + 1 rows at most
        for r in found:
            if (below + weigh(r)) / total >= q - 1e-9 or r is found[-1]:
                break
            below += weigh(r)
        n, lo, hi = r["n"], r["lo"], r["hi"]
        part = rows.where(F.col("s").between(lo, hi))
    after = lambda v: rows.where(F.col("s") > v).agg(F.min("s")).first()[0]
    if n > few:  # equal values
        ties = sum(w * c for w, c in zip(mass.values(), part.agg(*counts).first(), strict=True))
        last = (below + ties - min(mass.values())) / total < q - 1e-9
        return lo, (after(lo) if last else None) or lo
    own = sorted((r["s"], r["y"]) for r in part.select("s", "y").collect())  # few rows at most
    share = (below + np.cumsum([mass[y] for _, y in own])) / total
    i = min(int(np.searchsorted(share, q - 1e-9)), len(own) - 1)
    follows = own[i + 1][0] if i + 1 < len(own) else after(own[i][0])
    return own[i][0], own[i][0] if follows is None else follows


def _labelled(rows: pa.Table, marked: pa.Table) -> pa.Table:
    """The rows (_key, _text, _y) whose key and label are among those of ``marked``."""
    own = set(zip(marked["_key"].to_pylist(), marked["_y"].to_pylist(), strict=True))
    keep = [x in own for x in zip(rows["_key"].to_pylist(), rows["_y"].to_pylist(), strict=True)]
    rows = rows.select(["_text", "_y"])
    return rows if all(keep) else rows.filter(pa.array(keep, pa.bool_()))


def _block_weights(table: pa.Table) -> pa.Table:
    """The weights that one block's texts (_text, _y) are fitted to; none for a block without either label."""
    table = table.combine_chunks()
    y = np.array(table["_y"].to_pylist())
    if len(set(y.tolist())) < 2:
        return pa.table({"w": pa.array([], pa.list_(pa.float64()))})
    rows = []
    for body, label in zip(common.utf8(table["_text"].combine_chunks()), y.tolist(), strict=True):
        body = body or b""
        stream, start, end = grams([body])
        own, n = np.unique(stream[start[0] : end[0]], return_counts=True)
        rows.append((label, np.array(shape(body)).tobytes(), own.astype(np.int32).tobytes(), (n / (len(body) + PRIOR)).astype(np.float32).tobytes()))
    rows.sort()
    idx = [np.frombuffer(r[2], np.int32) for r in rows]
    dense = np.stack([np.frombuffer(r[1], np.float64) for r in rows])
    doc = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
    val = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).astype(np.float64)
    places, labels = np.concatenate(idx), np.array([r[0] for r in rows])
    del rows, idx, table
    m = fit(dense, doc, places, val, labels, 0.5)
    del dense, doc, places, val
    common._trim()
    return pa.table({"w": pa.array([np.concatenate([m.shape_w, m.gram_w.astype(np.float64)])], pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", where: Column | None = None, per_class: int = PER_CLASS) -> BradleyTerry:
    """Learn from every labelled row, in blocks of about ``per_class`` rows of each label; ``where`` limits the label rows used."""
    marks = labels if where is None else labels.where(where)
    marks = marks.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    shares = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}  # two rows at most
    total = sum(shares.values())
    none = (np.zeros(len(SHAPE)), np.zeros(BUCKETS, np.float32), 0.0, 1.0)
    if len(shares) < 2:
        return BradleyTerry(*none, constant=float(1 in shares or not shares))
    kind = docs.schema[key].dataType
    own = marks.where("_key is not null").select(F.col("_key").cast(kind), "_y").distinct()
    sizes = {r["_y"]: r["count"] for r in docs.select(F.col(key).alias("_key")).join(own, "_key").groupBy("_y").count().collect()}  # two rows at most
    if len(sizes) < 2:
        return BradleyTerry(*none, constant=shares[1] / total)
    blocks = -(-max(sizes.values()) // per_class)
    copies = {y: min(blocks, max(1, per_class * blocks // n)) for y, n in sizes.items()}
    # rows that no label of theirs is known of stay where they are; texts are dealt once
    bits = common.filter_bits(total)
    word = common.key_word(common.key_filter(own, "_key", "_y", bits), F.col("_key"), bits)
    may = [common.has_mark(F.col("_word"), F.col("_key"), F.lit(y)) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null").withColumn("_word", word).where(may[0] | may[1])
    deal = lambda y: F.transform(F.sequence(F.lit(0), F.lit(copies[y] - 1)), lambda k: F.struct(F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(7)) + k, F.lit(blocks)).alias("_block"), F.lit(y).alias("_y")))
    maybe = lambda y: F.when(may[y], deal(y)).otherwise(F.array().cast("array<struct<_block: bigint, _y: int>>"))
    dealt = texts.select("_key", "_text", F.explode(F.concat(maybe(0), maybe(1))).alias("d")).select("_key", "_text", "d.*")
    places = own.select("_key", F.explode(F.when(F.col("_y") == 1, deal(1)).otherwise(deal(0))).alias("d")).select("_key", "d.*")
    # one block of about per_class rows of each label to a group
    parted = [x.repartition(blocks, "_block").groupBy("_block") for x in (dealt, places)]
    fitted = parted[0].cogroup(parted[1]).applyInArrow(lambda rows, marked: _block_weights(_labelled(rows, marked)), "w array<double>")
    # sums of whole numbers do not depend on the order of blocks
    mean = fitted.select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.sum(F.round(F.col("w") * 2.0**32).cast("long")).alias("w"), F.count(F.lit(1)).alias("n"))
    w = np.zeros(len(SHAPE) + BUCKETS)
    for r in mean.collect():  # one row for each weight
        w[r["at"]] = r["w"] / 2.0**32 / r["n"]
    model = BradleyTerry(w[: len(SHAPE)], w[len(SHAPE) :].astype(np.float32), 0.0, 1.0)
    sent = common.broadcast_value(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.strengths([b or b"" for b in common.utf8(batch.column(1))]))], names=["_key", "s"])

    found = common.map_arrow(texts, ["_key", "_text"], f"_key {kind.simpleString()}, s double", run)
    strengths = common.reread(found.join(own, "_key").select("s", F.col("_y").alias("y")), "strengths")
    model.cut = float(np.mean(ordered_pair(strengths, {y: shares[y] / total / sizes[y] for y in sizes}, shares[0] / total)))
    near, following = ordered_pair(strengths.withColumn("s", F.abs(F.col("s") - F.lit(model.cut))), {0: 1.0, 1: 1.0}, 0.5)
    spread = near if sum(sizes.values()) % 2 else (near + following) / 2
    model.slope = float(4 / spread) if spread > 0 else 1.0
    return model


def score(docs: DataFrame, model: BradleyTerry, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted`` (1 if score >= THRESHOLD)."""
    sent = common.broadcast_value(docs.sparkSession, model)
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [b or b"" for b in common.utf8(batch.column(batch.num_columns - 1))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sent.value.scores(bodies))], names=[*batch.schema.names[:-1], "score"])

    out = common.map_arrow(clean, clean.columns, schema, run)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: BradleyTerry, text: str = "text") -> DataFrame:
    """The rows whose text the model accepts, with all their columns as they are."""
    sent = common.broadcast_value(docs.sparkSession, model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [b or b"" for b in common.utf8(batch.column(at))]
        return batch.filter(pa.array(sent.value.scores(bodies) >= THRESHOLD))

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return common.map_arrow(docs.toDF(*names), names, schema, run).toDF(*docs.columns)
