"""Quality rules: base counts of every text and a calibrated hashed n-gram logistic regression.

Base counts are exact and vectorised. The classifier hashes word unigrams, word bigrams and
byte n-grams of 3 to 5 (the character n-grams, over UTF-8) into ``BUCKETS`` weights of each family;
a feature is its share of the family's n-grams, with a fixed number of empty ones added. A word beside itself
hashes to one bucket whatever the word is. It is trained on a bounded sample of labelled rows
(``PER_CLASS`` of each label), a fifth of which is held back to fit Platt's two calibration
parameters. Rows are scored in Arrow batches, with fixed thresholds.

Scoring is a narrow pass with a broadcast of four weight vectors (1 MB, fixed). Training reads
``labels`` narrow, then one filtered scan of the texts.

Defined results: a null text counts as empty: all counts 0, base_failed true, kept false. With no
usable labels (or of one class only) every probability is the share of label 1, else 1. Repeated
rows are scored alike; extra columns are not touched; rows with null ids are scored, never learnt.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that training reads at most.
PER_CLASS = 500
BITS = 16
BUCKETS = 1 << BITS
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 20, 30, 0.5
#: Family -> n-grams without weight that every text has besides its own, so that short texts say less.
PRIOR = {"word": 20, "bigram": 20, "char3": 100, "char4": 100, "char5": 100}
FAMILIES = tuple(PRIOR)
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)
_CACHE_WORDS = 400_000


class _Words(dict):
    """word -> (own number << 32 | crc32); cleared when full, between texts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) << 32 | zlib.crc32(word)
        return value


_words = _Words()


def word_codes(words: list[bytes]) -> np.ndarray:
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def repeated_words(codes: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    mixed = ((codes >> np.uint64(32)) + np.uint64(1)) * _M1
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    window = np.zeros(n, dtype=np.uint64)
    for j in range(width):  # 64-bit polynomial of word numbers; the words of equal ones are compared
        window = window * np.uint64(0x100000001B3) + mixed[j : j + n]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    here, before = order[1:][same], order[:-1][same]
    if all(np.array_equal(codes[here + j], codes[before + j]) for j in range(width)):
        twice[here] = twice[before] = True
    else:  # different windows of one hash
        rows = np.lib.stride_tricks.sliding_window_view(codes, width)
        _, inverse, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = times[inverse.reshape(-1)] > 1
    edge = np.zeros(len(codes) + 1, dtype=np.int32)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def base_counts(body: bytes, words: list[bytes], codes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    marks = len(body.translate(None, _SPACE))
    continuation = marks and int(np.count_nonzero((np.frombuffer(body, dtype=np.uint8) & 0xC0) == 0x80))
    lines = [x for x in body.split(b"\n") if x.strip(_SPACE)]
    return (len(words), marks - continuation, len(body) - len(body.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(codes))


def _hash(codes: np.ndarray, seed: int) -> np.ndarray:
    return (((codes + np.uint64(seed)) * _M1) >> _SHIFT).astype(np.int64)


def _family_buckets(buffer: np.ndarray, crc: np.ndarray) -> dict[str, np.ndarray]:
    """Bucket of the n-gram of every family that ends at each position of the byte and word streams."""
    out = {"word": _hash(crc, 1)}
    pair = crc[:-1] * np.uint64(0x85EBCA6B) + crc[1:]
    pair[crc[:-1] == crc[1:]] = np.uint64(0)
    out["bigram"] = _hash(pair, 2)
    code, wide = np.zeros(max(0, len(buffer) - 4), dtype=np.uint64), buffer.astype(np.uint64)
    for j in range(5):
        code = (code << np.uint64(8)) | wide[j : j + len(code)]
    for k in (3, 4, 5):
        out[f"char{k}"] = _hash(code & np.uint64((1 << (8 * k)) - 1), k)
    return out


def featurise(bodies: list[bytes], codes: list[np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Bucket streams of all texts and, for each family, the (start, end) of every text's n-grams in them."""
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    counts = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    buffer = np.frombuffer(b"    " + b"    ".join(bodies), dtype=np.uint8)  # an n-gram's first bytes may be this lead
    crc = np.concatenate(codes) & np.uint64(0xFFFFFFFF) if codes else np.zeros(0, dtype=np.uint64)
    streams = _family_buckets(buffer, crc)
    cs, ws = np.cumsum(sizes + 4) - sizes - 4, np.cumsum(counts) - counts
    spans = {f: (cs, cs + sizes) for f in FAMILIES[2:]}
    spans["word"], spans["bigram"] = (ws, ws + counts), (ws, ws + np.maximum(counts - 1, 0))
    return streams, spans


@dataclass
class HashedLogistic:
    """Weights of each family's buckets, bias and Platt's slope and offset."""

    weights: dict[str, np.ndarray]
    bias: float
    slope: float
    offset: float

    def logits(self, streams, spans, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        for family in FAMILIES:
            total, (start, end) = np.zeros(n), spans[family]
            for a, b in common.windows(len(streams[family]), 1 << 20):
                common.segment_sums(self.weights[family][streams[family][a:b]], start, end, a, total)
            z += total / (end - start + PRIOR[family])
        return z

    def probabilities(self, streams, spans, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.logits(streams, spans, n) + self.offset, -60, 60)))


def constant_model(share: float) -> HashedLogistic:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return HashedLogistic({f: np.zeros(BUCKETS, dtype=np.float32) for f in FAMILIES}, 0.0, 1.0, float(np.log(share / (1 - share))))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = x.T @ (p - target) + np.array([1e-3 * a, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        a, b = a - step[0] / max(1.0, norm), b - step[1] / max(1.0, norm)
        if norm < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(doc: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, fold: np.ndarray, l2: float = 1e-6, steps: int = 80) -> HashedLogistic:
    """Log-loss of the rows out of the fold, both classes of equal weight; Platt's parameters on the fold."""
    n, size = len(y), BUCKETS * len(FAMILIES)
    learn = fold == 0
    weight = np.where(y == 1, 0.5 / max(1, (learn & (y == 1)).sum()), 0.5 / max(1, (learn & (y == 0)).sum())) * learn

    def logits(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=val * w[idx], minlength=n) + w[-1]

    def back(r: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(idx, weights=val * r[doc], minlength=size) + l2 * w[:-1], r.sum())

    w = common.minimise(lambda w: back(weight * (1 / (1 + np.exp(-np.clip(logits(w), -60, 60))) - y), w), lambda w: back(0.25 * weight * logits(w), w), size + 1, steps)
    z, held = logits(w), fold == 1
    slope, offset = _platt(z[held], y[held]) if held.any() else (1.0, 0.0)
    parts = w[:-1].astype(np.float32).reshape(len(FAMILIES), BUCKETS)
    return HashedLogistic(dict(zip(FAMILIES, parts, strict=True)), float(w[-1]), slope, offset)


def sparse_rows(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, share) of every text's features."""
    out = []
    for body in bodies:
        codes = word_codes(body.split())
        streams, spans = featurise([body], [codes])
        idx, val = [], []
        for f, family in enumerate(FAMILIES):
            s, e = spans[family][0][0], spans[family][1][0]
            if e > s:
                own, n = np.unique(streams[family][s:e], return_counts=True)
                idx.append(own + f * BUCKETS)
                val.append(n / (e - s + PRIOR[family]))
        out.append((np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)) if idx else (np.zeros(0, np.int32), np.zeros(0, np.float32)))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", where: Column | None = None, per_class: int = PER_CLASS) -> HashedLogistic:
    """Fit on at most ``per_class`` labelled rows of each class; ``where`` limits the label rows."""
    marks = labels if where is None else labels.where(where)
    marks = marks.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    # at most per_class ids of each of two classes
    picked = F.broadcast(common.sample_ids(marks, "_key", "_y", per_class))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(picked, "_key")
    rows = rows.select("_text", "_y", F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(11)), F.lit(5)).alias("_fold"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sparse_rows([b or b"" for b in common.utf8(batch.column(0))])
        return pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), batch.column(1), batch.column(2)],
                                          names=["idx", "val", "y", "fold"])

    # bounded: one row for each sampled id
    table = common.map_arrow(rows, ["_text", "_y", "_fold"], "idx binary, val binary, y int, fold long", run).toArrow()
    table = table.sort_by([("fold", "ascending"), ("y", "ascending"), ("idx", "ascending")]) if table.num_rows else table
    y = np.array(table["y"].to_pylist(), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return constant_model(float(y.mean()) if len(y) else 1.0)
    idx = [np.frombuffer(b, np.int32) for b in table["idx"].to_pylist()]
    val = [np.frombuffer(b, np.float32) for b in table["val"].to_pylist()]
    doc = np.repeat(np.arange(len(y)), [len(i) for i in idx])
    return fit(doc, np.concatenate(idx), np.concatenate(val).astype(np.float64), y, (table["fold"].to_numpy() == 0).astype(int))


def score(docs: DataFrame, model: HashedLogistic, keep: list[str], text: str = "text", min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The columns ``keep`` with the base counts, base_failed, kept and probability."""
    sent = common.broadcast_value(docs.sparkSession, model)
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [b or b"" for b in common.utf8(batch.column(batch.num_columns - 1))]
        counts = np.zeros((len(bodies), 5), dtype=np.int64)
        codes = []
        for i, body in enumerate(bodies):
            words = body.split()
            codes.append(word_codes(words))
            counts[i] = base_counts(body, words, codes[-1])
        prob = sent.value.probabilities(*featurise(bodies, codes), len(bodies))
        failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
        cols = [*batch.columns[:-1], *(pa.array(counts[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (prob >= min_probability)), pa.array(prob)]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *names, "base_failed", "kept", "probability"])

    out = common.map_arrow(clean, clean.columns, f"{schema}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, probability double", run)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names, "base_failed", "kept", "probability")
