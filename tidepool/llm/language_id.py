"""Language identification by prediction by partial matching (PPM).

Every learned language gets a byte context tree: counts of the bytes seen after each context of
0..``order`` bytes. The statistics are frozen after training and a text is scored by its exact
code length in bits under each tree: the longest context that has seen the byte codes it with
``c / (n + d)`` (n: visits of the context, d: distinct bytes seen there), every longer context
that was seen without it first pays an escape of ``d / (n + d)``, and a byte no context knows costs
8 bits (escape method C, no exclusion). The language with the shortest code wins.

Training counts n-grams in the tasks and sums them with one aggregation over a bounded sample
(``per_language`` documents of each language, whole texts). The frozen trees become hash tables
of resolved code lengths, so that scoring is a few array look-ups per byte; the tables are bounded
by the sample and sent to the tasks once. Scoring is a narrow pass: no shuffle, no skew.

Defined results: a null text, or one without a letter, gives ``und`` and score 0; so does every
text when there is nothing to learn from. Equal code lengths go to the smaller language name.
Repeated rows are scored alike; other columns (also with clashing names) are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Documents of each language that training reads at most.
PER_LANGUAGE = 400
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Static map from uint64 codes to row numbers: one probe, then a sorted list of collisions."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 4).bit_length())
        self.codes, n = codes, len(codes)
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        at = self._at(codes)
        self.slot[at[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)  # the first of a slot stays
        late = np.flatnonzero(self.slot[at] != np.arange(n))
        late = late[np.argsort(codes[late])]
        self.late, self.late_codes = late.astype(np.int32), codes[late]

    def _at(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is not in the table."""
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int32)
        row = self.slot[self._at(codes)]
        wrong = np.flatnonzero(self.codes[row] != codes)  # row -1 looks at the last code: settled below
        empty = row[wrong] < 0
        row[wrong[empty]] = -1
        wrong = wrong[~empty]
        row[wrong] = -1
        if len(wrong) and len(self.late):
            i = np.minimum(np.searchsorted(self.late_codes, codes[wrong]), len(self.late) - 1)
            hit = self.late_codes[i] == codes[wrong]
            row[wrong[hit]] = self.late[i[hit]]
        return row


@dataclass
class PpmModel:
    """Frozen trees of all languages. ``cost[k]``: bits of the n-grams of order k, a column per
    language, with the escapes resolved; ``escape[k]``: bits paid in a context that lacks the byte."""

    languages: list[str]
    order: int
    grams: list[_Table]
    cost: list[np.ndarray]
    contexts: list[_Table]
    escape: list[np.ndarray]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language; a text starts in the context of ``order`` line feeds."""
        out = np.zeros((len(texts), len(self.languages)))
        lead = b"\n" * self.order
        buffer = np.frombuffer(lead + lead.join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(sizes + self.order) - sizes
        ends = starts + sizes
        for a, b in common.windows(len(buffer) - self.order, 1 << 18):
            a, b = a + self.order, b + self.order
            common.segment_sums(self._bits(buffer[a - self.order : b]), starts, ends, a, out)
        return out

    def _bits(self, part: np.ndarray) -> np.ndarray:
        """Bits of each byte of ``part`` but the first ``order``, which are context."""
        n, wide = len(part) - self.order, part.astype(np.uint64)
        code = np.zeros(n, dtype=np.uint64)
        for j in range(self.order + 1):
            code = (code << np.uint64(8)) | wide[j : j + n]
        bits = np.zeros((n, len(self.languages)), dtype=np.float32)
        left, mask = np.arange(n), (1 << (8 * (self.order + 1))) - 1
        for k in range(self.order, -1, -1):
            mask = (1 << (8 * (k + 1))) - 1
            own = code & np.uint64(mask) if len(left) == n else code[left] & np.uint64(mask)
            row = self.grams[k].find(own)
            hit = row >= 0
            if hit.all():
                bits[left] += self.cost[k][row]
                return bits
            bits[left[hit]] += self.cost[k][row[hit]]
            left, own = left[~hit], own[~hit]
            ctx = self.contexts[k].find(own >> np.uint64(8))
            seen = ctx >= 0
            bits[left[seen]] += self.escape[k][ctx[seen]]
        bits[left] += 8.0
        return bits


def count_ngrams(texts: list[bytes], order: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, codes, counts) of the n-grams of k+1 bytes that end inside the texts, for k = 0..order."""
    lead = b"\n" * order
    buffer = np.frombuffer(lead + lead.join(texts), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes + order) - sizes
    inside = np.zeros(len(buffer) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    out = []
    for k in range(order + 1):
        code = np.zeros(len(at), dtype=np.uint64)
        for j in range(k, -1, -1):
            code = (code << np.uint64(8)) | buffer[at - j]
        codes, counts = np.unique(code, return_counts=True)
        out.append((k, codes, counts))
    return out


def freeze(counts: list[tuple[str, int, np.ndarray, np.ndarray]], order: int) -> PpmModel:
    """Resolve summed counts (language, k, codes, counts) into tables of code lengths."""
    languages = sorted({c[0] for c in counts})
    grams, cost, contexts, escape = [], [], [], []
    for k in range(order + 1):
        of = {lang: (codes, n) for lang, kk, codes, n in counts if kk == k}
        keys = np.unique(np.concatenate([c for c, _ in of.values()])) if of else np.zeros(0, dtype=np.uint64)
        ctx_keys = np.unique(keys >> np.uint64(8))
        esc = np.zeros((len(ctx_keys), len(languages)))
        own = np.full((len(keys), len(languages)), np.nan)
        for col, lang in enumerate(languages):
            if lang not in of:
                continue
            codes, n = of[lang]
            at = np.searchsorted(ctx_keys, codes >> np.uint64(8))
            visits = np.bincount(at, weights=n, minlength=len(ctx_keys))
            distinct = np.bincount(at, minlength=len(ctx_keys))
            seen = visits > 0
            esc[seen, col] = -np.log2(distinct[seen] / (visits[seen] + distinct[seen]))
            own[np.searchsorted(keys, codes), col] = -np.log2(n / (visits[at] + distinct[at]))
        if k == 0:
            lower = np.full((len(keys), len(languages)), 8.0)
        else:
            lower = cost[k - 1][grams[k - 1].find(keys & np.uint64((1 << (8 * k)) - 1))].astype(np.float64)
        via = esc[np.searchsorted(ctx_keys, keys >> np.uint64(8))] + lower if len(keys) else own
        grams.append(_Table(keys))
        cost.append(np.where(np.isnan(own), via, own).astype(np.float32))
        contexts.append(_Table(ctx_keys))
        escape.append(esc.astype(np.float32))
    return PpmModel(languages, order, grams, cost, contexts, escape)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", where: Column | None = None,
          per_language: int = PER_LANGUAGE, order: int = ORDER) -> PpmModel | None:
    """Trees of every non-null language of the rows ``where`` holds; None if there are none."""
    if not 0 < order <= 7:
        raise ValueError("order must be in 1..7: an n-gram is one 64-bit code")
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    if where is not None:
        rows = docs.where(where).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull())
    # at most per_language ids for each language
    picked = common.sample_ids(rows, "_key", "_lang", per_language)
    sample = rows.where(F.col("_text").isNotNull()).join(F.broadcast(picked), ["_key", "_lang"], "left_semi")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[bytes]] = {}
        for name, body in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
            by.setdefault(name, []).append(body)
        parts = [(name, k, codes, n) for name, bodies in by.items() for k, codes, n in count_ngrams(bodies, order)]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in parts for _ in p[2]], pa.string()), pa.array(np.concatenate([np.full(len(p[2]), p[1]) for p in parts]), pa.int32()),
             pa.array(np.concatenate([p[2] for p in parts]).view(np.int64)), pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64))],
            names=["lang", "k", "code", "n"])

    summed = common.map_arrow(sample, ["_lang", "_text"], "lang string, k int, code long, n long", count).groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    # bounded by the sample: no more n-grams than bytes in per_language texts a language
    table = summed.toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("lang", "ascending"), ("k", "ascending")])
    lang_of, k_of = np.array(table["lang"].to_pylist()), table["k"].to_numpy()
    code, n = table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    counts = []
    for name in sorted(set(lang_of)):
        for k in range(order + 1):
            at = (lang_of == name) & (k_of == k)
            counts.append((str(name), k, code[at], n[at]))
    return freeze(counts, order)


def predict(docs: DataFrame, model: PpmModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` (posterior of the language, equal priors) and ``bits``."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    sent = common.broadcast_value(spark, model)
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        bodies = common.utf8(batch.column(batch.num_columns - 1))
        live = [i for i, body in enumerate(bodies) if body and any(map(str.isalpha, body.decode("utf-8", "replace")))]
        pred, prob, bits = [UNKNOWN] * len(bodies), np.zeros(len(bodies)), np.zeros(len(bodies))
        if live:
            length = m.code_lengths([bodies[i] for i in live])
            best = length.argmin(axis=1)
            least = length[np.arange(len(live)), best]
            post = 1.0 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(axis=1)
            for i, j in zip(live, best, strict=True):
                pred[i] = m.languages[j]
            prob[live], bits[live] = post, least
        cols = [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(prob), pa.array(bits)]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "lang_pred", "score", "bits"])

    out = common.map_arrow(clean, clean.columns, f"{schema}, lang_pred string, score double, bits double", score)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits")
