"""License scans: winnowed template fingerprints pick candidates, banded alignment reports matches.

Templates are tokenised (lower-case alphanumeric runs). Each template's k-grams are winnowed: of every
``WINDOW`` consecutive k-gram codes the rightmost smallest is a fingerprint, so any shared run of
``K + WINDOW - 1`` tokens holds one. An inverted index maps a fingerprint to (template, position).
All k-grams of a document meet the index; each hit proposes a diagonal. Diagonals are taken by their number of hits, unless
matches before cover their hits: the template is aligned in a band of ``BAND`` tokens on either side
(longest common subsequence with gaps, in token steps) and reported if the matched
tokens cover ``MIN_COVERAGE`` of the template, with the code-point span from the first to the last matched token.
Before that, hits that rise in text and template are chained over diagonals further apart than the band (a longer
insertion or cut), within two template lengths of text, and the template is aligned at once in the bands along the chain.
Of overlapping matches in one document the one with more matched tokens stays; what stands in a chain's gap does not overlap.

The templates and index are fixed and small (a few thousand entries) and are sent to the tasks;
the scan is a narrow pass over whole texts. A diagonal costs template length x band, and texts without
a hit cost no alignment, so work is linear in the text.

Defined results: null and empty texts have no match. Equal matches go to the first template name.
Repeated rows give repeated results; other columns are not touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_templates import TEMPLATES

K, WINDOW, BAND, MIN_COVERAGE = 3, 3, 8, 0.8
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def winnow(codes: np.ndarray, window: int) -> list[int]:
    """Positions of the rightmost smallest code of every window."""
    if not len(codes):
        return []
    w = min(window, len(codes))
    picked = {i + w - 1 - int(np.argmin(codes[i : i + w][::-1])) for i in range(len(codes) - w + 1)}
    return sorted(picked)


@dataclass
class LicenseIndex:
    names: list[str]
    lengths: list[int]
    ids: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted fingerprints
    postings: np.ndarray  # (template, position) beside codes
    k: int


def build_index(templates: dict[str, str], k: int = K, window: int = WINDOW) -> LicenseIndex:
    vocabulary: dict[str, int] = {}
    names, ids = [], []
    for name in sorted(templates):
        own = np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens(templates[name])], dtype=np.int64)
        if len(own) >= k:
            names.append(name)
            ids.append(own)
    rows = []
    for t, own in enumerate(ids):
        codes = _grams(own, k)
        mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
        rows += [(int(codes[p]), t, p) for p in winnow(mixed, window)]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return LicenseIndex(names, [len(i) for i in ids], ids, vocabulary, table[:, 0].copy(), table[:, 1:].copy(), k)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Exact codes of k-grams over vocabulary numbers (below 2**20); 0 if a word is unknown."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(k):
        code = (code << 20) | ids[j : j + n]
        known &= ids[j : j + n] > 0
    return np.where(known, code, 0)


def align(template: np.ndarray, body: np.ndarray, lo: int, hi: int, bands: list[tuple[int, int]] | None = None) -> tuple[int, int, int]:
    """(matched tokens, first, last matched body position) of the best alignment on diagonals lo..hi.

    ``bands``: for each template token, the first and last diagonal on which it may match.
    A diagonal is body position minus template position. Among equal scores the shortest span wins, then the first.
    """
    width = hi - lo + 1
    # a state: (matched, first - last, -first, last); entry d of a row is on diagonal lo + d
    none = (0, 0, 0, -1)
    row = [none] * width
    for j, want in enumerate(template.tolist()):
        new: list[tuple[int, int, int, int]] = []
        for d in range(width):
            at = j + lo + d
            best = row[d]  # skips template token j and its body token
            if d + 1 < width and row[d + 1] > best:
                best = row[d + 1]  # template token without a body token
            if d and new[d - 1] > best:
                best = new[d - 1]  # body token without a template token
            if 0 <= at < len(body) and body[at] == want and (bands is None or bands[j][0] <= lo + d <= bands[j][1]):
                m, _, first, _ = row[d]
                first = -first if m else at
                best = max(best, (m + 1, first - at, -first, at))
            new.append(best)
        row = new
    m, _, first, last = max(row)
    return m, -first, last


def chains(hits: list[tuple[int, int]], k: int, reach: int, band: int) -> list[list[tuple[int, int]]]:
    """Chains of (text, template) positions that rise in both within ``reach`` tokens of text, best first, without shared hits.

    The best has most template tokens in its k-grams, then the least drift; only those that leave a band are given.
    """
    hits = sorted(hits)
    score: list[tuple[int, int]] = []
    back, head = [], []
    low = 0
    for i, (p, pos) in enumerate(hits):
        while hits[low][0] < p - reach:
            low += 1
        best, prev = (k, 0), -1
        for j in range(low, i):
            q, before = hits[j]
            if q < p and before < pos and hits[head[j]][0] >= p - reach:
                s = (score[j][0] + min(k, pos - before), score[j][1] - abs((p - pos) - (q - before)))
                if s > best:
                    best, prev = s, j
        score.append(best)
        back.append(prev)
        head.append(i if prev < 0 else head[prev])
    used: set[int] = set()
    out = []
    for i in sorted(range(len(hits)), key=lambda i: (score[i], -i), reverse=True):
        own = []
        while i >= 0 and i not in used:
            own.append(i)
            i = back[i]
        used.update(own)
        chain = [hits[j] for j in reversed(own)]
        drift = [p - pos for p, pos in chain]
        if chain and max(drift) - min(drift) > band:
            out.append(chain)
    return out


def align_chain(template: np.ndarray, body: np.ndarray, chain: list[tuple[int, int]], band: int) -> tuple[int, int, int]:
    """``align`` in the band of the chain's diagonal at every template token, and between two hits in the bands of both."""
    diagonals = [p - pos for p, pos in chain]
    bands, at = [], 0
    for j in range(len(template)):
        while at < len(chain) and chain[at][1] <= j:
            at += 1
        near = diagonals[max(0, at - 1) : at + 1]
        bands.append((min(near) - band, max(near) + band))
    return align(template, body, min(diagonals) - band, max(diagonals) + band, bands)


def matches(text: str, index: LicenseIndex, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(template, start, end, matched tokens, coverage) of one text, by start."""
    if not text:
        return []
    get = index.vocabulary.get
    words = tokens(text)
    body = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
    grams = _grams(body, index.k)
    at = np.flatnonzero(grams)
    if not len(at) or not len(index.codes):
        return []
    left, right = np.searchsorted(index.codes, grams[at], "left"), np.searchsorted(index.codes, grams[at], "right")
    hits: dict[int, dict[int, list[int]]] = {}
    for p, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
        for t, pos in index.postings[a:b].tolist():
            hits.setdefault(t, {}).setdefault(p - pos, []).append(p)
    found = []
    for t, by_diagonal in hits.items():
        least = min_coverage * index.lengths[t]
        free = body.copy()  # tokens of a match are not matched again
        if max(by_diagonal) - min(by_diagonal) > band:
            reach = 2 * index.lengths[t]
            for chain in chains([(p, p - d) for d, ps in by_diagonal.items() for p in ps], index.k, reach, band):
                around = free[max(0, chain[0][0] - reach) : chain[-1][0] + reach]
                if np.isin(index.ids[t], around).sum() < least:  # cannot reach the coverage
                    continue
                m, first, last = align_chain(index.ids[t], free, chain, band)
                if m >= least:
                    # hits of repeated words may chain beside the diagonal that holds more
                    near = {d: n for d, ps in by_diagonal.items() if (n := sum(first <= p <= last for p in ps))}
                    best = max(near, key=lambda d: (near[d], -d), default=chain[0][0] - chain[0][1])
                    alone = align(index.ids[t], free, best - band, best + band)
                    if alone[0] >= m:
                        m, first, last = alone
                        found.append((m, -(last - first), first, last, t, [[first, last]]))
                        free[first : last + 1] = 0
                        continue
                    pieces = [[first, first]]
                    for (p, pos), (q, after) in zip(chain, chain[1:], strict=False):
                        if abs((q - after) - (p - pos)) > band:
                            pieces[-1][1] = max(pieces[-1][0], min(last, p + index.k - 1))
                            pieces.append([q, q])
                    pieces[-1][1] = max(pieces[-1][0], last)
                    found.append((m, -(last - first), first, last, t, pieces))
                    for x, y in pieces:
                        free[x : y + 1] = 0
        for diagonal in sorted(by_diagonal, key=lambda d: (-len(by_diagonal[d]), d)):
            if not free[by_diagonal[diagonal]].any():
                continue
            m, first, last = align(index.ids[t], free, diagonal - band, diagonal + band)
            if m >= least:
                found.append((m, -(last - first), first, last, t, [[first, last]]))
                free[first : last + 1] = 0
    spans = [m.span() for m in _TOKEN.finditer(text)] if found else []
    if len(spans) != len(words):  # lower-casing may split or join a token
        low = [x for m in _TOKEN.finditer(text) for x in [m.span()] * len(tokens(m.group()))]
        spans = low if found else spans
    taken: list[list[int]] = []
    out = []
    for m, _, first, last, t, pieces in sorted(found, key=lambda x: (-x[0], -x[1], index.names[x[4]], x[2])):
        if all(y < a or x > b for a, b in taken for x, y in pieces):
            taken += pieces
            out.append((index.names[t], spans[first][0], spans[last][1], m, m / index.lengths[t]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each match: key, template, start, end, matched_tokens, coverage."""
    index = build_index(TEMPLATES if templates is None else templates)
    sent = common.broadcast_value(docs.sparkSession, index)
    clean = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for i, body in enumerate(batch.column(1).to_pylist()):
            for m in matches(body, sent.value, band, min_coverage):
                rows.append(i)
                found.append(m)
        cols = list(zip(*found, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                           pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], names=["k", "template", "start", "end", "matched_tokens", "coverage"])

    kind = docs.schema[key].dataType.simpleString()
    out = common.map_arrow(clean, ["k", "t"], f"k {kind}, template string, start int, end int, matched_tokens int, coverage double", run)
    return out.select(F.col("k").alias(key), "template", "start", "end", "matched_tokens", "coverage")
