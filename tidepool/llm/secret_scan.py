"""Secret scans: fixed patterns plus sliding-window Shannon entropy over candidate strings.

Patterns (leftmost, non-overlapping per kind): ``assign`` (a secret-like name, a separator and a
value of ``MIN_VALUE`` characters or more), ``access`` (``AKIA`` keys) and ``hex``. Beside them every maximal
run of token characters of ``MIN_CANDIDATE`` or more is a candidate string, and so is each part of it between
``=``, and between any of ``= _ / -``, that is as long (a value is judged without its name). Its character class
(hex, base32, alphanumeric or base64) fixes window and threshold; the entropy of the window is
kept up by incremental counts as it slides one character, and the runs of windows at or above the
threshold, widened to whole parts (to a whole value between ``=`` of which they make up half) and joined where they overlap, become ``entropy`` spans.
Allow-listed candidates (plain words and identifiers, UUIDs,
paths and addresses, dates and numbers, repeated or sequential alphabets, placeholders) are
suppressed; letters of one case alone are words, letters of both cases are words if their humps are as long as those of words (``HUMP``); so are entropy spans that a pattern span already covers. Suppression never removes a
pattern span.

A narrow pass over whole texts; work is linear in the text, memory is one text. Null text counts as
empty: no spans. Repeated rows give repeated results; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 6, 20, 24, 20
#: Class -> (window in characters, bits a character).
THRESHOLDS = {"hex": (24, 3.0), "base32": (24, 3.4), "alnum": (20, 3.7), "base64": (20, 3.9)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
_PIECE = re.compile(r"[^=]+(?:=+$)?")
_PART = re.compile(r"[^=_/-]+")
_CLASSES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("base32", re.compile(r"[A-Z2-7]+=*")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
_ALLOW = (
    re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*"),  # words and camel case
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]*|[-_/=+]?\d{1,4}(?![A-Za-z0-9]))*"),  # identifiers, slugs and paths of words
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[\d/_=+-]+"),  # numbers, dates, rules
    re.compile(r"(.{1,8}?)\1{2,}.{0,8}"),  # a short text repeated
)
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Mean letters of a hump in identifiers; random letters of both cases have 2.7.
HUMP = 3.5
_SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "zyxwvutsrqponmlkjihgfedcba", "9876543210", "qwertyuiop")
_PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|your[-_]|xxxx|dummy|redacted", re.I | re.A)


def allowed(candidate: str) -> bool:
    """Whether the allow-list suppresses the candidate string."""
    if candidate.isalpha():  # words without digits
        return len(candidate) >= HUMP * len(_HUMPS.findall(candidate))
    if any(p.fullmatch(candidate) for p in _ALLOW) or _PLACEHOLDER.search(candidate):
        return True
    low = candidate.lower()
    return any(low[i : i + 8] in s * 2 for s in _SEQUENCES for i in (0, max(0, len(low) // 2 - 4)))


def char_class(candidate: str) -> str:
    return next(name for name, pattern in _CLASSES if pattern.fullmatch(candidate))


def entropy_spans(candidate: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged windows whose Shannon entropy is at or above the threshold, as (start, end).

    H = log2(w) - sum(c log2 c) / w; the sum changes by two counts for each step of the window.
    """
    w = min(window, len(candidate))
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in candidate[:w]:
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
    bits, out = math.log2(w), []
    for start in range(len(candidate) - w + 1):
        if start:
            gone, new = candidate[start - 1], candidate[start + w - 1]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
            c = counts.get(new, 0)
            total += term[c + 1] - term[c]
            counts[new] = c + 1
        if bits - total / w >= threshold - 1e-9:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], start + w)
            else:
                out.append((start, start + w))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern spans as (start, end, kind), code points, end exclusive."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def method_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[list[int]] = []
    # furthest end of the pattern spans up to each start
    starts, reach = [], []
    for x, y, _ in sorted(base):
        starts.append(x)
        reach.append(max(y, reach[-1]) if reach else y)
    for m in _CANDIDATE.finditer(text):
        run, found = m.group(), []
        parts, pieces = [p.span() for p in _PART.finditer(run)], {p.span() for p in _PIECE.finditer(run)}
        firsts = [a for a, _ in parts]
        for a, b in sorted({(0, len(run)), *pieces, *parts}):
            candidate = run[a:b]
            if b - a < MIN_CANDIDATE or allowed(candidate):
                continue
            hot = entropy_spans(candidate, *THRESHOLDS[char_class(candidate)])
            if (a, b) in pieces and 2 * sum(e - s for s, e in hot) >= b - a:
                hot = [(0, b - a)]
            for s, e in hot:
                s, e = s + a, e + a
                # to the edges of the parts that they cut
                i, j = bisect_right(firsts, s) - 1, bisect_left(firsts, e) - 1
                s = parts[i][0] if i >= 0 and s < parts[i][1] else s
                e = parts[j][1] if j >= 0 and e < parts[j][1] else e
                s, e = s + m.start(), e + m.start()
                k = bisect_right(starts, s) - 1
                if k < 0 or reach[k] < e:
                    found.append((s, e))
        last = None
        for s, e in sorted(found):
            if last is not None and s < last[1]:
                last[1] = max(last[1], e)
            else:
                last = [s, e]
                out.append(last)
    return [(s, e, "entropy") for s, e in out]


def scan_text(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind."""
    base = base_spans(text)
    return sorted(base + method_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``found``: array of (kind, start, end, value)."""
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        found = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, e, k in scan_text(t)] for t in texts]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(item))], names=[*batch.schema.names[:-1], "found"])

    out = common.map_arrow(clean, clean.columns, f"{schema}{', ' if schema else ''}found array<struct<kind:string,start:int,end:int,value:string>>", run)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "found")


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each pattern, digest of the pattern spans and the joined spans of all kinds."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"] != "entropy")
    return found.select(*keep, count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("entropy"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of the text replaced by ``mark`` (overlapping spans by one) and ``n_chars`` renewed.

    All columns stay in their order; a null text stays null.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact_text(t, scan_text(t), mark) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])

    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = run(pa.RecordBatch.from_arrays([batch.column(at)], names=["t"])).column(0)
        return pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], names=names)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    out = common.map_arrow(docs.toDF(*names), names, schema, whole).toDF(*docs.columns)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
