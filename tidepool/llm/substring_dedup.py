"""Substring dedup: words covered by a window of 35 words that starts elsewhere too, by prefix-partitioned suffix trees.

**Prefixes.** Only suffixes with a common prefix meet in a tree, so the suffixes are split by prefixes. Every window of 35 words is dealt by an
eight-word prefix of one of its suffixes: the one that starts at its anchor, the place of the least prefix hash in the
window. Equal windows have the same anchor, and neighbouring windows share theirs, so a run of windows goes to its subtree as one
snippet of text. Prefixes are counted first, narrow and map-side. One that occurs once has no internal node and is dropped with its text. One that
occurs more than ``LIMIT`` times would not fit into memory; its suffixes are split by longer prefixes, at once by all 35 words of the window, where a
group of two is a repeat and needs no tree, so it is only counted (by 128 bits of hash).

**Subtrees.** A group has ``LIMIT`` snippets at most. A task reads groups one after the other, some MB at a time, and names the nodes of their suffix
trees at depths 1, 2, 4, .. 32 and 35 words: a node at twice the depth is a pair of nodes, and sorting the pairs names
them in suffix order. The names stand for exact word sequences. A node at depth 35 with two leaves lies at or below a deep internal
node: each of its leaves starts a repeated window. Leaves that follow each other in a snippet make up a maximal repeat.

**Scale.** Texts cross the network once: both joins (of live anchors, then of repeats) use the same exchange by document. Beside it go 28 bytes for an
anchor (one for 14 words), and the snippets of live prefixes. Joins are equi-joins whose other side is unique, so adaptive execution can split hot keys.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``; a null text has none. Texts shorter than a window lose nothing. Repeated rows are repeated in the
result, and each is a repeat of the other. Kept words are joined by one space. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PREFIX = 35, 8
#: Suffix snippets of a prefix that one tree may hold.
LIMIT = 20_000
#: Bytes of snippets that a task builds trees for at once, unless one group has more.
TREE_BYTES = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_KEYS = ["id0", "th"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts, one after another."""

    def __init__(self, texts: pa.Array):
        runs, self.doc, self.first, self.last, self.raw = common.byte_runs(texts, lambda raw: ~_SPACE[raw])
        coded = runs.dictionary_encode()
        self.code, self.values = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.start = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each text

    def hashes(self, seed: int = 0) -> np.ndarray:
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.values.to_pylist()), dtype=np.uint64, count=len(self.values))
        return own[self.code]

    def anchors(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and prefix hash of every anchor; windows by their first word."""
        h, n = self.hashes(), len(self.code)
        grams = max(n - prefix + 1, 0)
        key = np.zeros(grams, dtype=np.uint64)
        for j in range(prefix):
            key = key * _MIX[0] + h[j : j + grams]
        key = _mixed(key)
        # the least of each window's prefixes, the leftmost of equal ones
        least, size, width = np.arange(grams), 1, window - prefix + 1
        while 2 * size <= width:
            left, right = least[: max(len(least) - size, 0)], least[size:]
            least, size = np.where(key[left] <= key[right], left, right), 2 * size
        if size < width:
            left, right = least[: max(len(least) - (width - size), 0)], least[width - size :]
            least = np.where(key[left] <= key[right], left, right)
        at = np.arange(len(least))
        at = at[at + window <= self.start[self.doc[: len(least)] + 1]] if len(least) else at
        if not len(at):
            return at, at, key[:0]
        new = np.flatnonzero(np.concatenate([[True], (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
        return at[new], np.diff(np.concatenate([new, [len(at)]])), key[least[at[new]]]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id0, th (that name a row or its equals), none (the id is null), text."""
    id_, body = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(id_, F.lit(0).cast("long")).alias("id0"), F.xxhash64(id_.isNull(), body).alias("th"), id_.isNull().alias("none"), body.alias("text"))


def anchor_prefixes(texts: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """id0, th, at (first window), key (hash of the prefix) of every anchor."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(2))
        at, _, key = words.anchors(window, prefix)
        doc = words.doc[at]
        own = pa.array(doc)
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array((at - words.start[doc]).astype(np.int32)), pa.array(key.view(np.int64))], names=[*_KEYS, "at", "key"])

    return common.map_arrow(texts, [*_KEYS, "text"], "id0 long, th long, at int, key long", run, group=4 << 20)


def _live(words: Words, listed: pa.Array, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and prefix of the anchors listed for each text."""
    at, runs, key = words.anchors(window, prefix)
    n = listed.offsets.to_numpy()
    own = np.repeat(np.arange(len(listed)), np.diff(n))
    want = words.start[own] + listed.flatten().to_numpy(zero_copy_only=False)
    found = np.searchsorted(at, np.sort(want))
    return words.doc[at[found]], at[found], runs[found], key[found]


def snippets(live: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """key, id0, th, at, runs, body of every anchor listed in ``live`` (id0, th, none, text, ats): the text of its ``runs`` windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(3))
        doc, at, runs, key = _live(words, batch.column(4), window, prefix)
        first, last = words.first[at], words.last[at + runs + window - 2]
        places = np.concatenate([[0], np.cumsum(last - first)])
        take = np.repeat(first - places[:-1], last - first) + np.arange(places[-1])
        body = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(words.raw[take])])
        own = pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array((at - words.start[doc]).astype(np.int32)), pa.array(runs.astype(np.int32)), body],
                                          names=["key", *_KEYS, "at", "runs", "body"])

    return common.map_arrow(live, [*_KEYS, "none", "text", "ats"], "key long, id0 long, th long, at int, runs int, body string", run)


def repeated_starts(code: np.ndarray, rest: np.ndarray, window: int) -> np.ndarray:
    """Marks the words that start a window of ``window`` words which another word starts too.

    ``code`` numbers the words, ``rest`` has the words from each to the end of its snippet. Nodes of one leaf are dropped as soon as they show.
    """

    def named(pairs: np.ndarray, at: np.ndarray) -> None:
        """Names the nodes ``pairs`` of the suffixes ``at``; those of one leaf become -1."""
        nonlocal node
        _, inverse, leaves = np.unique(pairs, return_inverse=True, return_counts=True)
        node = np.full(len(code), -1, dtype=np.int64)
        node[at] = np.where(leaves[inverse] > 1, inverse, -1)

    node, depth, n = code, 1, len(code)
    named(code, np.arange(n))
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero(rest >= depth + step)
        at = at[(node[at] >= 0) & (node[at + step] >= 0)]
        named(node[at] * n + node[at + step], at)
        depth += step
    return node >= 0


def _repeats(rows: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """id0, th, start, length of the repeats in the snippets of whole groups."""
    words = Words(rows.column(5))
    rest = words.start[words.doc + 1] - np.arange(len(words.code))
    at = np.flatnonzero(repeated_starts(words.code, rest, window))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])])) if len(at) else at
    length = np.diff(np.concatenate([new, [len(at)]])) + window - 1 if len(at) else at
    doc = words.doc[at[new]]
    start = rows.column(3).to_numpy(zero_copy_only=False)[doc] + at[new] - words.start[doc]
    own = pa.array(doc)
    return pa.RecordBatch.from_arrays([rows.column(1).take(own), rows.column(2).take(own), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64))], names=[*_KEYS, "start", "length"])


def subtree_repeats(found: DataFrame, window: int = WINDOW, budget: int = TREE_BYTES) -> DataFrame:
    """id0, th, start, length of the repeats within the groups of ``found`` (rows of ``snippets``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < budget:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield _repeats(rows.slice(0, cut), window)
                # the rest is copied, so that what is done can go
                rest = rows.take(pa.array(np.arange(cut, rows.num_rows)))
                held, size = [rest], rest.nbytes
        if held:
            yield _repeats(pa.Table.from_batches(held).combine_chunks().to_batches()[0], window)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id0 long, th long, start long, length long")


def window_repeats(live: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """id0, th, start, length of the repeated windows of the anchors listed in ``live``, by counting whole windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(3))
        doc, at, runs, _ = _live(words, batch.column(4), window, prefix)
        own, start = np.repeat(doc, runs), np.repeat(at - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        sums = []
        for seed in (1, 2):
            h, total = words.hashes(seed), np.zeros(len(start), dtype=np.uint64)
            for j in range(window):
                total = total * _MIX[0] + h[start + j]
            sums.append(pa.array(_mixed(total).view(np.int64)))
        take = pa.array(own)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start - words.start[own]), *sums], names=[*_KEYS, "start", "h1", "h2"])

    every = common.map_arrow(live, [*_KEYS, "none", "text", "ats"], "id0 long, th long, start long, h1 long, h2 long", run)
    counts = every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return _splittable(every, counts, ["h1", "h2"]).select(*_KEYS, "start", F.lit(window).cast("long").alias("length"))


def _splittable(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The join of rows with the counts made of them, by one more key than they were counted by.

    Without it the join would stand in the stage of the counting, where adaptive execution cannot split a key's rows.
    """
    own = F.xxhash64(*keys).alias("_own")
    return rows.select("*", own).join(counts.select("*", own), [*keys, "_own"]).drop("_own")


def repeats(texts: DataFrame, window: int = WINDOW, prefix: int = PREFIX, limit: int = LIMIT) -> DataFrame:
    """id0, th, start, length: stretches of words, all in windows that start elsewhere too; ``texts`` has id0, th, none, text."""
    anchors = common.reread(anchor_prefixes(texts, window, prefix), "substring-anchors")
    counts = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (F.col("n") > limit).alias("deep"))
    live = common.reread(_splittable(anchors, counts, ["key"]).select(*_KEYS, "at", "deep"), "substring-live")

    def listed(deep: bool) -> DataFrame:
        """The texts with their live anchors; a text has no more of them than words."""
        own = live.where(F.col("deep") if deep else ~F.col("deep")).groupBy(*_KEYS).agg(F.collect_set("at").alias("ats"))
        return texts.join(own, _KEYS).select(*_KEYS, "none", "text", "ats")

    return subtree_repeats(snippets(listed(False), window, prefix), window).union(window_repeats(listed(True), window, prefix))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, limit: int = LIMIT) -> DataFrame:
    """``key``, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    if not 0 < prefix <= window:
        raise ValueError("a prefix has 1 to window words")
    texts = _texts(docs, key, text)
    found = repeats(texts, window, prefix, limit).groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    joined = texts.join(found, _KEYS, "left").select(*_KEYS, "none", "text", F.col("cuts.start").alias("starts"), F.col("cuts.length").alias("lengths"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for body, starts, lengths in zip(common.utf8(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            words, end, left = body.split(), 0, []
            for a, n in sorted(zip(starts or (), lengths or (), strict=True)):
                left += words[end:a]
                end = max(end, a + n)
            left += words[end:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        ids = pa.array([None if none else i for i, none in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = common.map_arrow(joined, [*_KEYS, "none", "text", "starts", "lengths"], "id long, n_words long, n_removed long, kept string", run)
    return out.withColumnRenamed("id", key)
