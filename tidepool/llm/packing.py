"""Best-fit packing of tokenised documents into sequences of fixed capacity, by large-item matching.

Documents become token ids plus an end id; one longer than the capacity is cut into full pieces, the
remainder first. Pieces above a third of the capacity are *large*: a sequence holds two of them at most, and
they are paired greedily, the longest with the longest that fits beside it. Smaller pieces then go, longest first, each to
the sequence with the tightest sufficient gap; a new sequence opens only if none fits.

**Scale.** Pieces of equal length are interchangeable, so the plan is made for the histogram of lengths (``capacity`` counts, whatever
the corpus) in classes of equal sequences: a class is a number of sequences with one layout. Every step empties a length or
a gap, and a gap is more than halved by each length that fills it, so the plan's size depends on the capacity only. Tasks place
their pieces by rank within their length: rank = pieces of that length in earlier partitions + place in the own one.
Only (partition, length, count) rows are shuffled for that, spread by length and partition, so a length that a third of all pieces
share is no hot key. Token ids never leave the row that they belong to.

Tokens come from the ``tokenizers`` library. Byte-level BPE never merges across a single space or line feed between
other characters, so a text is cut there and each distinct piece of text is encoded once by a worker (a bounded cache);
texts with other white space runs are encoded whole. The ids are those of encoding the whole text.

Defined results: a null text counts as empty and gives one piece, the end id. Null or repeated ids are placed like any other row.
Sequence numbers are any distinct numbers; offsets within a sequence are gapless from 0. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY, END_ID = 2048, 0
#: Distinct pieces of text in a generation of a worker's cache (some 0.2 KB each); it remembers two generations, those used last.
CACHE = 200_000
_MARKS = ".,;:!?*$%&#|"  # neither letters, digits, white space nor apostrophes
#: New pieces that are encoded in one call.
JOINED = 4096
_OTHER_SPACE = re.compile(r"[^\S \n]")


class ByteBpeEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, by a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one character for each byte
            self.width[i] = len(token)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # pieces with other white space: their texts are encoded whole
        self.limit = cache

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Encode the pieces of text not in the cache, joined where BPE is cut anyway.

        A word and the marks after it are cut too, so that a word is encoded once whatever follows it.
        """
        cache = self.cache
        if _OTHER_SPACE.search("".join(missing)):
            self.odd.update(w for w in missing if _OTHER_SPACE.search(w))
        stems: dict[str, str] = {}
        plain: list[str] = []
        for w in missing:
            if w[-1:] in _MARKS and w and (stem := w.rstrip(_MARKS))[-1:].isalpha() and w not in self.odd:
                stems[w] = stem
            elif w in ("", "\n") or w in self.odd:
                cache[w] = b"" if w in self.odd else self._whole(w or " ")
            else:
                plain.append(w)
        if stems:
            # what is not known yet of both parts; a tail is encoded after a line feed
            own = {*stems.values(), *("\n" + w[len(stem) :] for w, stem in stems.items())}
            plain = list(dict.fromkeys([*plain, *(w for w in own if w not in cache)]))
        for a in range(0, len(plain), JOINED):
            self._learn_joined(plain[a : a + JOINED])
        for w, stem in stems.items():
            cache[w] = cache[stem] + cache["\n" + w[len(stem) :]][4:]

    def _learn_joined(self, words: list[str]) -> None:
        batch = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(batch)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.width[ids])
        want = np.cumsum(pc.binary_length(pa.array(batch, pa.string())).to_numpy(zero_copy_only=False))
        cut = np.searchsorted(ends, want) + 1
        if not np.array_equal(ends[cut - 1], want):
            raise AssertionError("a token crosses a cut")
        raw, to = ids.tobytes(), (4 * cut).tolist()
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, [0, *to[:-1]], to)), strict=True))

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the cache or newly learnt."""
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
            self.odd = {w for w in self.odd if w in self.old}
        values = list(map(self.cache.get, words))
        holes = [i for i, v in enumerate(values) if v is None]
        if holes:
            old = {words[i]: v for i in holes if (v := self.old.get(words[i])) is not None}
            self.cache.update(old)
            self._learn([words[i] for i in holes if words[i] not in old])
            for i in holes:
                values[i] = self.cache[words[i]]
        return values

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a string array without nulls."""
        if not len(texts):
            return []
        runs = [pc.match_substring(texts, s) for s in ("  ", "\n\n", " \n", "\n ")]
        whole = functools.reduce(pc.or_, runs).to_numpy(zero_copy_only=False)
        # the first piece has no space before it: it is encoded after a line feed, whose id is skipped
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        at = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        rows, words = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = self._lookup(words)
        skip = np.zeros(len(rows), dtype=np.int64)
        skip[at] = 1
        if self.odd:
            odd = np.fromiter((w in self.odd for w in words), dtype=bool, count=len(words))
            whole = whole | np.logical_or.reduceat(odd[rows], at)
            skip[odd[rows]] = 0  # an odd piece has no ids of its own
        ids, count = common.ragged_take(values, rows, skip)
        ends = np.cumsum(np.add.reduceat(count, at))
        out = np.split(ids, ends[:-1])
        for i in np.flatnonzero(whole):
            out[i] = np.frombuffer(self._whole(texts[i].as_py()), dtype="<u4")
        return out


_encoders: dict[tuple[str, int], ByteBpeEncoder] = {}


def _encoder(path: str) -> ByteBpeEncoder:
    """One encoder for a worker process and file."""
    if (path, CACHE) not in _encoders:
        _encoders[path, CACHE] = ByteBpeEncoder(path)
    return _encoders[path, CACHE]


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids (little-endian 32-bit) of every piece; ``tokenizer`` is a path that tasks can read."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, length, ids = [], [], [], [], []
        for i, own in enumerate(_encoder(tokenizer).encode(batch.column(1))):
            raw = own.tobytes() + tail
            n = len(raw) // 4
            at = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for j in range(len(at) - 1):
                doc.append(i)
                piece.append(j)
                start.append(at[j])
                length.append(at[j + 1] - at[j])
                ids.append(raw[4 * at[j] : 4 * at[j + 1]])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                                          names=["k", "piece", "start", "length", "ids"])

    out = common.map_arrow(rows, ["k", "t"], f"k {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary", run, group=4 << 20)
    return out.withColumnRenamed("k", key)


class _Plan:
    """Classes of equal sequences. ``layout``: (length, pieces of it in one sequence, offset of the first)."""

    def __init__(self, capacity: int):
        self.capacity, self.gaps = capacity, []  # sorted gaps that have classes
        self.by_gap: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)

    def add(self, gap: int, count: int, layout: list[tuple[int, int, int]]) -> None:
        if count:
            if gap not in self.by_gap:
                insort(self.gaps, gap)
            self.by_gap[gap].append((count, layout))

    def take(self, least: int) -> tuple[int, int, list[tuple[int, int, int]]] | None:
        """A class with the tightest gap of ``least`` or more."""
        i = bisect_left(self.gaps, least)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        count, layout = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.pop(i)
        return gap, count, layout


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Classes (number of sequences, layout) for the histogram length -> pieces."""
    left = {s: n for s, n in counts.items() if n}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be in 1..capacity")
    done = _Plan(capacity)
    large = sorted(s for s in left if 3 * s > capacity)
    # large pieces: the longest left with the longest that fits beside it
    while large:
        s = large[-1]
        i = bisect_left(large, capacity - s + 1) - 1
        if i < 0:
            done.add(capacity - s, left[s], [(s, 1, 0)])
            used = {s: left[s]}
        elif large[i] == s and left[s] == 1:
            other = large[i - 1] if i else None
            done.add(capacity - s - (other or 0), 1, [(s, 1, 0)] + ([(other, 1, s)] if other else []))
            used = {s: 1} | ({other: 1} if other else {})
        elif large[i] == s:
            done.add(capacity - 2 * s, left[s] // 2, [(s, 2, 0)])
            used = {s: left[s] // 2 * 2}
        else:
            n = min(left[s], left[large[i]])
            done.add(capacity - s - large[i], n, [(s, 1, 0), (large[i], 1, s)])
            used = {s: n, large[i]: n}
        for size, n in used.items():
            left[size] -= n
            if not left[size]:
                large.remove(size)
    # small pieces, longest first, to the tightest gap; equal sequences are filled together
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            found = done.take(s)
            gap, count, layout = found or (capacity, -(-n // (capacity // s)), [])
            each = gap // s
            full = min(count, n // each)
            at = capacity - gap
            done.add(gap - each * s, full, [*layout, (s, each, at)])
            n -= full * each
            if full < count:
                if n:  # the last pieces of this length share one sequence
                    done.add(gap - n * s, 1, [*layout, (s, n, at)])
                    n, count = 0, count - 1
                done.add(gap, count - full, layout)
    return [c for gap in done.gaps for c in done.by_gap[gap]]


def placements(classes: list[tuple[int, list[tuple[int, int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces of a sequence, first sequence, offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    base = 0
    for count, layout in classes:
        for length, each, offset in layout:
            rows[length].append((next_rank[length], each, base, offset))
            next_rank[length] += count * each
        base += count
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows of ``pieces`` (kept narrow by the caller) with sequence_id and offset.

    Numbering needs rows to keep their partition and place, so they are first written to the shared folder.
    """
    names = [c for c in pieces.columns]
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(length)
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, pieces.schema.fields, strict=True)), "pid int, nth long"])

    def number(batches):
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(own, kind="stable")
            ranked = own[order]
            first = np.searchsorted(ranked, ranked)
            nth = np.empty(len(own), dtype=np.int64)
            nth[order] = np.arange(len(own)) - first
            nth += seen[own]
            seen += np.bincount(own, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), pid, dtype=np.int32)), pa.array(nth)], names=[*inner, "pid", "nth"])

    # written before they are numbered, so that a task never runs two Python workers at once
    narrow = common.reread(pieces.toDF(*inner), "packing-pieces")
    rows = common.reread(narrow.mapInArrow(number, schema), "packing-numbered")
    size = f"c{at}"
    counts = rows.groupBy("pid", F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("base", F.coalesce(earlier, F.lit(0)))
    # at most ``capacity`` rows
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    sent = common.broadcast_value(pieces.sparkSession, placements(plan(histogram, capacity)))
    ranked = rows.join(bases.select(F.col("pid").alias("_pid"), F.col("size").alias("_size"), "base"), (F.col("pid") == F.col("_pid")) & (F.col(size) == F.col("_size")))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(inner)).to_numpy(zero_copy_only=False)
        seq, offset = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int64)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for group in np.split(order, cuts):
            table, r = sent.value[int(own[group[0]])], rank[group]
            row = table[np.searchsorted(table[:, 0], r, "right") - 1]
            seq[group] = row[:, 2] + (r - row[:, 0]) // row[:, 1]
            offset[group] = row[:, 3] + (r - row[:, 0]) % row[:, 1] * own[group]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], pa.array(seq), pa.array(offset)], names=[*inner, "sequence_id", "offset"])

    ready = ranked.select(*inner, (F.col("base") + F.col("nth")).alias("rank"))
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, pieces.schema.fields, strict=True)), "sequence_id long, offset long"])
    return common.map_arrow(ready, [*inner, "rank"], schema, place).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    cut = token_pieces(docs, tokenizer, key, text, capacity, end_id)
    return pack(cut.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(pieces: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id and tokens (array of ids) of every sequence, from the pieces' ids and their places.

    ``key`` and piece must name a piece here. A sequence has no more than ``capacity`` tokens, so its group is bounded.
    """
    own = pieces.select(F.col(key).alias("_k"), F.col("piece").alias("_p"), "ids")
    both = placed.select(key, "piece", "sequence_id", "offset").join(own, F.col(key).eqNullSafe(F.col("_k")) & (F.col("piece") == F.col("_p")))
    rows = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.transform("parts", lambda x: x["ids"]).alias("parts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.frombuffer(b"".join(p), dtype="<u4").astype(np.int32) for p in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=["sequence_id", "tokens"])

    return common.map_arrow(rows, ["sequence_id", "parts"], "sequence_id long, tokens array<int>", run)
