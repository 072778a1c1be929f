"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by a dictionary of trie-node pairs.

**Tries.** The nodes of the trie of all words and of the trie of all reversed words are numbered: the sorted words are streamed, a word creates the
nodes below its common prefix with the one before, and they get the next numbers. Sorting is a range shuffle, so each task numbers
its own range; the nodes that a range shares with earlier ones are those on the path of its first word, and only the first and last word
of every range pass the driver to settle them.

**Pairs.** A word of length L has the pairs (node of its first i letters, node of its last L - i) for every cut i, and, with letter i skipped,
(first i, last L - i - 1). Two words are near by a replacement if they share a skipped pair, and by an insertion if a skipped pair of the
longer is a cut pair of the shorter. Nodes stand for exact strings, so a shared pair is an exact neighbour and needs no check. Deleting any letter of a run of
equal letters gives the same word, so only the run's first skip may meet a cut pair: every pair of near words meets exactly once.

**Scale.** All words with one pair differ in one letter, so a pair's group is no larger than the alphabet plus one, whatever the corpus; it
gives one row for each member (its neighbours there and the best of them), never the pairs. Words are counted map-side. A form has five
times the word's count at least, so chains of forms have fewer than 28 steps and five rounds of pointer doubling end them.

Defined results: a null text has no words; a null id counts as the empty string in the planted deletions. Repeated rows count each. Words of any length are
kept, in time and space linear in the length. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS, COUNT, RATIO, PLANT = 6, 5, 5, 199
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)


def letters(raw: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF (the lead byte C3 and the byte after it)."""
    own = _LETTER[raw]
    if len(raw):
        own[1:] |= raw[:-1] == 0xC3
    return own


def _shifted(crc: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Checksums of the same bytes with 0, 1, .. ``most`` zero bytes after them, as combining with what follows needs them."""
    for _ in range(most + 1):
        yield crc
        crc = _CRC[crc & 0xFF] ^ (crc >> 8)


def planted(words: list[bytes], word: np.ndarray, ids: list[str], doc: np.ndarray, n: int = PLANT) -> dict[int, int]:
    """For the pairs (doc, word) whose crc32 of ``id:word`` ``n`` divides: place of the pair and that checksum."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    own = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    heads = [f"{i}:".encode() for i in ids]
    head = np.fromiter(map(zlib.crc32, heads), dtype=np.uint32, count=len(heads))
    found: dict[int, int] = {}
    by_size = np.argsort(sizes[word], kind="stable")
    cuts = np.searchsorted(sizes[word][by_size], np.arange(66))
    for size, moved in enumerate(_shifted(head, 64)):
        at = by_size[cuts[size] : cuts[size + 1]]
        crc = moved[doc[at]] ^ own[word[at]]
        hit = crc % n == 0
        found.update(zip(at[hit].tolist(), crc[hit].tolist(), strict=True))
    for i in by_size[cuts[65] :].tolist():  # longer words, one by one
        if not (crc := zlib.crc32(words[word[i]], int(head[doc[i]]))) % n:
            found[i] = crc
    return found


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LETTERS, plant: int | None = None) -> DataFrame:
    """word and n: occurrences of every word of ``least`` code points; ``plant`` deletes a letter where it divides a checksum."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, doc, *_ = common.byte_runs(batch.column(1), letters, _LOWER)
        coded = runs.dictionary_encode()
        at, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        counts = np.bincount(at, minlength=n)
        sizes = pc.utf8_length(coded.dictionary.cast(pa.large_string())).to_numpy()
        more: list[tuple[str, int]] = []
        if plant and n:
            pairs, times = np.unique((doc * n + at)[sizes[at] >= least], return_counts=True)
            words = coded.dictionary.to_pylist()
            for i, crc in planted(words, pairs % n, batch.column(0).to_pylist(), pairs // n, plant).items():
                w = int(pairs[i] % n)
                counts[w] -= times[i]
                whole = words[w].decode()
                if len(whole) > least:
                    cut = crc % len(whole)
                    more.append((whole[:cut] + whole[cut + 1 :], int(times[i])))
        live = np.flatnonzero((sizes >= least) & (counts > 0))
        words_out = pa.concat_arrays([coded.dictionary.take(pa.array(live)).cast(pa.large_string()).cast(pa.string()), pa.array([w for w, _ in more], pa.string())])
        return pa.RecordBatch.from_arrays([words_out, pa.array(np.concatenate([counts[live], np.array([c for _, c in more], dtype=np.int64)]).astype(np.int64))], names=["word", "n"])

    found = common.map_arrow(rows, ["k", "t"], "word string, n long", run, group=8 << 20)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])


def number_trie(words: DataFrame, word: str, keep: list[str]) -> DataFrame:
    """``word`` and ``keep`` with the word's rank (from 0, in code point order) and the numbers of its trie nodes by depth, the root (0) first.

    ``word`` must be distinct and not null.
    """
    columns = [word, *keep]
    inner = [f"c{i}" for i in range(len(columns))]
    types = [words.schema[c].dataType.simpleString() for c in columns]
    ordered = words.select(*[F.col(c).alias(n) for c, n in zip(columns, inner, strict=True)]).repartitionByRange("c0").sortWithinPartitions("c0")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the nodes of one range as if it were the first."""
        pid, nth, made, last, path = TaskContext.get().partitionId(), 0, 0, "", []
        for batch in batches:
            paths = []
            for w in batch.column(0).to_pylist():
                shared = _shared(last, w)
                path = path[:shared] + list(range(made, made + len(w) - shared))
                made, last = made + len(w) - shared, w
                paths.append(path)
            at = np.arange(nth, nth + batch.num_rows, dtype=np.int64)
            nth += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), pid, dtype=np.int32)), pa.array(at), pa.array(paths, pa.list_(pa.int64()))], names=[*inner, "pid", "nth", "path"])

    schema = ", ".join([*(f"{n} {t}" for n, t in zip(inner, types, strict=True)), "pid int, nth long, path array<long>"])
    rows = common.reread(ordered.mapInArrow(local, schema), "trie-nodes")
    # one row for each range
    edges = rows.groupBy("pid").agg(F.min_by("c0", "nth").alias("first"), F.max_by("c0", "nth").alias("last"), F.max_by("path", "nth").alias("path"), F.count(F.lit(1)).alias("n")).collect()
    settled, base, rank, last, path = [], 0, 0, "", []
    for e in sorted(edges, key=lambda e: e["pid"]):
        known = path[: _shared(last, e["first"])]
        settled.append((e["pid"], rank, base - len(known), known))
        path = [known[x] if x < len(known) else base - len(known) + x for x in e["path"]]
        base, rank, last = base + e["path"][-1] + 1 - len(known), rank + e["n"], e["last"]
    ranges = words.sparkSession.createDataFrame(settled, "pid int, rank0 long, base long, known array<long>")
    numbered = F.transform("path", lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(x + F.col("base")) + 1)
    found = rows.join(F.broadcast(ranges), "pid")  # one row for each range
    return found.select(*[F.col(n).alias(c) for c, n in zip(columns, inner, strict=True)], (F.col("rank0") + F.col("nth")).alias("rank"), F.concat(F.array(F.lit(0).cast("long")), numbered).alias("nodes"))


def near_words(words: DataFrame) -> DataFrame:
    """id, word, n, n_near, best (n and -id of the near word with the largest n, then the least word) of every (word, n); id is the word's rank."""
    forward = common.reread(number_trie(words, "word", ["n"]).select(F.col("rank").alias("id"), "word", "n", F.col("nodes").alias("heads")), "trie-forward")
    backward = number_trie(forward.select("id", F.reverse("word").alias("back")), "back", ["id"]).select("id", F.col("nodes").alias("tails"))
    # a row becomes some twenty: as many tasks as the session has for a shuffle, whatever the narrow rows weigh
    parts = int(forward.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = forward.repartition(parts, "id").join(backward.repartition(parts, "id"), "id").select("id", "n", "heads", "tails", F.split("word", "").alias("letters"))
    length = F.size("heads") - 1
    pair = lambda i, skip, first: F.struct(F.get("heads", i).alias("head"), F.get("tails", length - i - F.lit(skip)).alias("tail"), F.lit(not skip).alias("cut"), first.alias("first"))
    cuts = F.transform(F.sequence(F.lit(0), length), lambda i: pair(i, 0, F.lit(False)))
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: pair(i, 1, (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))))
    keyed = both.select("n", (-F.col("id")).alias("neg"), F.explode(F.concat(cuts, skips)).alias("p")).select("p.head", "p.tail", "p.cut", "p.first", "n", "neg")
    # a group differs in one letter: no more members than letters, and one cut
    met = keyed.groupBy("head", "tail").agg(F.collect_list(F.struct("cut", "first", "n", "neg")).alias("m")).where("size(m) > 1")
    met = met.select(F.filter("m", lambda x: ~x["cut"]).alias("skips"), F.get(F.filter("m", lambda x: x["cut"]), F.lit(0)).alias("whole"))
    value = lambda x: F.struct(x["n"].alias("n"), x["neg"].alias("neg"))
    met = met.withColumn("top", F.sort_array(F.transform("skips", value), asc=False)).withColumn("firsts", F.transform(F.filter("skips", lambda x: x["first"]), value))
    whole = F.when(F.col("whole").isNotNull(), value(F.col("whole")))
    other = lambda x: F.when(F.get("top", F.lit(0))["neg"] == x["neg"], F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0)))
    of_skips = F.transform("skips", lambda x: F.struct(x["neg"].alias("neg"), (F.size("skips") - 1 + F.when(x["first"] & F.col("whole").isNotNull(), 1).otherwise(0)).alias("near"),
                                                       F.greatest(other(x), F.when(x["first"], whole)).alias("best")))
    of_whole = F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole")["neg"].alias("neg"), F.size("firsts").alias("near"), F.array_max("firsts").alias("best"))))
    out = met.select(F.explode(F.concat(of_skips, F.coalesce(of_whole, F.array().cast("array<struct<neg:bigint,near:int,best:struct<n:bigint,neg:bigint>>>")))).alias("o")).select("o.*").where("near > 0")
    found = out.groupBy("neg").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))
    return forward.join(found.select((-F.col("neg")).alias("id"), "n_near", "best"), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")


#: A form has RATIO times the count, and counts are below 2 ** 63, so a chain has fewer than 2 ** ROUNDS steps.
ROUNDS = 5


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (distinct word, n)."""
    if ratio < 5:
        raise ValueError("chains of forms are bounded for a ratio of 5 or more")
    near = common.reread(near_words(words), "variants-near")
    formed = near.withColumn("to", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.neg")))
    links = common.reread(formed.where("to is not null").select("id", "to"), "variants-links")
    for _ in range(ROUNDS):
        on = links.select(F.col("id").alias("_at"), F.col("to").alias("_next"))
        links = common.reread(links.join(on, F.col("to") == F.col("_at"), "left").select("id", F.coalesce("_next", "to").alias("to")), "variants-links")
    names = near.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    rooted = formed.join(links.select("id", F.col("to").alias("end")), "id", "left")
    forms = rooted.join(names.withColumnRenamed("_word", "form"), F.col("to") == F.col("_id"), "left").drop("_id")
    roots = forms.join(names.withColumnRenamed("_word", "root"), F.col("end") == F.col("_id"), "left").drop("_id")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("to").isNotNull(), F.col("best.n")).alias("form_n"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, count: int = COUNT, ratio: int = RATIO, plant: int | None = None) -> DataFrame:
    """Variants among the words of ``docs`` that have ``letters`` code points and ``count`` occurrences at least."""
    return variants(common.reread(word_counts(docs, key, text, letters, plant).where(F.col("n") >= count), "variants-words"), ratio)
