"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; of equal texts the row with the most
code points in its original text stays, then the one with the smallest id.

* **Directory.** A narrow pass counts the rows of every hash, combined map-side. The hashes (so copies cannot overfill a bucket) are
  counted by their leading ``MAX_DEPTH`` bits. The directory starts with one bucket; an overfull bucket splits on its next bit, and
  the directory doubles when that bucket was as deep as the directory. Capacity grows with the
  table so that the directory has ``2 ** MAX_DEPTH`` slots at most; it is kept as a shared file and broadcast.
* **Owners.** Every row with its text is routed by the directory to the owner of its bucket, a range of hashes. There equal hashes
  are chained: texts are told apart by comparing their bytes, and equal ones collapse to one entry. A hash of more than ``HOT`` rows has several owners,
  each for a share of its rows, so no group of copies is held by one task; the list of such hashes has a ``HOT``-th of the rows at most.
* **Index.** What owners give is narrow (bucket, hash, digest, group size, the row that stays); the shares of a hot hash add up, entries of one
  hash are numbered along their chain, and the index is written in key order to the shared folder.
* **Look-up.** Every row, as (id, code points, hash, digest), is routed by the directory and joined with its chain
  entry. The join is a plain equi-join, whose hot keys adaptive execution splits.

Defined results: a null text counts as empty; empty and all-white texts are one group. A null id sorts after every
other id. Rows that repeat id and text are one document met several times: all count in ``group_size`` and exactly one
of them may be kept. Other columns are not touched by ``exact_dedup``; ``deduplicate`` returns them as they are: it numbers the rows in a table of its own, finds
the numbers that stay on narrow rows, and the texts meet those once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SPACE = " \t\n\x0b\x0c\r"
#: Entries of a bucket, and the directory's greatest depth.
CAPACITY, MAX_DEPTH = 2_000, 16
#: Rows of one hash that one owner takes.
HOT = 10_000
_STEP = "36893488147419103232"  # 2 ** 65: more than the distance of any two ids
_NO_ID = "9223372036854775808"  # 2 ** 63: after every id


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _slot(hash_: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftrightunsigned(hash_, 64 - depth).cast("int") if depth else F.lit(0)


def _rank(n: Column, id_: Column) -> Column:
    """One number that orders by code points, then by the smaller id; a fixed-width buffer, so that hashing aggregates."""
    big = T.DecimalType(38, 0)
    return (n.cast(T.DecimalType(10, 0)) * F.lit(_STEP).cast(T.DecimalType(20, 0))).cast(big) - F.coalesce(id_.cast(T.DecimalType(20, 0)), F.lit(_NO_ID).cast(T.DecimalType(20, 0))).cast(big)


def split_directory(counts: np.ndarray, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth, and (bucket, local depth) of every slot, from the counts at the greatest depth.

    Buckets split while they hold more than ``capacity`` and can still be told apart; a bucket's number is its place in key order.
    """
    deepest = int(len(counts)).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(counts)])
    depth, buckets, done = 0, [(0, 0)], []  # (prefix, local depth)
    while buckets:
        prefix, local = buckets.pop()
        width = 1 << (deepest - local)
        if total[(prefix + 1) * width] - total[prefix * width] > capacity and local < deepest:
            depth = max(depth, local + 1)  # doubles the directory if the bucket was as deep as it
            buckets += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]
        else:
            done.append((prefix, local))
    slots: list[tuple[int, int]] = []
    for bucket, (_, local) in enumerate(done):  # in key order: the lower half is popped first
        slots += [(bucket, local)] * (1 << (depth - local))
    return depth, slots


def build_directory(hashes: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, DataFrame]:
    """Global depth and the directory (slot, bucket, local_depth) of distinct hashes ``h``, kept in the shared folder."""
    found = hashes.groupBy(_slot(F.col("h"), max_depth).alias("slot")).count().collect()  # 2 ** max_depth rows at most
    counts = np.zeros(1 << max_depth, dtype=np.int64)
    for r in found:
        counts[r["slot"]] = r["count"]
    depth, slots = split_directory(counts, max(capacity, int(4 * counts.sum()) >> max_depth))
    rows = [(i, b, d) for i, (b, d) in enumerate(slots)]
    return depth, common.reread(hashes.sparkSession.createDataFrame(rows, "slot int, bucket int, local_depth int").coalesce(1), "dedup-directory")


def route(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket of their ``h``; the directory has 2 ** MAX_DEPTH slots at most."""
    if not depth:  # one slot, one bucket
        return rows.withColumn("bucket", F.lit(0))
    return rows.withColumn("slot", _slot(F.col("h"), depth)).join(F.broadcast(directory.select("slot", "bucket")), "slot").drop("slot")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot: int = HOT) -> tuple[DataFrame, DataFrame, int]:
    """The index (bucket, h, chain, text_sha256, group_size, keep_n, keep_id), the directory and its depth, both read from the shared folder."""
    body = normalised(F.col(text))
    hashes = common.reread(docs.select(F.xxhash64(body).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-hashes")
    depth, directory = build_directory(hashes, capacity, max_depth)
    shares = hashes.where(F.col("n") > hot).select(F.col("h").alias("_h"), F.ceil(F.col("n") / hot).alias("_shares"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("id"), n.alias("n"), body.alias("body")).withColumn("h", F.xxhash64("body"))
    # a hot hash takes ``hot`` rows, so the list is a ``hot``-th of the table at most
    dealt = rows.join(F.broadcast(shares), F.col("h") == F.col("_h"), "left")
    dealt = dealt.withColumn("share", F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64("id", "n", F.monotonically_increasing_id()), "_shares")).otherwise(0)).drop("_h", "_shares")
    owned = route(dealt, directory, depth).repartition("bucket", "share")
    # grouping in the owner: equal hashes are one chain, and bodies are compared byte by byte
    entries = owned.groupBy("bucket", "share", "h", "body").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max(_rank(F.col("n"), F.col("id"))).alias("rank"))
    narrow = entries.select("bucket", "h", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "size", "n", "rank")
    whole = narrow.groupBy("bucket", "h", "text_sha256").agg(F.sum("size").alias("group_size"), F.max("n").alias("keep_n"), F.max("rank").alias("rank"))
    id_ = (F.col("keep_n").cast(T.DecimalType(10, 0)) * F.lit(_STEP).cast(T.DecimalType(20, 0))).cast(T.DecimalType(38, 0)) - F.col("rank")
    whole = whole.withColumn("keep_id", F.when(id_ < F.lit(_NO_ID).cast(T.DecimalType(20, 0)), id_.cast("long"))).drop("rank")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256"))
    index = whole.repartitionByRange("bucket", "h").withColumn("chain", chain).sortWithinPartitions("bucket", "h", "chain")
    return common.reread(index, "dedup-index"), directory, depth


def _keyed(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    body = normalised(F.col(text))
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"), F.xxhash64(body).alias("h"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), *more)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` as ``key``, keep_id, group_size, kept, text_sha256."""
    index, directory, depth = build_index(docs, key, text, capacity, max_depth, hot)
    rows = _keyed(docs, key, text).groupBy("id", "n", "h", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("times"))
    found = route(rows, directory, depth).join(index.select("bucket", "h", "text_sha256", "group_size", "keep_n", "keep_id"), ["bucket", "h", "text_sha256"])
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("nth") == 1)
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).select(
        F.col("id").alias(key), "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    columns = docs.columns
    held = common.numbered(docs)
    index, directory, depth = build_index(held, key, text, capacity, max_depth, hot)
    rows = route(_keyed(held, key, text, common.ROW), directory, depth)
    best = rows.join(index.select("bucket", "h", "text_sha256", "keep_n", "keep_id"), ["bucket", "h", "text_sha256"]).where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))
    stay = best.groupBy("bucket", "h", "text_sha256").agg(F.min(common.ROW).alias(common.ROW)).select(common.ROW)
    return held.join(stay, common.ROW, "left_semi").select(*columns)
