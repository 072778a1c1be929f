"""SimHash near-dedup with covering locality-sensitive hashing.

A text is lower-cased (A-Z) and cut into words; its 3-word shingles, repeats included, are hashed
with XXH64 (seed 42) and a fingerprint bit is 1 where more than half of the hashes have it.

**Covering.** Each of the 64 bit positions i carries a non-zero vector m(i) of F2^(r+1), r the radius. For every non-zero v of
F2^(r+1) the mask A(v) keeps the positions with <m(i), v> = 1. The positions in which two
fingerprints within the radius differ span at most r dimensions, so some v is orthogonal to all of them and the two agree on
A(v): every such pair collides in one of the 2^(r+1) - 1 tables. No link can be lost.

**Scale.** Equal fingerprints collapse first (partial aggregation), so exact copies are one node. Buckets
of one node are dropped by a counting aggregation. A bucket of more than ``HOT`` nodes is split by
covering the bits its mask leaves free once more, with the same guarantee; its parts have no more than
``2 ** 14`` nodes as so few bits remain. Inside a bucket the linked sets are found by search from unvisited nodes, and
a set of s nodes leaves as s - 1 edges, never as pairs. Components come from alternating large-star
and small-star steps, each written to the shared folder.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; a
text of one or two words has one shingle. ``component_id`` is the smallest id reachable (null only if the
component has no id). Repeated rows are repeated in the result. ``deduplicate`` keeps the row of the smallest id of each
component, one only if rows repeat it. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, RADIUS, HOT, SEED = 3, 3, 4096, 42
MAX_ROUNDS = 60


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    values, votes = np.array(hashes, dtype="<u8"), np.zeros(64, dtype=np.int64)
    for a in range(0, len(values), 1 << 15):
        part = values[a : a + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(values), bitorder="little").view("<u8")[0])


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """A mask over the given bit positions for every non-zero v: two values within the radius agree on one of them."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << p for i, p in enumerate(positions) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (64 bits as a signed long) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(b, shingle) for b in common.utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return common.map_arrow(rows, ["id", "t"], "id long, fp long", run)


def linked_sets(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node of its linked set) of the nodes within a bucket that link, without the smallest."""
    left, out = np.sort(members), []
    while len(left) > 1:
        queue, found, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                new = left[near]
                left = left[~near]
                queue.extend(new)
                found.extend(new)
        least = min(found)
        out += [(int(x), int(least)) for x in found if x != least]
    return out


def edges(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between fingerprints ``fp`` that connect exactly the nodes linked within the radius."""
    masks = covering_masks(list(range(64)), radius)
    tables = F.array(*[F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket")) for v, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.table", "k.bucket")
    sizes = keyed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keyed.join(sizes, ["table", "bucket"])

    def parts(m: int):
        """Second covering, of the bits the mask leaves free."""
        own = covering_masks([i for i in range(64) if not m >> i & 1], radius)
        return F.array(*[F.struct(F.lit(w).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m | s))).alias("bucket")) for w, s in enumerate(own)])

    second = parts(masks[0])
    for v, m in enumerate(masks[1:], 1):
        second = F.when(F.col("table") == v, parts(m)).otherwise(second)
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.col("bucket").alias("bucket")))
    dealt = met.select("fp", "table", F.explode(F.when(F.col("size") > hot, second).otherwise(whole)).alias("k"))
    groups = dealt.groupBy("table", "k.part", "k.bucket").agg(F.collect_list("fp").alias("members")).where("size(members) > 1").select("members")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [e for members in batch.column(0) for e in linked_sets(members.values.to_numpy(zero_copy_only=False), radius)]
        us, vs = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return common.map_arrow(groups, ["members"], "u long, v long", run).distinct()


def star_components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(u, v): every node of the edges but the smallest of its component, with that smallest node.

    Alternates large-star and small-star until the edges no longer change.
    """
    links, seen = common.reread(links.where("u <> v"), "simhash-links"), None
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        links = common.reread(small.where("u <> v").distinct(), "simhash-links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Every row as ``key``, fingerprint (16 hex digits), component_id."""
    fps = common.reread(fingerprints(docs, key, text, shingle), "simhash-fingerprints")
    nodes = common.reread(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-nodes")
    roots = star_components(edges(nodes.select("fp"), radius, hot)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    ``key`` names a document: rows that repeat it with other texts stay one for each text.
    """
    columns = docs.columns
    held = common.numbered(docs)
    found = near_dedup(held, key, text, shingle, radius, hot)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_keep")).distinct()
    own = held.select(common.ROW, F.col(key).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_own"))
    stay = own.join(kept, F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").groupBy("_id", "_own").agg(F.min(common.ROW).alias(common.ROW)).select(common.ROW)
    return held.join(stay, common.ROW, "left_semi").select(*columns)
