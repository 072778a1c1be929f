"""Helpers shared by the corpus operators: shared tables, bounded samples, Arrow text access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.session import scratch_path


def reread(df: DataFrame, kind: str) -> DataFrame:
    """Write to a fresh table in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps the table columnar, so later reads prune.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The row number that ``numbered`` adds.
ROW = "_tidepool_row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, in a fresh table of the shared folder, so that every later read sees the same numbers."""
    return reread(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _trim() -> None:
    """Give memory that a finished task no longer uses back to the system; workers wait for the next task beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of 8 MB; its default of 64 MB is held several times over by a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


#: Bits of a key filter at most (8 MB); with more keys it lets more other rows through.
MOST_BITS = 1 << 26


def filter_bits(n: int) -> int:
    """Bits of a filter of ``n`` keys: a power of two, 8 to 16 a key (about 1 to 4 % of other keys pass) until there are ``MOST_BITS``."""
    return min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length() - 1))


def _word(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(bits // 64 - 1)


def _mask(key: Column, mark: Column) -> Column:
    """Four bits of a word, for the key and its mark."""
    h, one = F.xxhash64(key, mark, F.lit(1)), F.lit(1).cast("long")
    own = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
    return own[0].bitwiseOR(own[1]).bitwiseOR(own[2]).bitwiseOR(own[3])


def key_filter(marked: DataFrame, key: str, mark: str, bits: int) -> Column:
    """Bloom filter of (key, mark) as a scalar: an array of ``bits`` / 64 words, of which the key names one and both together four bits there."""
    words = marked.groupBy(_word(F.col(key), bits).alias("id")).agg(F.bit_or(_mask(F.col(key), F.col(mark))).alias("bits"))
    every = marked.sparkSession.range(bits // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()  # at most MOST_BITS / 64 words


def key_word(words: Column, key: Column, bits: int) -> Column:
    """The word of the filter that ``key`` names, for ``has_mark``."""
    return F.get(words, _word(key, bits).cast("int"))


def has_mark(word: Column, key: Column, mark: Column) -> Column:
    """Whether the key may be there with the mark; never false if it is."""
    own = _mask(key, mark)
    return word.bitwiseAND(own) == own


def sample_ids(rows: DataFrame, key: str, stratum: str, per_stratum: int) -> DataFrame:
    """At most ``per_stratum`` ids of every stratum, those with the smallest id hash.

    Only the two narrow columns are read, and distinct ids count, so repeated rows cannot crowd the sample. Ids are
    counted by stratum and ``PARTS`` ranges of their hash (combined map-side); running sums over those few rows give each stratum the range
    in which its last id lies, and only ids up to there are ranked. A hot stratum thus brings little more than its sample to a task.
    """
    own = (
        rows.where(F.col(key).isNotNull() & F.col(stratum).isNotNull())
        .select(F.col(key), F.col(stratum), F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("_h"))
        .distinct()
        .withColumn("_part", F.shiftright("_h", 64 - PARTS.bit_length() + 1))
    )
    counts = own.groupBy(stratum, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).where(F.col("_before") < per_stratum).groupBy(stratum).agg(F.max("_part").alias("_last"))
    # one row for each stratum, of which a model has few (labels, languages)
    near = own.join(F.broadcast(last), stratum).where("_part <= _last")
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return near.withColumn("_rn", nth).where(F.col("_rn") <= per_stratum).select(key, stratum)


#: Ranges of the hash by which the ids of a stratum are counted.
PARTS = 1024


#: Bytes of text that one call of a mapped function gets, unless a single row has more.
GROUP_BYTES = 1 << 20


def groups(batch: pa.RecordBatch, budget: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``budget`` bytes of text each, so that memory follows the slice and not the batch."""
    size = np.ones(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // budget
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], group: int = GROUP_BYTES) -> DataFrame:
    """``mapInArrow`` over the named columns; ``fn`` maps one group of rows, of about ``group`` bytes of text, to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in groups(batch, group):
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out
                    del out, part
            del batch
        _trim()

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def broadcast_value(spark: SparkSession, value):
    """A read-only value for tasks; callers state the bound of its size."""
    return spark.sparkContext.broadcast(value)


def windows(total: int, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    for a in range(0, total, size):
        yield a, min(total, a + size)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, out: np.ndarray) -> None:
    """Add to ``out[k]`` the sum of ``values`` over positions ``starts[k]:ends[k]``; ``values[0]`` stands for position ``a``.

    Segments are ascending and disjoint; those outside the window get nothing. Sums are in float64.
    """
    b = a + len(values)
    lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    if lo >= hi:
        return
    s, e = np.maximum(starts[lo:hi], a) - a, np.minimum(ends[lo:hi], b) - a
    live = np.flatnonzero(e > s)
    if not len(live):
        return
    cuts = np.empty(2 * len(live), dtype=np.int64)
    cuts[0::2], cuts[1::2] = s[live], e[live]
    padded = np.concatenate([values, np.zeros((1,) + values.shape[1:], dtype=values.dtype)])
    out[lo + live] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[0::2]


def ragged_take(values: list[bytes], rows: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of ``values[rows[0]]``, ``values[rows[1]]``, ... one after another, and how many each row has.

    ``skip`` marks rows whose first number is left out.
    """
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) >> 2
    start, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), dtype="<u4")
    first, count = start[rows], sizes[rows]
    if skip is not None:
        first, count = first + skip, count - skip
    place = np.cumsum(count) - count
    return flat[np.repeat(first - place, count) + np.arange(int(count.sum()))], count


def minimise(gradient: Callable[[np.ndarray], np.ndarray], curve: Callable[[np.ndarray], np.ndarray], size: int, steps: int) -> np.ndarray:
    """Accelerated gradient descent from zero on a smooth convex function.

    ``curve`` maps a vector by an upper bound of the Hessian; its top eigenvalue, found by power iteration, sets the step. Common
    features move first, so few steps leave rare ones near zero.
    """
    x = np.random.default_rng(0).standard_normal(size)
    top = 1.0
    for _ in range(12):
        x /= np.linalg.norm(x) or 1.0
        x = curve(x)
        top = np.linalg.norm(x)
    step = 1 / (1.1 * top) if top > 0 else 1.0
    w, ahead, t = np.zeros(size), np.zeros(size), 1.0
    for _ in range(steps):
        new = ahead - step * gradient(ahead)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w


def byte_runs(texts: pa.Array, part: Callable[[np.ndarray], np.ndarray], map_: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the UTF-8 bytes that ``part`` marks, in all texts of a string array without nulls.

    Returns the runs (binary array, bytes mapped by the table ``map_``), the text of each run, its first and last + 1 byte, and the bytes.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    cuts = cuts - cuts[0]
    own = part(raw)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[cuts] = True  # a run ends with its text
    starts = np.flatnonzero(own & (edge[:-1] | ~np.concatenate([[False], own[:-1]])))
    ends = np.flatnonzero(own & (edge[1:] | ~np.concatenate([own[1:], [False]]))) + 1
    flat = raw[own] if map_ is None else map_[raw[own]]
    places = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=places[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(flat)])
    return runs, np.searchsorted(cuts, starts, "right") - 1, starts, ends, raw
