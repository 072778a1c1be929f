"""Access-limit audit: attempts beyond the limit of a fixed window, per source key.

A window that holds a third of all attempts must not be sorted by one task. Only the first limit + 1 attempts of a window are ranked, of which
each task keeps no more before the shuffle; the last of them, if there is one, is where rejecting begins. Attempts then meet the cut of their
window in an equi-join whose other side has one row for each window over its limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    kind: str
    seconds: int  # of the window
    limit: int


#: Windows in a row that one state of the stream covers.
SPAN_WINDOWS = 180

# Login 5 attempts per 2 minutes; registration 10 per 60 minutes.
LIMITS = [Limit("login", 120, 5), Limit("register", 3600, 10)]


def _windows(access: DataFrame, limits: list[Limit]) -> DataFrame:
    """Attempts of the limited kinds with ``limit`` and ``window_start``."""
    width = limit = F.lit(None).cast("long")
    for lim in limits:
        width = F.when(F.col("kind") == lim.kind, F.lit(lim.seconds * 1_000_000)).otherwise(width)
        limit = F.when(F.col("kind") == lim.kind, F.lit(lim.limit)).otherwise(limit)
    a = access.withColumn("_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    a = a.withColumn("_width", width).withColumn("limit", limit.cast("int")).where("_width is not null and ts is not null")
    return a.withColumn("window_start", F.expr("timestampadd(MICROSECOND, -pmod(_us, _width), ts)"))


def over_limit(access: DataFrame, limits: list[Limit] = LIMITS, id_col: str = "event_id") -> DataFrame:
    """Rejected attempts: the (limit+1)-th and later attempt of a key within one window.
    Windows are epoch-aligned tumbling windows; keys and kinds are independent, and a null key is one of them. ``id_col`` names an attempt; one without a time is in no window."""
    out, group = ["source_key", "kind", "window_start", "ts", id_col, "limit"], ["source_key", "kind", "window_start"]
    a = _windows(access, limits).select(*out)
    most = max((lim.limit for lim in limits), default=0) + 1
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("ts", id_col))
    cuts = a.withColumn("_rn", nth).where(F.col("_rn") <= most).where("_rn = limit + 1").select(*[F.col(c).alias(f"_{c}") for c in group], F.struct("ts", id_col).alias("_cut"))
    met = a.join(cuts, F.col("source_key").eqNullSafe(F.col("_source_key")) & (F.col("kind") == F.col("_kind")) & (F.col("window_start") == F.col("_window_start")))
    return met.where(F.struct("ts", id_col) >= F.col("_cut")).select(*out)


def window_counts(access: DataFrame, lim: Limit, lateness: str = "10 minutes") -> DataFrame:
    """Streaming twin for one kind: attempts and rejected attempts of each key and window, final once the
    watermark (``lateness`` behind the newest attempt) has passed the window. Later attempts of it are dropped."""
    a = access.where(F.col("kind") == lim.kind).withWatermark("ts", lateness)
    n = a.groupBy(F.window("ts", f"{lim.seconds} seconds").alias("w"), "source_key", "kind").agg(F.count(F.lit(1)).alias("attempts"))
    return n.select("source_key", "kind", F.col("w.start").alias("window_start"), "attempts", F.greatest(F.col("attempts") - lim.limit, F.lit(0)).alias("rejected"))


def rejections(access: DataFrame, limits: list[Limit] = LIMITS, id_col: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """Streaming twin: every rejected attempt, as soon as it arrives, with Spark's keyed state.

    Windows hold few attempts, so a state covers a key's windows of ``SPAN_WINDOWS`` in a row: the number of attempts that each has accepted. A window leaves it, and the
    state goes, when the watermark has passed. Attempts count in the order in which
    they arrive (within a micro-batch by time and id), so a stream that arrives in order rejects what ``over_limit`` does. An attempt behind the watermark is dropped.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    seconds = {lim.kind: lim.seconds for lim in limits}
    a = _windows(access.withColumn("ts", F.col("ts").cast("timestamp_ntz")), limits).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    span = F.floor(F.col("_us") / (F.col("_width") * SPAN_WINDOWS)).alias("span")
    a = a.select("source_key", "kind", "window_start", "ts", id_col, "limit", "at", span)

    def decide(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        width, mark = seconds[key[1]] * 1_000_000, state.getCurrentWatermarkMs() * 1000
        # a span's attempts of one micro-batch
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["window_start", "ts", id_col], kind="stable", ignore_index=True)
        starts, first, size = np.unique(rows["window_start"].to_numpy("datetime64[us]").astype("int64"), return_index=True, return_counts=True)
        used = {int(w): int(n) for w, n in zip(*state.get, strict=True)} if state.exists else {}
        before = np.array([used.get(w, 0) for w in starts.tolist()])
        free = np.maximum(int(rows["limit"].iloc[0]) - before, 0)
        used.update(zip(starts.tolist(), (before + np.minimum(free, size)).tolist(), strict=True))
        used = {w: n for w, n in used.items() if w + width > mark}
        state.update((list(used), list(used.values())))
        end = (int(key[2]) + 1) * SPAN_WINDOWS * width // 1000
        if state.getCurrentWatermarkMs() < end:
            state.setTimeoutTimestamp(end)
        nth = np.arange(len(rows)) - np.repeat(first, size)
        over = nth >= np.repeat(free, size)
        if over.any():
            yield rows.loc[over, ["source_key", "kind", "window_start", "ts", id_col, "limit"]]

    out = f"source_key string, kind string, window_start timestamp_ntz, ts timestamp_ntz, {id_col} long, limit int"
    return a.groupBy("source_key", "kind", "span").applyInPandasWithState(decide, out, "starts array<long>, used array<int>", "append", GroupStateTimeout.EventTimeTimeout)
