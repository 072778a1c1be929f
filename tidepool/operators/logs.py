"""Log analytics over container log lines: label/level/text/time predicates, flattening, newest lines.

Every predicate is a plain DataFrame filter, so on parquet log stores Catalyst pushes
label and time predicates into the scan (and partition pruning on ``log_date`` when the
caller passes the time range, see ``streaming.logs.read_log_store``). The same functions
apply unchanged to streaming DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The level-extraction pattern over the console layout
# '%d{yyyy-MM-dd HH:mm:ss,SSS} %-5level %logger{60} - %msg%n', its timestamp format,
# the query cap of the viewer, and its look-back.
LEVEL_PATTERN = r"^\S+\s+\S+\s+([A-Z]+)\s+\S+\s+-\s+"
LINE_TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
QUERY_LIMIT = 2000
LOOKBACK_NS = 5 * 60 * 1_000_000_000


@dataclass
class LogQuery:
    app: str
    component: str | None = None
    levels: list[str] = field(default_factory=list)
    search: str | None = None
    start_ns: int | None = None
    end_ns: int | None = None
    limit: int | None = None


def level_of(line: Column) -> Column:
    """Level label parsed from a line, NULL when the line does not match (e.g. a stack trace)."""
    return F.nullif(F.regexp_extract(line, LEVEL_PATTERN, 1), F.lit(""))


def event_time_of(line: Column) -> Column:
    """Wall-clock time printed at the start of a line (TIMESTAMP_NTZ), NULL when absent."""
    return F.try_to_timestamp(F.substring(line, 1, 23), F.lit(LINE_TS_FORMAT)).cast("timestamp_ntz")


def extract_level(df: DataFrame, line: str = "line") -> DataFrame:
    return df.withColumn("level", level_of(F.col(line))).withColumn("event_time", event_time_of(F.col(line)))


def label_filter(df: DataFrame, app: str, component: str | None = None) -> DataFrame:
    cond = F.col("app") == F.lit(app)
    if component:
        cond = cond & (F.col("component") == F.lit(component))
    return df.where(cond)


def level_filter(df: DataFrame, levels: list[str] | None) -> DataFrame:
    """Keep lines whose level is one of ``levels`` (case-insensitive); lines without a level drop out."""
    if not levels:
        return df
    if "level" not in df.columns:
        df = df.withColumn("level", level_of(F.col("line")))
    return df.where(F.col("level").isin([lv.upper() for lv in levels]))


def contains_text(df: DataFrame, text: str | None) -> DataFrame:
    """Case-sensitive literal substring; the text is a value, never a pattern."""
    if not text:
        return df
    return df.where(F.col("line").contains(F.lit(text)))


def search_ci(df: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive substring search (the viewer's client-side filter)."""
    if not text:
        return df
    return df.where(F.lower(F.col("line")).contains(F.lit(text.lower())))


def time_range(df: DataFrame, start_ns: int | None, end_ns: int | None) -> DataFrame:
    """start <= ts_ns < end (end exclusive)."""
    if start_ns is not None:
        df = df.where(F.col("ts_ns") >= F.lit(start_ns))
    if end_ns is not None:
        df = df.where(F.col("ts_ns") < F.lit(end_ns))
    return df


def default_range(now_ns: int) -> tuple[int, int]:
    """The tail's back-fill window: the five minutes before ``now``."""
    return now_ns - LOOKBACK_NS, now_ns


def flatten_streams(streams: DataFrame) -> DataFrame:
    """Log-store result shape (label map + [ts, line] pairs) -> one row per line, ts in ms."""
    e = streams.select("stream", F.explode("values").alias("v"))
    ts_ns = F.element_at("v", 1).cast("long")
    return e.select(
        F.col("stream").getItem("app").alias("app"),
        F.col("stream").getItem("component").alias("component"),
        F.col("stream").getItem("namespace").alias("namespace"),
        F.col("stream").getItem("pod").alias("pod"),
        ts_ns.alias("ts_ns"),
        (ts_ns / F.lit(1e6)).alias("ts_ms"),
        F.element_at("v", 2).alias("line"),
    )


def apply_predicates(df: DataFrame, q: LogQuery) -> DataFrame:
    """Label, level, text and time predicates of a query (no ordering, no cap): usable on streams."""
    df = label_filter(df, q.app, q.component)
    df = time_range(df, q.start_ns, q.end_ns)
    df = contains_text(df, q.search)
    df = df.withColumn("level", level_of(F.col("line")))
    return level_filter(df, q.levels)


def log_query(df: DataFrame, q: LogQuery) -> DataFrame:
    """Oldest first, at most ``q.limit`` lines if a limit is given. Ties on time are broken by (pod, line)."""
    out = apply_predicates(df, q).orderBy("ts_ns", "pod", "line")
    return out if q.limit is None else out.limit(q.limit)


def newest_n(df: DataFrame, keys: list[str], n: int, order: list[str] = ["ts_ns", "pod", "line"], bucket_ns: int = 3600 * 10**9) -> DataFrame:  # noqa: B006
    """Per ``keys``, the ``n`` newest rows by ``order`` (its first column in nanoseconds), numbered from the newest.

    Rows are first counted by key and time bucket (combined map-side); running sums from the newest bucket give each
    key the bucket in which its n-th row lies, and only rows from there on are ranked. A hot key thus
    brings no more than n rows and one bucket to its task. Rows without a time come last, in a bucket of their own.
    """
    bucket = F.coalesce(F.floor(F.col(order[0]) / bucket_ns), F.lit(-(1 << 62))).cast("long")
    counts = df.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_newer", newer).where(F.col("_newer") < n)
    cut = wanted.groupBy(*keys).agg(F.min("_b").alias("_from")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_from")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    recent = df.withColumn("_b", bucket).join(cut, same).where("_b >= _from").drop("_b", "_from", *[f"_{k}" for k in keys])
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return recent.withColumn("rank_from_newest", F.row_number().over(w)).where(F.col("rank_from_newest") <= n)


def parse_json_log(df: DataFrame, value: str = "value") -> DataFrame:
    """Compact JSON layout (one event per line, epoch millis) -> the common log columns."""
    from ..sources import schemas as S

    r = F.from_json(F.col(value), S.JSON_LOG_DDL, {"mode": "PERMISSIVE"})
    p = df.select("*", r.alias("j"))
    return p.select(
        *[c for c in df.columns if c != value],
        (F.col("j.timeMillis") * F.lit(1_000_000)).alias("ts_ns"),
        F.col("j.level").alias("level"),
        F.col("j.loggerName").alias("logger"),
        F.col("j.thread").alias("thread"),
        F.col("j.message").alias("line"),
    )
