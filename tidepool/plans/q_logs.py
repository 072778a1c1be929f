"""Queries of log analytics."""

from __future__ import annotations

from ..operators import logs as L
from ..sources import logs as LS
from . import query
from .oracle import register

# Query parameters (a fixed request, as a user would send it).
APP = "job-7"
COMPONENT = "taskmanager"
LEVELS = ["warn", "error"]
SEARCH = '"k": 4'  # quotes are literal text
SEARCH_CI = "DID PURCHASE"
START_NS = 1704240000 * 10**9  # 2024-01-03T00:00:00Z
END_NS = 1705708800 * 10**9  # 2024-01-20T00:00:00Z

LEVEL_SQL = r"NULLIF(regexp_extract(line, '^\S+\s+\S+\s+([A-Z]+)\s+\S+\s+-\s+', 1), '')"
LOG_COLS = "app, component, namespace, pod, ts_ns, line"


@query("log_label_filter")
def log_label_filter(spark, sf):
    return L.label_filter(LS.log_lines(spark, sf), APP, COMPONENT)


register("log_label_filter", f"SELECT {LOG_COLS} FROM v_logs WHERE app = '{APP}' AND component = '{COMPONENT}'")


@query("log_level_extract")
def log_level_extract(spark, sf):
    return L.extract_level(LS.log_lines(spark, sf))


register(
    "log_level_extract",
    f"SELECT {LOG_COLS}, {LEVEL_SQL} AS level, "
    "try_strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S,%g') AS event_time FROM v_logs",
)


@query("log_level_filter")
def log_level_filter(spark, sf):
    return L.level_filter(LS.log_lines(spark, sf), LEVELS)


register("log_level_filter", f"SELECT {LOG_COLS}, {LEVEL_SQL} AS level FROM v_logs WHERE {LEVEL_SQL} IN ('WARN', 'ERROR')")


@query("log_contains")
def log_contains(spark, sf):
    return L.contains_text(LS.log_lines(spark, sf), SEARCH)


register("log_contains", f"SELECT {LOG_COLS} FROM v_logs WHERE position('\"k\": 4' IN line) > 0")


@query("log_time_range")
def log_time_range(spark, sf):
    return L.time_range(LS.log_lines(spark, sf), START_NS, END_NS)


register("log_time_range", f"SELECT {LOG_COLS} FROM v_logs WHERE ts_ns >= {START_NS} AND ts_ns < {END_NS}")


@query("log_flatten")
def log_flatten(spark, sf):
    return L.flatten_streams(LS.log_streams(spark, sf))


register("log_flatten", f"SELECT {LOG_COLS}, ts_ns / 1e6 AS ts_ms FROM v_logs")


QUERY = L.LogQuery(app=APP, levels=["warn", "error", "info"], search="did", start_ns=START_NS, end_ns=END_NS,
                   limit=L.QUERY_LIMIT)


@query("log_query")
def log_query(spark, sf):
    """Label + level + text + time predicates, oldest first, at most 2000 lines."""
    return L.log_query(LS.log_lines(spark, sf), QUERY)


register(
    "log_query",
    f"SELECT {LOG_COLS}, {LEVEL_SQL} AS level FROM v_logs WHERE app = '{APP}' AND ts_ns >= {START_NS} AND ts_ns < {END_NS} "
    f"AND position('did' IN line) > 0 AND {LEVEL_SQL} IN ('WARN', 'ERROR', 'INFO') ORDER BY ts_ns, pod, line LIMIT 2000",
)


@query("log_search_ci")
def log_search_ci(spark, sf):
    return L.search_ci(LS.log_lines(spark, sf), SEARCH_CI)


register("log_search_ci", f"SELECT {LOG_COLS} FROM v_logs WHERE contains(lower(line), lower('{SEARCH_CI}'))")


LAST_N = 400


@query("log_last_n")
def log_last_n(spark, sf):
    """The 400 newest lines of every (app, component), as a viewer with a buffer of 400 asks for them."""
    return L.newest_n(LS.log_lines(spark, sf), ["app", "component"], LAST_N)


register(
    "log_last_n",
    f"""SELECT {LOG_COLS}, rank_from_newest FROM (
      SELECT *, row_number() OVER (PARTITION BY app, component ORDER BY ts_ns DESC, pod DESC, line DESC) AS rank_from_newest
      FROM v_logs) t
    WHERE rank_from_newest <= {LAST_N}""",
)


@query("json_log_source")
def json_log_source(spark, sf):
    return L.parse_json_log(LS.json_log_values(spark, sf))


register(
    "json_log_source",
    "SELECT app, component, namespace, pod, time_millis * 1000000 AS ts_ns, level, logger_name AS logger, thread, "
    "message AS line FROM v_json_logs",
)
