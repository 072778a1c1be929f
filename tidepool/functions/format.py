"""Column functions for artifact and state naming and size display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units (the display it follows has B to GB) and the object-name character rule.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
UNSAFE_OBJECT_CHARS = r"[^a-zA-Z0-9.\-_]"
STATE_PREFIX = "flink-"
STATE_NAME_CHARS = 57


def human_size(size_bytes: Column) -> Column:
    """'0 B', else the value in the largest unit below it, one decimal, trailing '.0' dropped.

    The unit is chosen by exact thresholds (no floating logarithm), and the decimal
    is rounded half-up on the exact quotient with integer arithmetic.
    """
    b = size_bytes.cast("long")
    unit_idx = F.lit(len(SIZE_UNITS) - 1)
    for i in range(len(SIZE_UNITS) - 2, -1, -1):
        unit_idx = F.when(b < 1024 ** (i + 1), i).otherwise(unit_idx)
    base = F.pow(F.lit(1024), unit_idx).cast("long")
    rest = b % base
    tenths = ((b - rest) / base).cast("long") * 10 + F.floor((rest * 10 + base / 2) / base).cast("long")  # half-up
    whole = (tenths / 10).cast("long")
    frac = tenths % 10
    number = F.when(frac == 0, whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit("."), frac.cast("string")))
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), unit_idx + 1)
    return F.when(b.isNull(), F.lit(None).cast("string")).when(b == 0, F.lit("0 B")).otherwise(F.concat(number, F.lit(" "), unit))


def safe_object_name(original_name: Column, prefix: Column) -> Column:
    """``<prefix>-<name>`` with every character outside [a-zA-Z0-9.-_] replaced by '_'."""
    return F.concat(prefix, F.lit("-"), F.regexp_replace(original_name, UNSAFE_OBJECT_CHARS, "_"))


def state_location(deployment_name: Column, prefix: str = STATE_PREFIX) -> Column:
    """Per-deployment state folder name: prefix + first 57 characters of the name (a fixed rule, see ``state_too_long``)."""
    return F.concat(F.lit(prefix), F.substring(deployment_name, 1, STATE_NAME_CHARS))


def state_too_long(deployment_name: Column) -> Column:
    """True for a name that does not fit its state folder, so that the folder does not name it alone."""
    return F.length(deployment_name) > STATE_NAME_CHARS


def artifact_url(object_name: Column, host: str, port: str, bucket: str) -> Column:
    return F.concat(F.lit(f"http://{host}:{port}/{bucket}/"), object_name)
