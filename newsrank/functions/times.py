"""Clock columns: ISO text to instants, wall time in the project zone, hour differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_OFFSET_HOURS = 8

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_OFFSET = r"[T ].*(Z|[+-]\d{2}:?\d{2})$"


def strip(col: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def iso_micros(text: Column) -> Column:
    """ISO-8601 text to micros since 1970 UTC; text without an offset is UTC, bad text is null."""
    s = F.trim(text)
    with_zone = (
        F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z")))
        .when(s.rlike(_OFFSET), s)
        .otherwise(F.concat(s, F.lit("Z")))
    )
    return F.when(s.rlike(_ISO), F.unix_micros(F.try_to_timestamp(with_zone)))


def has_offset(text: Column) -> Column:
    return F.trim(text).rlike(_OFFSET)


def micros_to_wall(micros: Column, offset_hours: int = 0) -> Column:
    """Micros to a zone-free timestamp, shifted by ``offset_hours``."""
    base = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.floor(micros / F.lit(1_000_000)) + F.lit(offset_hours * 3600), base)


def iso_wall(text: Column, offset_hours: int = 0) -> Column:
    return micros_to_wall(iso_micros(text), offset_hours)


def local_wall(text: Column) -> Column:
    """Offset text becomes UTC+8 wall time; text without an offset is taken as wall time already."""
    return F.when(has_offset(text), iso_wall(text, LOCAL_OFFSET_HOURS)).otherwise(iso_wall(text))


def wall_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later).cast("double")


def hours_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def wall(value) -> Column:
    """A fixed clock value (``2024-02-01 00:00:00``) or a column, as a zone-free timestamp."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")
