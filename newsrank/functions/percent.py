"""The largest percent move a title speaks of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D


def percent_marks(text: Column) -> Column:
    """Every percent in the text as (value, start, stop), with zero-based character positions."""
    part = lambda k: F.regexp_extract_all(text, F.lit(D.PERCENT), F.lit(k))
    found = F.arrays_zip(part(0).alias("mark"), part(1).alias("value"), F.split(text, D.PERCENT, -1).alias("before"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<value:double,start:int,stop:int>>").alias("out"))

    def walk(acc: Column, m: Column) -> Column:
        begin = acc["pos"] + F.length(m["before"])
        stop = begin + F.length(m["mark"])
        entry = F.struct(m["value"].try_cast("double").alias("value"), begin.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.aggregate(F.filter(found, lambda m: m["mark"].isNotNull()), start, walk, lambda acc: acc["out"])


def _before(text: Column, start: Column, width: int) -> Column:
    left = F.greatest(F.lit(0), start - width)
    return F.substring(text, left + 1, start - left)


def _after(text: Column, stop: Column, width: int) -> Column:
    return F.substring(text, stop + 1, F.lit(width))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-/]*"), F.lit(0))


def _is_move(text: Column, m: Column) -> Column:
    start, stop = m["start"], m["stop"]
    near = F.concat(_before(text, start, 12), F.substring(text, start + 1, stop - start), _after(text, stop, 12))
    before, after = _words(_before(text, start, 40)), _words(_after(text, stop, 40))
    last_three = F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - 2), F.lit(3)), " ")
    first_three = F.array_join(F.slice(after, 1, 3), " ")
    excluded = (
        _before(text, start, 8).rlike(D.NOT_A_MOVE) | _after(text, stop, 6).rlike(D.NOT_A_MOVE)
        | last_three.rlike(D.NOT_A_MOVE) | first_three.rlike(D.NOT_A_MOVE)
        | _before(text, start, 9).rlike(r"\d{4}年"))
    return (m["value"] > 0) & (m["value"] <= 100) & near.rlike(D.MOVE_WORDS) & ~excluded


def percent_move(text: Column) -> Column:
    """Largest percent in (0, 100] that reads as a price move; null when there is none."""
    t = F.coalesce(text, F.lit(""))
    kept = F.filter(percent_marks(t), lambda m: _is_move(t, m))
    return F.when(F.contains(t, F.lit("%")), F.array_max(F.transform(kept, lambda m: m["value"])))


def joined(*parts: Column) -> Column:
    """Non-blank parts joined by a blank."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def title_move(title_zh: Column, title_en: Column, description: Column) -> Column:
    """Titles decide alone when they carry any percent; else the short description counts too."""
    titles = joined(title_zh, title_en)
    return F.when(titles.rlike(D.PERCENT), percent_move(titles)).otherwise(
        percent_move(joined(title_zh, title_en, description)))
