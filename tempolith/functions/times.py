"""Times as seconds from the start, and their written forms. All are column expressions.

TIM-01 to TIM-14. Truncating and rounding formatters differ on purpose: 3599.9 s is 00:59:59 in one and
01:00:00 in the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(text: Column) -> Column:
    """``H:M:S`` or ``M:S`` to seconds; null if a part isn't a number."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long"))


def strict_seconds_of(text: Column) -> Column:
    """As ``seconds_of``, but a text of another form fails the query."""
    form = text.rlike(r"^\d{1,3}(:[0-5]?\d){1,2}$")
    return F.when(text.isNull() | form, seconds_of(text)).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)))


def _parts(whole: Column) -> tuple[Column, Column, Column]:
    return (F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def hms(seconds: Column) -> Column:
    """``HH:MM:SS``, truncating, never below zero."""
    return F.format_string("%02d:%02d:%02d", *_parts(F.greatest(F.floor(seconds), F.lit(0).cast("long"))))


def hms_rounded(seconds: Column) -> Column:
    """``HH:MM:SS`` of the nearest second, halves to the even one."""
    return F.format_string("%02d:%02d:%02d", *_parts(F.greatest(F.bround(seconds).cast("long"), F.lit(0).cast("long"))))


def mmss(seconds: Column, *, pad_hour: bool = True) -> Column:
    """``MM:SS`` below an hour, else with hours (two digits, or as many as there are)."""
    h, m, s = _parts(F.greatest(F.floor(seconds), F.lit(0).cast("long")))
    return F.when(h == 0, F.format_string("%02d:%02d", m, s)).otherwise(F.format_string("%02d:%02d:%02d" if pad_hour else "%d:%02d:%02d", h, m, s))


def from_parts(h: Column, m: Column, s: Column, ms: Column) -> Column:
    """Seconds from the parts of a time code; milliseconds are padded on the right to three digits."""
    whole = [F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in (h, m, s)]
    return whole[0] * 3600 + whole[1] * 60 + whole[2] + F.rpad(F.coalesce(ms, F.lit("0")), 3, "0").cast("double") / 1000


def section_offset(section: Column) -> Column:
    """The start of a clip's section text such as ``*00:10:00-00:20:00``, else 0."""
    start = F.regexp_extract(section, r"(\d{1,3}(?::\d{1,2}){1,2})\s*-", 1)
    return F.when(F.length(start) > 0, seconds_of(start)).otherwise(F.lit(0).cast("long"))


def to_timeline(offset: Column, clip: Column) -> Column:
    """Clip time on the original's clock."""
    return offset + seconds_of(clip)


def date_of(epoch: Column) -> Column:
    """Epoch seconds as a date in the session's time zone; null for null or non-positive."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))
