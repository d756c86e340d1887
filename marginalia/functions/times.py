"""Time stamps as text.  All work on epoch milliseconds and do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000


def iso_text(epoch_millis: Column, millis: bool = True) -> Column:
    """``2022-08-22'T'19:00:00.0123``: the quotes and the four digits for milliseconds belong to the format."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch_millis / _DAY).cast("int"))
    in_day = F.pmod(epoch_millis, F.lit(_DAY))
    text = F.format_string(
        "%04d-%02d-%02d'T'%02d:%02d:%02d",
        F.year(date),
        F.month(date),
        F.day(date),
        F.floor(in_day / 3_600_000),
        F.floor(in_day / 60_000) % 60,
        F.floor(in_day / 1000) % 60,
    )
    return F.concat(text, F.format_string(".%04d", in_day % 1000)) if millis else text


def run_id(epoch_millis: Column) -> Column:
    """``2022-08-22T19-00-00_0123``."""
    # What the name of a run must not contain, and what stands in its place.
    text = iso_text(epoch_millis)
    for char, stand_in in (("'", ""), (":", "-"), (".", "_")):
        text = F.replace(text, F.lit(char), F.lit(stand_in))
    return text


def utc_offset_millis(ts: Column, zone: str | Column) -> Column:
    """How far the wall clock of ``zone`` is ahead of UTC at an instant."""
    return F.unix_millis(F.from_utc_timestamp(ts, zone)) - F.unix_millis(ts)


def local_millis(ts: Column, zone: str | Column) -> Column:
    """The wall clock time of ``zone``, read as if it were UTC."""
    return F.unix_millis(ts) + utc_offset_millis(ts, zone)


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def local_now_millis() -> Column:
    """Wall clock time of the session's zone, read as if it were UTC."""
    return local_millis(F.current_timestamp(), F.current_timezone())
