"""Dates and epoch milliseconds, always in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histloom import constants as K

DAY_MS = 86_400_000


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, read as UTC."""
    day = F.unix_date(ts.cast("date")).cast("long") * DAY_MS
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return day + seconds.cast("long") * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def millis_to_date(ms: Column) -> Column:
    """The UTC day of an epoch time in milliseconds."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def days_around(day: Column, days: int = K.WINDOW_DAYS) -> Column:
    """The days from `days` before to `days` after."""
    return F.sequence(F.date_sub(day, days), F.date_add(day, days))


def history_times(history: Column, heldout: Column) -> Column:
    """All times of a nested user record, the held-out one last."""
    return F.concat(F.transform(history, lambda r: r["timestamp_ms"]), F.array(heldout["timestamp_ms"]))
