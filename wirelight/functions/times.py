"""Timestamps of the log formats; everything becomes a UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName, as_column

_RFC3339 = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)\z"
_EVE = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?[+-]\d{4}\z"

# microseconds of 0001-01-03 and 9999-12-30, so that a time zone makes no difference
_FOUR_DIGITS = (-62135424000000000, 253402128000000000)


def zeek_epoch(text: ColumnOrName, fraction: str = "decimal") -> Column:
    """``seconds.fraction`` -> timestamp; NULL unless there is exactly one dot.

    ``fraction='nanoseconds'`` reads the digits after the dot as a count of
    nanoseconds, whatever their number, the way the original tool does.
    """
    text = as_column(text)
    valid = text.rlike(r"\A[+-]?\d{1,12}\.[+-]?\d+\z")
    whole, part = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    seconds = whole.try_cast("bigint")
    if fraction == "nanoseconds":
        micros = seconds * 1000000 + F.floor(part.try_cast("bigint") / 1000).cast("bigint")
    elif fraction == "decimal":
        digits = F.rpad(F.substring(part, 1, 6), 6, "0").try_cast("bigint")
        micros = seconds * 1000000 + F.when(whole.startswith("-"), -digits).otherwise(digits)
    else:
        raise ValueError("fraction must be 'decimal' or 'nanoseconds'")
    return F.when(valid, F.timestamp_micros(micros))


def rfc3339(text: ColumnOrName) -> Column:
    text = as_column(text)
    return F.when(text.rlike(_RFC3339), text.try_cast("timestamp"))


def eve_ts(text: ColumnOrName) -> Column:
    """ISO date and time with a numeric offset without colon."""
    text = as_column(text)
    spelled = F.regexp_replace(F.translate(text, ",", "."), r"([+-]\d\d)(\d\d)\z", "$1:$2")
    return F.when(text.rlike(_EVE), spelled.try_cast("timestamp"))


# Layouts by date separator and 12-hour mark.
_MSDNS_LAYOUTS = {
    ("-", True): "yyyy-MM-dd h:mm:ss a",
    ("/", True): "yyyy/MM/dd h:mm:ss a",
    ("-", False): "yyyy-MM-dd H:mm:ss",
    ("/", False): "yyyy/MM/dd H:mm:ss",
}


def msdns_ts(text: ColumnOrName, layout: str | None = None, zone: str = "UTC") -> Column:
    """Server-local date and time, layout guessed from its shape unless given."""
    text = as_column(text)
    if layout is not None:
        local = F.try_to_timestamp(text, F.lit(layout))
    else:
        separator = F.substring(text, 5, 1)
        local = F.lit(None).cast("timestamp")
        for (mark, half_day), pattern in _MSDNS_LAYOUTS.items():
            fits = (separator == mark) & (text.endswith("M") == F.lit(half_day)) & (F.length(text) >= 10)
            local = F.when(fits, F.try_to_timestamp(text, F.lit(pattern))).otherwise(local)
    return local if zone == "UTC" else F.to_utc_timestamp(local, zone)


def epoch_ms(millis: ColumnOrName) -> Column:
    millis = as_column(millis)
    return F.when(millis > 0, F.timestamp_millis(millis))


def clamp_cursor(cursor: ColumnOrName, now: Column, max_age: str = "24 HOURS") -> Column:
    """Saved cursor text -> timestamp no older than ``max_age`` before ``now``.

    No saved text (NULL) stays NULL; text that is no timestamp counts as oldest.
    """
    text = as_column(cursor)
    oldest = now - F.expr(f"INTERVAL {max_age}")
    return F.when(text.isNotNull(), F.greatest(F.coalesce(rfc3339(text), oldest), oldest))


def wire_time(ts: ColumnOrName) -> Column:
    """RFC 3339 text in UTC without trailing zeros in the fraction."""
    ts = as_column(ts).cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    pattern = F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))
    # as text a time has no such zeros either; years of other than four digits are spelled otherwise
    plain = F.concat(F.translate(ts.cast("string"), " ", "T"), F.lit("Z"))
    return F.when(F.unix_micros(ts).between(*_FOUR_DIGITS), plain).otherwise(pattern)
