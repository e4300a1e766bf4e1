"""RFC 3339 text: validity by shape, instants as (seconds, nanoseconds), calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"


def valid(ts: Column) -> Column:
    """Shape only: a thirtieth of February has a valid shape."""
    return ts.rlike(SHAPE)


def _part(ts: Column, at: int, n: int) -> Column:
    return F.try_to_number(F.substring(ts, at, n), F.lit("9" * n)).cast("long")


def instant(ts: Column) -> Column:
    """``struct(secs, nanos)``; null for impossible dates, leap seconds and more than nine significant decimals."""
    fraction = F.regexp_replace(F.regexp_extract(ts, r"\.([0-9]+)", 1), r"0+\z", "")
    days = F.unix_date(F.try_to_date(F.substring(ts, 1, 10), "yyyy-MM-dd")).cast("long")
    offset = F.regexp_extract(ts, r"([+-])([0-9]{2}):([0-9]{2})\z", 1)
    minutes = F.when(offset == "", F.lit(0).cast("long")).otherwise(F.regexp_extract(ts, r"([0-9]{2}):([0-9]{2})\z", 1).try_cast("long") * 60 + F.regexp_extract(ts, r"([0-9]{2}):([0-9]{2})\z", 2).try_cast("long"))
    shift = F.when(offset == "-", -minutes).otherwise(minutes)
    secs = days * 86400 + F.substring(ts, 12, 2).try_cast("long") * 3600 + F.substring(ts, 15, 2).try_cast("long") * 60 + F.substring(ts, 18, 2).try_cast("long") - shift * 60
    good = valid(ts) & days.isNotNull() & (F.substring(ts, 18, 2) != "60") & (F.length(fraction) <= 9)
    return F.when(good, F.struct(secs.alias("secs"), F.rpad(fraction, 9, "0").try_cast("int").alias("nanos")))


def utc_text(unix_secs: Column) -> Column:
    """The UTC date and time; years after 9999 take as many digits as they need, for which RFC 3339 has no room."""
    t = F.timestamp_seconds(unix_secs)
    return F.concat(F.format_string("%04d", F.year(t)), F.date_format(t, "-MM-dd'T'HH:mm:ss'Z'"))


def rfc3339_utc(unix_secs: Column) -> Column:
    """Null where the year has no four digits."""
    text = utc_text(unix_secs)
    return F.when(valid(text), text)


def civil_from_days(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    return F.unix_date(F.make_date(year, month, day))


def time_of_day(ts: Column) -> Column:
    """``HH:MM:SSZ`` of a fixed-width UTC text, else the whole text."""
    return F.when(F.length(ts) >= 20, F.substring(ts, 12, 9)).otherwise(ts)


def precedes_bound(effective_at: Column, observed_at: Column, history_start: Column) -> Column:
    """Whether a record lies at or after the start of history; what can't be ordered does not."""
    return F.coalesce(instant(F.coalesce(effective_at, observed_at)) >= instant(history_start), F.lit(False))
