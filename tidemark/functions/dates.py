"""Times: lenient parsing, age, decay. `as_of` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def micros(t: Column) -> Column:
    """Microseconds of a timestamp with or without a zone (then that of the session)."""
    return F.unix_micros(t.cast("timestamp"))


def age_days(earlier: Column, later: Column) -> Column:
    """Fractional days, 0 at least."""
    return F.greatest(F.lit(0.0), (micros(later) - micros(earlier)) / 86_400_000_000.0)


def decay(posted: Column, as_of: Column, half_life_days: Column, missing: float = 0.75) -> Column:
    """0.5 to the power of age over half-life; `missing` for an unknown date."""
    aged = F.pow(F.lit(0.5), age_days(posted, as_of) / F.greatest(half_life_days, F.lit(1.0)))
    return F.when(posted.isNull(), F.lit(missing)).otherwise(aged)


def within_days(at: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(age_days(at, as_of) <= days, F.lit(False))


def freshness(*times: Column) -> Column:
    """The latest of several times in milliseconds; unknown ones count as 0."""
    return F.greatest(*[F.coalesce(F.unix_millis(t.cast("timestamp")), F.lit(0)) for t in times])


def latest(*texts: Column) -> Column:
    """The last of several times as text; null where none is one."""
    return F.greatest(*map(lenient, texts))


def spoken(label: Column, now: Column) -> Column:
    """A time out of a label: 5h ago, 3 days, Jun 3 (of the year of `now`), or a date."""
    t = F.trim(F.coalesce(label, F.lit("")))
    ago = r"(?i)^([0-9]+)\s*(m|h|d|minutes?|hours?|days?)\s*(?:ago)?$"
    n, unit = F.try_to_number(F.regexp_extract(t, ago, 1), F.lit("99999999")).cast("long"), F.lower(F.substring(F.regexp_extract(t, ago, 2), 1, 1))
    size = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86_400)
    before = F.timestamp_micros(micros(now) - n * size * 1_000_000)
    day = F.when(t.rlike(r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+[0-9]{1,2}$"), F.concat(F.initcap(t), F.lit(" "), F.year(now).cast("string")))
    return F.when(t.rlike(ago), before).when(day.isNotNull(), F.try_to_timestamp(F.regexp_replace(day, r"\s+", " "), F.lit("MMM d yyyy"))).otherwise(lenient(F.nullif(t, F.lit(""))))


def date_within(text: Column) -> Column:
    """The date that a text gives as posted or published (Posted: June 3, 2026), else its first of the form 2026-06-03; null where there is none."""
    told = F.regexp_extract(text, r"\b(?:Posted|Published|Date)\s*:?\s*([A-Z][a-z]{2,9}\s+[0-9]{1,2},\s+[0-9]{4})\b", 1)
    plain = F.regexp_extract(text, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1)
    spelled = F.coalesce(F.try_to_timestamp(told, F.lit("MMMM d, yyyy")), F.try_to_timestamp(told, F.lit("MMM d, yyyy")))
    return F.when(told != "", spelled).otherwise(lenient(F.nullif(plain, F.lit(""))))
