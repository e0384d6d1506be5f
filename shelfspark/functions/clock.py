"""Freshness windows, opening hours and age labels."""

from __future__ import annotations

import datetime as dt
import math
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.text import col

DEFAULT_MAX_AGE_HOURS = 48
MIN_MAX_AGE_HOURS = 1
MAX_MAX_AGE_HOURS = 24 * 14
DEFAULT_TIMEZONE = "Europe/Chisinau"


def _number(raw) -> float | None:
    try:
        value = float(raw)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def max_age_hours(raw=None) -> float:
    value = _number(DEFAULT_MAX_AGE_HOURS if raw is None else raw)
    if value is None:
        return DEFAULT_MAX_AGE_HOURS
    return min(MAX_MAX_AGE_HOURS, max(MIN_MAX_AGE_HOURS, value))


def grace_hours(raw=None) -> float:
    value = _number(0 if raw is None else raw)
    return 0 if value is None or value < 0 else min(MAX_MAX_AGE_HOURS, value)


def as_instant(moment) -> dt.datetime:
    return dt.datetime.fromisoformat(moment) if isinstance(moment, str) else moment


def literal_ntz(moment) -> Column:
    return F.lit(as_instant(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def fresh_since(as_of, raw_hours=None) -> Column:
    """Literal cutoff, so the comparison with a stored column is pushed to the scan."""
    return literal_ntz(as_instant(as_of) - dt.timedelta(hours=max_age_hours(raw_hours)))


def is_fresh(last_seen, as_of, raw_hours=None) -> Column:
    return col(last_seen) >= fresh_since(as_of, raw_hours)


def freshness_state(last_seen, as_of, raw_hours=None) -> Column:
    return F.when(is_fresh(last_seen, as_of, raw_hours), "FRESH").otherwise("STALE")


def reconcile_cutoff(started_at, raw_hours=None) -> Column:
    return literal_ntz(as_instant(started_at) - dt.timedelta(hours=grace_hours(raw_hours)))


def age_label(moment, as_of) -> Column:
    seconds = F.unix_micros(literal_ntz(as_of).cast("timestamp")) - F.unix_micros(col(moment).cast("timestamp"))
    minutes = F.greatest(F.floor(seconds / 60_000_000 + 0.5), F.lit(0))
    hours = F.floor(minutes / 60 + 0.5)
    return (
        F.when(col(moment).isNull(), "never")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(hours / 24 + 0.5).cast("string"), F.lit("d")))
    )


OPEN_TIME = r"^(?:[01]\d|2[0-3]):[0-5]\d$"
CLOSE_TIME = r"^(?:(?:[01]\d|2[0-3]):[0-5]\d|24:00)$"


def _minutes(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.lit(2)).cast("int") * 60 + F.substr(text, F.lit(4), F.lit(2)).cast("int")


def valid_store_hours(hours) -> Column:
    """Schema test of a weekly schedule or an online-only marker."""
    h = col(hours)
    kind = h["kind"]
    periods = F.map_values(F.map_filter(h["weekly"], lambda day, _: day.isin(*rules.WEEKDAYS)))
    valid = F.forall(periods, lambda day: day.isNull() | F.forall(
        day, lambda p: F.coalesce(p["open"].rlike(OPEN_TIME) & p["close"].rlike(CLOSE_TIME), F.lit(False))))
    schedule = (kind.isNull() | (kind == "schedule")) & h["weekly"].isNotNull() & valid
    return F.coalesce((h["version"] == 1) & ((kind == "online_only") | schedule), F.lit(False))


def _contains(period: Column, minute: Column, carried: bool) -> Column:
    start, end = _minutes(period["open"]), _minutes(period["close"])
    overnight = minute < end if carried else minute >= start
    same_day = F.lit(False) if carried else (minute >= start) & (minute < end)
    return F.when(start == end, start == 0).when(end > start, same_day).otherwise(overnight)


def open_state(hours, at, locale: str = "ru") -> Column:
    """Struct(state, today) of a schedule at an instant, in the schedule's own time zone."""
    h = col(hours)
    zone = F.coalesce(F.nullif(h["timezone"], F.lit("")), F.lit(DEFAULT_TIMEZONE))
    known = zone.isin(*sorted(available_timezones()))
    local = F.from_utc_timestamp(col(at).cast("timestamp"), F.when(known, zone).otherwise("UTC"))
    minute = F.hour(local) * 60 + F.minute(local)
    days = F.array(*map(F.lit, rules.WEEKDAYS))
    today = F.try_element_at(h["weekly"], F.get(days, F.weekday(local)))
    yesterday = F.try_element_at(h["weekly"], F.get(days, F.pmod(F.weekday(local) + 6, F.lit(7))))
    is_open = (F.exists(today, lambda p: _contains(p, minute, False))
               | F.exists(yesterday, lambda p: _contains(p, minute, True)))
    closed_word = rules.STOCK_LABELS[locale]["closed"]
    text = (
        F.when(F.size(today) == 0, closed_word)
        .when(F.exists(today, lambda p: (p["open"] == p["close"]) & (p["open"] == "00:00")), "24/7")
        .otherwise(F.array_join(F.transform(today, lambda p: F.concat(p["open"], F.lit("–"), p["close"])), ", "))
    )

    def answer(state, day_text=None):
        shown = F.lit(None).cast("string") if day_text is None else day_text
        return F.struct((F.lit(state) if isinstance(state, str) else state).alias("state"), shown.alias("today"))

    return (
        F.when(~valid_store_hours(h), answer("unknown"))
        .when(h["kind"] == "online_only", answer("online_only"))
        .when(F.coalesce(h["temporarilyClosed"], F.lit(False)), answer("temporarily_closed"))
        .when(~known | today.isNull() | yesterday.isNull(), answer("unknown"))
        .otherwise(answer(F.when(is_open, "open").otherwise("closed"), text))
    )
