"""Date and time functions with modifiers, on TIMESTAMP_NTZ columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import month_add, weekday_on

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def _later(ts: Column, seconds: float) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def _months_on(ts: Column, months: int, mode: str) -> Column:
    return month_add(F.to_date(ts), months, mode).cast("timestamp_ntz") + (ts - _midnight(ts))


def modified(ts: Column, *modifiers: str) -> Column:
    """Apply modifiers from left to right.

    `N seconds|minutes|hours|days|months|years`, `+HH:MM[:SS]`, `start of
    day|month|year`, `weekday N`; `floor` or `ceiling` right after months or
    years say what becomes of a day that the month lacks (default: it rolls over).
    """
    for i, modifier in enumerate(modifiers):
        after = modifiers[i + 1] if i + 1 < len(modifiers) else ""
        if m := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day)s?", modifier):
            ts = _later(ts, float(m[1]) * UNITS[m[2]])
        elif m := re.fullmatch(r"([+-]?\d+) (month|year)s?", modifier):
            months = int(m[1]) * (12 if m[2] == "year" else 1)
            if after == "ceiling":
                floor = _months_on(ts, months, "floor")
                ts = F.when(F.dayofmonth(floor) < F.dayofmonth(ts), F.date_add(F.last_day(floor), 1).cast("timestamp_ntz") + (ts - _midnight(ts))).otherwise(floor)
            else:
                ts = _months_on(ts, months, "floor" if after == "floor" else "roll")
        elif m := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", modifier):
            ts = _later(ts, (int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4] or 0)) * (-1 if m[1] == "-" else 1))
        elif modifier == "start of day":
            ts = _midnight(ts)
        elif modifier in ("start of month", "start of year"):
            ts = F.trunc(F.to_date(ts), modifier[9:]).cast("timestamp_ntz")
        elif m := re.fullmatch(r"weekday ([0-6])", modifier):
            ts = weekday_on(F.to_date(ts), int(m[1])).cast("timestamp_ntz") + (ts - _midnight(ts))
        elif modifier not in ("floor", "ceiling"):
            raise ValueError(f"modifier {modifier!r} is not supported")
    return ts


def date(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modified(ts, *modifiers), "yyyy-MM-dd")


def time(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modified(ts, *modifiers), "HH:mm:ss")


def datetime(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modified(ts, *modifiers), "yyyy-MM-dd HH:mm:ss")


def micros(ts: Column) -> Column:
    """Microseconds since 1970, read as UTC."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    within = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * 86_400_000_000 + within


def get(ts: Column, field: str) -> Column:
    """A field as a number: year to second, millennium, century and decade (plain quotients), quarter, week, isoyear, dow, isodow, doy, epoch."""
    year = F.year(ts)
    return {
        "millennium": lambda: F.floor(year / 1000), "century": lambda: F.floor(year / 100), "decade": lambda: F.floor(year / 10),
        "year": lambda: year, "quarter": lambda: F.quarter(ts), "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts), "minute": lambda: F.minute(ts), "second": lambda: F.second(ts),
        "week": lambda: F.weekofyear(ts), "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: F.weekday(ts) + 1, "doy": lambda: F.dayofyear(ts),
        "epoch": lambda: F.floor(micros(ts) / 1_000_000),
    }[field]().cast("long")


def truncated(ts: Column, micros_each: int) -> Column:
    """The last multiple of a duration at or before a time, as microseconds."""
    m = micros(ts)
    return m - F.pmod(m, F.lit(micros_each))


def rounded(ts: Column, micros_each: int) -> Column:
    """The nearest multiple of a duration, as microseconds; halves go up."""
    m = micros(ts) + micros_each // 2
    return m - F.pmod(m, F.lit(micros_each))


def timediff(a: Column, b: Column) -> Column:
    """What to add to b to get a, as +YYYY-MM-DD HH:MM:SS.SSS: whole months first, then days and time."""
    back = a < b
    months = F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))
    sign = F.when(back, -1).otherwise(1)

    def moved(n: Column) -> Column:
        day = F.to_date(b)
        floor = F.add_months(day, n * sign)
        return F.date_add(floor, F.dayofmonth(day) - F.dayofmonth(floor)).cast("timestamp_ntz") + (b - _midnight(b))

    over = F.when(back, moved(months) < a).otherwise(moved(months) > a)
    whole = F.when(over, months - 1).otherwise(months)
    rest = F.abs(micros(a) - micros(moved(whole)))
    days, ms = F.floor(rest / 86_400_000_000), F.floor((rest % 86_400_000_000) / 1000)
    part = lambda n, m: F.floor(ms / n) % m
    return F.format_string("%s%04d-%02d-%02d %02d:%02d:%02d.%03d", F.when(back, "-").otherwise("+"), F.floor(whole / 12), whole % 12, days, part(3_600_000, 24), part(60_000, 60), part(1000, 60), ms % 1000)


MINUTE = 60_000_000


def made(year: Column | int, month: Column | int, day: Column | int, hour: int = 0, minute: int = 0, second: float = 0) -> Column:
    """A time from its parts."""
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.make_timestamp_ntz(*map(part, (year, month, day, hour, minute, second)))


def from_unix(x: Column, unit: str = "s") -> Column:
    """A time from whole seconds, milliseconds or microseconds since 1970, read as UTC."""
    us = x.cast("long") * {"s": 1_000_000, "ms": 1000, "us": 1}[unit]
    return added(made(1970, 1, 1), us)


def added(ts: Column, us: Column | int) -> Column:
    """A time some microseconds on, or back if negative."""
    us = us if isinstance(us, Column) else F.lit(us)
    return ts + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def added_date(ts: Column, years: int, months: int = 0, days: int = 0) -> Column:
    """A time some years, months and days on; a day that the month lacks is its last."""
    return _later(_months_on(ts, years * 12 + months, "floor"), days * 86400)


def between(a: Column, b: Column) -> Column:
    """Microseconds from b to a."""
    return micros(a) - micros(b)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is before, at or after b."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
