"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year(t: Column) -> Column:
    return F.year(t).cast("long")


def days_in_year(t: Column) -> Column:
    """365 or 366, by the proleptic Gregorian calendar."""
    y = F.year(t)
    return F.datediff(F.make_date(y + 1, F.lit(1), F.lit(1)), F.make_date(y, F.lit(1), F.lit(1))).cast("long")


def season(t: Column) -> Column:
    m = F.month(t)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def dates(start: Column, end: Column, step: str = "1 day") -> Column:
    """Array of dates or times from start to end, both included."""
    return F.sequence(start, end, F.expr(f"interval {step}"))


def densify(df: DataFrame, keys: list[str], t: str, fill: dict | None = None, step: str = "1 day") -> DataFrame:
    """One row for each key and time between the first and last of the whole table; what was missing is fill, or null."""
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("b"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(ends)).select(*keys, F.explode(dates(F.col("a"), F.col("b"), step)).alias(t))
    out = grid.join(df, [*keys, t], "left")
    return out.fillna(fill) if fill else out


def from_year_day(text: Column) -> Column:
    """'YYYYDDD' to a date."""
    return F.date_add(F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(text, 5, 3).cast("int") - 1)


def month_of_day(doy: Column, in_year: Column) -> Column:
    """Month of a day of the year."""
    return F.month(F.date_add(F.make_date(in_year.cast("int"), F.lit(1), F.lit(1)), doy.cast("int") - 1)).cast("long")


#: Days before each month of a common year.
_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def _day_number(y: int, m: int, d: int, calendar: str) -> int:
    """Days of a calendar from its year 0 on."""
    leap = 1 if m > 2 else 0
    if calendar == "360_day":
        return 360 * y + 30 * (m - 1) + d - 1
    if calendar == "all_leap":
        return 366 * y + _BEFORE[m - 1] + leap + d - 1
    if calendar == "julian":
        return 365 * y + (y + 3) // 4 + _BEFORE[m - 1] + (leap if y % 4 == 0 else 0) + d - 1
    return 365 * y + _BEFORE[m - 1] + d - 1


def cf_parts(offset: Column, units: str, calendar: str) -> Column:
    """struct(year, month, day, micros of the day) of an offset in a calendar of its own: noleap (365_day), all_leap (366_day), 360_day
    or julian, whose dates need not be dates elsewhere."""
    calendar = {"365_day": "noleap", "366_day": "all_leap"}.get(calendar, calendar)
    unit, _, origin = units.partition(" since ")
    micros = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[unit.strip().lower().rstrip("s")]
    date, _, clock = origin.strip().replace("T", " ").partition(" ")
    y, m, d = map(int, date.split("-"))
    part = [float(x) for x in clock.rstrip("Z").split(":")] if clock else []
    start = _day_number(y, m, d, calendar) * 86_400_000_000 + round(sum(x * k for x, k in zip(part, (3600, 60, 1))) * 1_000_000)
    total = F.round(offset * micros).cast("long") + F.lit(start)
    n = F.floor(total / 86_400_000_000)
    if calendar == "360_day":
        y, rest = F.floor(n / 360), F.pmod(n, F.lit(360))
        month, day = F.floor(rest / 30) + 1, F.pmod(rest, F.lit(30)) + 1
    elif calendar in ("noleap", "all_leap", "julian"):
        if calendar == "julian":
            cycle, within = F.floor(n / 1461), F.pmod(n, F.lit(1461))  # a leap year first
            inside = F.when(within < 366, 0).otherwise(F.floor((within - 1) / 365))
            y, rest, leap = 4 * cycle + inside, F.when(within < 366, within).otherwise(within - 366 - 365 * (inside - 1)), within < 366
        else:
            size = 365 if calendar == "noleap" else 366
            y, rest, leap = F.floor(n / size), F.pmod(n, F.lit(size)), F.lit(calendar == "all_leap")
        extra = lambda i: F.when(leap, 1).otherwise(0) if i >= 2 else F.lit(0)
        month, before = F.lit(1), F.lit(0)
        for i in range(1, 12):
            first = F.lit(_BEFORE[i]) + extra(i)
            month, before = F.when(rest >= first, i + 1).otherwise(month), F.when(rest >= first, first).otherwise(before)
        day = rest - before + 1
    else:
        raise ValueError(f"no such calendar: {calendar}")
    whole = lambda c, name: c.cast("int").alias(name)
    return F.struct(whole(y, "year"), whole(month, "month"), whole(day, "day"), F.pmod(total, F.lit(86_400_000_000)).alias("micros"))


def cf_time(offset: Column, units: str, calendar: str = "standard") -> Column:
    """A timestamp from an offset and units such as 'hours since 1980-01-01'. Calendars of their own (see cf_parts) give the timestamp
    of the same date, null where there is none, such as a 30th of February."""
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        p = cf_parts(offset, units, calendar)
        date = F.unix_micros(F.try_make_timestamp(p["year"], p["month"], p["day"], F.lit(0), F.lit(0), F.lit(0)))
        return F.timestamp_micros(date + p["micros"])
    unit, _, origin = units.partition(" since ")
    micros = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[unit.strip().lower().rstrip("s")]
    return F.timestamp_micros(F.unix_micros(F.lit(origin.strip()).cast("timestamp")) + F.round(offset * micros).cast("long"))
