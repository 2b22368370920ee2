"""Dates: tolerant parsing, sessions, calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import col

# Accepted date layouts, ISO first, then day first.
BAR_DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy")
BROKER_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy")


def parse_date(x: Column | str, formats: tuple[str, ...] = BAR_DATE_FORMATS) -> Column:
    """The first layout that fits; NULL when none does."""
    s = F.trim(col(x).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*tries)


def market_calendar(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per market session with its running index ``s``.

    The unpartitioned window runs over distinct dates only (about 250 rows a year), never over bars.
    """
    days = bars.select(*by, "d").distinct()
    window = Window.partitionBy(*by).orderBy("d") if by else Window.orderBy("d")
    return days.withColumn("s", F.row_number().over(window))


def nth_session(calendar: DataFrame, n: int) -> DataFrame:
    """Each session with the date of the n-th session after it (NULL past the end)."""
    return calendar.withColumn(f"next_{n}", F.lead("d", n).over(Window.orderBy("d")))


def add_weekdays(x: Column | str, n: int) -> Column:
    """The date n weekdays later, counting Monday to Friday only."""
    d = col(x)
    wd = F.weekday(d)  # Monday = 0
    # From a weekend the count starts at the Friday before it.
    back = F.when(wd == 5, 1).when(wd == 6, 2).otherwise(0)
    start = F.date_sub(d, back)
    day = F.least(wd, F.lit(4))
    total = day + n
    return F.date_add(start, (F.floor(total / 5) * 7 + total % 5 - day).cast("int"))


def sessions_cutoff(bars: DataFrame, n: int) -> Column:
    """Scalar: the first of the last n market sessions."""
    last = bars.select("d").distinct().orderBy(F.desc("d")).limit(n)
    return last.agg(F.min("d")).scalar()


def latest_date(bars: DataFrame) -> Column:
    """Scalar: the market's newest date."""
    return bars.agg(F.max("d")).scalar()


def latest(bars: DataFrame, per: str | None = None) -> DataFrame:
    """Rows on the market's newest date, or on each symbol's own newest date."""
    if per is None:
        return bars.filter(F.col("d") == latest_date(bars))
    newest = F.max("d").over(Window.partitionBy(per))
    return bars.withColumn("_newest", newest).filter(F.col("d") == F.col("_newest")).drop("_newest")


def clamp_date(x: Column | str, bars: DataFrame) -> Column:
    """A requested date, never later than the data."""
    return F.least(col(x), latest_date(bars))


PERIOD_KINDS = ("day", "week", "month", "quarter", "half", "year", "2y", "3y", "5y", "all")


def period_key(x: Column | str, kind: str) -> Column:
    """Text key of the calendar period a date falls in. Weeks run from Monday and days before the
    year's first Monday are week 00; 2-year spans start on even years, 3- and 5-year spans on 2020."""
    d = col(x)
    year, month = F.year(d), F.month(d)
    ytext = year.cast("string")

    def span(start: Column, length: int) -> Column:
        return F.concat_ws("-", start.cast("string"), (start + (length - 1)).cast("string"))

    def anchored(length: int) -> Column:
        # Whole spans from 2020, truncated toward zero before it.
        k = ((year - 2020) / length).cast("int")
        return span(k * length + 2020, length)

    if kind == "day":
        return d.cast("string")
    if kind == "week":
        week = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7)
        return F.concat(ytext, F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    if kind == "month":
        return F.date_format(d, "yyyy-MM")
    if kind == "quarter":
        return F.concat(ytext, F.lit("-Q"), F.quarter(d).cast("string"))
    if kind == "half":
        return F.concat(ytext, F.lit("-H"), F.when(month <= 6, "1").otherwise("2"))
    if kind == "year":
        return ytext
    if kind == "2y":
        return span(F.floor(year / 2) * 2, 2)
    if kind == "3y":
        return anchored(3)
    if kind == "5y":
        return anchored(5)
    if kind == "all":
        return F.lit("all")
    raise ValueError(f"unknown period: {kind}")


# Lengths in days of the named trailing windows, both ends included.
TRAILING_DAYS = {
    "day": 1, "week": 7, "month": 30, "quarter": 90, "half": 180, "year": 365, "2y": 730, "3y": 1095, "5y": 1825,
}
ALL_DATA_START = "2020-01-02"


def period_start(newest: Column | str, kind: str, all_start: str = ALL_DATA_START) -> Column:
    """First day of a named trailing window that ends on ``newest``."""
    if kind == "all":
        return F.lit(all_start).cast("date")
    return F.date_sub(col(newest), TRAILING_DAYS[kind] - 1)
