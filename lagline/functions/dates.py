"""Column functions for dates and times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published federal holidays of 2015 to 2019, with most of the observed days.
FEDERAL_HOLIDAYS = (
    "2015-01-01", "2015-01-19", "2015-02-16", "2015-05-25", "2015-07-04",
    "2015-09-07", "2015-10-12", "2015-11-11", "2015-11-26", "2015-12-25",
    "2016-01-01", "2016-01-18", "2016-02-15", "2016-05-30", "2016-07-04",
    "2016-09-05", "2016-10-10", "2016-11-11", "2016-11-24", "2016-12-25", "2016-12-26",
    "2017-01-01", "2017-01-02", "2017-01-16", "2017-02-20", "2017-05-29", "2017-07-04",
    "2017-09-04", "2017-10-09", "2017-11-10", "2017-11-11", "2017-11-23", "2017-12-25",
    "2018-01-01", "2018-01-15", "2018-02-19", "2018-05-28", "2018-07-04",
    "2018-09-03", "2018-10-08", "2018-11-11", "2018-11-12", "2018-11-22", "2018-12-25",
    "2019-01-01", "2019-01-21", "2019-02-18", "2019-05-27", "2019-07-04",
    "2019-09-02", "2019-10-14", "2019-11-11", "2019-11-28", "2019-12-25",
)

LISTED_YEARS = range(2015, 2020)

MICROS_PER_SECOND = 1_000_000


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 as a long; works for timestamp, timestamp_ntz and date."""
    return F.unix_micros(as_column(ts).cast("timestamp"))


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01."""
    return F.unix_seconds(as_column(ts).cast("timestamp"))


def _padded(part: str | Column, width: int) -> Column:
    """The part as text of at least ``width`` digits; ``lpad`` alone would cut longer ones."""
    text = as_column(part).cast("string")
    return F.when(F.length(text) > width, text).otherwise(F.lpad(text, width, "0"))


def calendar_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Date of the three parts; parts that are no date (over-long, negative, null) give null."""
    text = F.concat(_padded(year, 4), F.lit("-"), _padded(month, 2), F.lit("-"), _padded(day, 2))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def calendar_text(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """The same three parts as zero-padded text ``yyyy-mm-dd``."""
    return F.concat_ws(
        "-",
        as_column(year).cast("string"),
        _padded(month, 2),
        _padded(day, 2),
    )


def day_of_year(date: str | Column) -> Column:
    return F.dayofyear(as_column(date))


def holiday_window_dates(holidays: tuple[str, ...] | list[str], days: int = 2) -> list[dt.date]:
    """Every date at most ``days`` from a holiday, sorted; length is bounded by the holiday list."""
    window = set()
    for text in holidays:
        day = dt.date.fromisoformat(text)
        window.update(day + dt.timedelta(days=shift) for shift in range(-days, days + 1))
    return sorted(window)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month (Monday is 0), from its end for n = -1."""
    if n < 0:
        last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
        return last - dt.timedelta(days=(last.weekday() - weekday) % 7)
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def federal_holidays(years: range) -> list[str]:
    """Federal holidays of the years: as published where they are listed, by rule for all others.

    By rule a holiday on a Saturday is also observed on the Friday before, one on a Sunday on the Monday after.
    """
    days = {dt.date.fromisoformat(d) for d in FEDERAL_HOLIDAYS if int(d[:4]) in years}
    for year in set(years) - set(LISTED_YEARS):
        fixed = [(1, 1), (7, 4), (11, 11), (12, 25)] + [(6, 19)] * (year >= 2021)
        for day in (dt.date(year, *md) for md in fixed):
            days |= {day, day + dt.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))}
        # third Monday of January and of February, last of May, first of September, second of October, fourth Thursday of November
        days |= {_nth_weekday(year, *rule) for rule in ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))}
    return sorted(d.isoformat() for d in days)


def holiday_window(
    date: str | Column, holidays: tuple[str, ...] | list[str] | None = None, days: int = 2, years: range = range(2000, 2041)
) -> Column:
    """1 when the date lies at most ``days`` from a holiday, else 0: a set lookup, no join.

    Without ``holidays`` the federal ones of ``years`` are used. Dates outside the years that the holidays cover give null, not 0.
    """
    if holidays is None:
        holidays = federal_holidays(range(years.start - 1, years.stop + 1))
    else:
        years = range(min(int(d[:4]) for d in holidays), max(int(d[:4]) for d in holidays) + 1)
    date = as_column(date).cast("date")
    inside = date.isin(holiday_window_dates(holidays, days))
    return F.when(inside, 1).when(F.year(date).between(years.start, years.stop - 1), 0)


def hhmm_minutes_diff(end: str | Column, start: str | Column, late_start_hour: int = 20, early_end_hour: int = 3) -> Column:
    """Minutes from ``start`` to ``end``, both clock numbers such as 2359 or 5.

    A start after ``late_start_hour`` with an end before ``early_end_hour`` crosses midnight.
    """
    end, start = as_column(end), as_column(start)
    end_hour, start_hour = F.floor(end / 100), F.floor(start / 100)
    minutes = (end_hour * 60 + end % 100) - (start_hour * 60 + start % 100)
    overnight = (end_hour < early_end_hour) & (start_hour > late_start_hour)
    return F.when(overnight, minutes + 24 * 60).otherwise(minutes)


def parse_date(text: str | Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date of dirty text, null where it is none."""
    return F.try_to_date(F.trim(as_column(text)), pattern)


def parse_number(text: str | Column) -> Column:
    """Double of dirty text, null where it is none."""
    return F.trim(as_column(text)).try_cast("double")
