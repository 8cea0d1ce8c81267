"""The as-of clock: queries never look at the wall clock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    """A fixed instant in UTC, as text."""

    at: str = "2001-08-01 00:00:00"

    def now(self) -> Column:
        return F.to_timestamp_ntz(F.lit(self.at))

    def today(self) -> Column:
        return F.to_date(F.lit(self.at))

    def days_ago(self, n: int) -> Column:
        """Midnight n days before."""
        return F.date_sub(self.today(), n)

    def exactly_days_ago(self, n: int) -> Column:
        """The same time of day n days before."""
        return F.expr(f"TIMESTAMP_NTZ '{self.at}' - INTERVAL {int(n)} DAYS")

    def month_start(self) -> Column:
        return F.trunc(self.today(), "MM")

    def hours_since(self, when: Column) -> Column:
        """Exact hours, by whole seconds."""
        return F.timestamp_diff("SECOND", when, self.now()) / F.lit(3600.0)


def iso_time(text: Column) -> Column:
    """The time of an ISO text, a Z left out; null where it cannot be parsed."""
    plain = F.replace(text, F.lit("Z"), F.lit(""))
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
    return F.when(plain.rlike(shape), F.try_to_timestamp(plain).cast("timestamp_ntz"))


def day_shown(time: Column) -> Column:
    """yyyy-MM-dd of a time or of its text."""
    return F.left(time.cast("string"), F.lit(10))


def minute_shown(time: Column) -> Column:
    """HH:mm of a time or of its text."""
    return F.substring(time.cast("string"), 12, 5)


def month_day_shown(day: Column) -> Column:
    """MM-dd of a day or of its text."""
    return F.right(day.cast("string"), F.lit(5))
