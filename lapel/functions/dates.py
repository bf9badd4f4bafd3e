"""Date rules. Every one takes its "as of" day; the clock is never read.

Bounds are built from literals with Spark's own date functions: they fold to constants, so a filter on them is a
plain range that reaches the parquet scan, where ``year(col) = 2026`` would not.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_span(year: int) -> dict[str, date]:
    """The half-open range of a calendar year, as keyword bounds for ``Star.sales``."""
    return {"since": date(year, 1, 1), "before": date(year + 1, 1, 1)}


def month_start(as_of: date, back: int = 0) -> date:
    """First day of the month ``back`` months before the month of ``as_of``."""
    months = as_of.year * 12 + as_of.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def days_ago(as_of: date, days: int) -> Column:
    return F.date_sub(F.lit(as_of), days)


def months_ago(as_of: date, months: int) -> Column:
    return F.add_months(F.lit(as_of), -months)


def in_last_days(col: str | Column, as_of: date, days: int) -> Column:
    """On or after ``as_of - days``: with the end day included that is days + 1 dates."""
    return (F.col(col) if isinstance(col, str) else col) >= days_ago(as_of, days)


def inactive_for(col: str | Column, as_of: date, days: int) -> Column:
    """Strictly before ``as_of - days``; NULL (never bought) does not count."""
    return (F.col(col) if isinstance(col, str) else col) < days_ago(as_of, days)


def days_since(col: str | Column, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), F.col(col) if isinstance(col, str) else col)


def month_of(col: str | Column) -> Column:
    """First of the month as a DATE."""
    return F.trunc(F.col(col) if isinstance(col, str) else col, "MM")
