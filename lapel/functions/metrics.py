"""Named metrics, for use inside ``.agg()`` over fact or client rows, and by name in SQL text.

Each is written once, as an SQL expression; the function of its name gives it as a Column, ``metric_sql`` as text. They
are unrounded; wrap money in ``money()``, or ``ROUND``, where a report wants cents.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.functions.dates import month_start
from lapel.functions.money import mean_sql, ratio_sql, share_sql, total_sql

#: The SQL text of each metric by name, as functions of its parameters.
SQL: dict[str, Callable[..., str]] = {}
#: The named metrics as columns by name; what each means is in its docstring.
NAMED: dict[str, Callable[..., Column]] = {}

SOLD = "CASE WHEN NOT is_return THEN total_amount"


def _metric(text: Callable[..., str]) -> Callable[..., Column]:
    @wraps(text)
    def column(*args: Any, **params: Any) -> Column:
        return F.expr(text(*args, **params))

    SQL[text.__name__], NAMED[text.__name__] = text, column
    return column


def _day(value: date) -> str:
    return f"DATE '{value.isoformat()}'"


@_metric
def revenue() -> str:
    """Sales without returns. All rows returns: 0, not NULL."""
    return total_sql(f"{SOLD} ELSE 0.0D END")


@_metric
def net_revenue() -> str:
    """Sales minus returns."""
    return total_sql(f"{SOLD} ELSE -total_amount END")


@_metric
def aov() -> str:
    """Mean amount of the non-returned rows, NULL when there are none."""
    return mean_sql(f"{SOLD} END")


@_metric
def days_since_last_purchase(as_of: date) -> str:
    """Row level: whole days from the client's last purchase to ``as_of``."""
    return f"DATEDIFF({_day(as_of)}, last_purchase_date)"


@_metric
def gross_per_sqft(square_footage: str = "square_footage", exclude_returns: bool = False) -> str:
    """Amount per square foot of one store. As defined it counts returns too; the flag leaves them out."""
    amount = total_sql(f"{SOLD} ELSE 0.0D END" if exclude_returns else "total_amount")
    return ratio_sql(f"CAST({amount} AS DOUBLE)", square_footage)


@_metric
def vip_at_risk_count() -> str:
    """Clients both VIP and in the at-risk segment."""
    return "COUNT(CASE WHEN is_vip AND client_segment = 'At-Risk' THEN 1 END)"


@_metric
def repurchase_rate() -> str:
    """Fraction of distinct clients with more than one order."""
    return share_sql("COUNT(DISTINCT CASE WHEN total_orders > 1 THEN client_id END)", "COUNT(DISTINCT client_id)")


@_metric
def discount_rate(as_pct: bool = False) -> str:
    """Fraction (or percent) of all rows, returns included, that carry a discount."""
    return share_sql(f"SUM(CASE WHEN discount_pct > 0 THEN {100 if as_pct else 1} ELSE 0 END)", "COUNT(*)")


@_metric
def return_rate() -> str:
    """Returned rows in percent of all rows, unrounded."""
    return share_sql("SUM(CASE WHEN is_return THEN 100 ELSE 0 END)", "COUNT(*)")


@_metric
def growth_mom_naive(as_of: date) -> str:
    """Month-over-month growth by month *number* only.

    Kept because it is one of the published expressions: it adds the same month of every year, counts returns,
    and takes "30 days ago" for the prior month. :func:`growth_mom` is the one to use.
    """
    days = (_day(as_of), f"DATE_SUB({_day(as_of)}, 30)")
    sums = (total_sql(f"CASE WHEN MONTH(transaction_date) = MONTH({day}) THEN total_amount END") for day in days)
    now, then = (f"CAST({x} AS DOUBLE)" for x in sums)
    return ratio_sql(f"{now} - {then}", then)


def _month(as_of: date, back: int) -> str:
    """Revenue of the calendar month ``back`` months before the month of ``as_of``."""
    since, before = _day(month_start(as_of, back)), _day(month_start(as_of, back - 1))
    inside = f"transaction_date >= {since} AND transaction_date < {before} AND NOT is_return"
    return total_sql(f"CASE WHEN {inside} THEN total_amount ELSE 0.0D END")


def month_revenue(as_of: date, back: int = 0) -> Column:
    """Revenue of the calendar month ``back`` months before the month of ``as_of``."""
    return F.expr(_month(as_of, back))


@_metric
def growth_mom(as_of: date) -> str:
    """(this calendar month - the one before) / the one before; NULL when that one had no revenue."""
    now, then = _month(as_of, 0), _month(as_of, 1)
    return ratio_sql(f"CAST({now} - {then} AS DOUBLE)", f"CAST({then} AS DOUBLE)")


@_metric
def live_client_count(approx: bool = False) -> str:
    """Distinct buyers; the approximate form only on request."""
    return "APPROX_COUNT_DISTINCT(client_id)" if approx else "COUNT(DISTINCT client_id)"


def metric_sql(name: str, **params: Any) -> str:
    """A metric's SQL expression."""
    if name not in SQL:
        raise ValueError(f"no metric {name!r}; there are {', '.join(sorted(SQL))}")
    return SQL[name](**params)


def _texts(as_of: date) -> dict[str, str]:
    needs_day = {"days_since_last_purchase", "growth_mom_naive", "growth_mom"}
    return {name: text(as_of) if name in needs_day else text() for name, text in SQL.items()}


def sql_with_metrics(spark: SparkSession, query: str, as_of: date) -> DataFrame:
    """A query that names metrics in braces: ``SELECT store_id, {net_revenue} FROM transactions GROUP BY store_id``."""
    return spark.sql(query.format(**{name: f"({text})" for name, text in _texts(as_of).items()}))


def register_metrics(spark: SparkSession, as_of: date, view: str = "named_metrics") -> None:
    """A view of name, expression, description, for those who build SQL text in SQL (``EXECUTE IMMEDIATE``)."""
    lines = [(name, text, " ".join((SQL[name].__doc__ or "").split())) for name, text in _texts(as_of).items()]
    spark.createDataFrame(lines, "name string, expression string, description string").createOrReplaceTempView(view)


def year_bucket(col: str, as_of: date) -> Column:
    """Current Year / Prior Year label, NULL for other years."""
    number = F.year(col)
    return F.when(number == as_of.year, "Current Year").when(number == as_of.year - 1, "Prior Year")
