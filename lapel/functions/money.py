"""Exact money on double columns.

Amounts of the fact are stored as doubles with at most four decimals. Inside an aggregate each is turned into a whole
number of ten-thousandths, so sums are exact and do not depend on row order or partitioning, at the price of adding two
longs (decimal sums cost two to four times as much per row). Amounts too large for that are added as decimals: for up to
four decimals that is the same; a fifth is rounded half to even below that size and half up beyond it, so data that has
one belongs rounded first (``star.amount_check`` counts such rows). Totals
that are summed again (a client's spend) are few, and are added as decimals from the start. Sums hold 20 digits before
the point.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000
LOW_BITS = 20
LARGE = 9e11  # ten-thousandths of more than this do not fit a long
SUM = "decimal(24,4)"


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def units(col: Column | str) -> Column:
    """An amount below LARGE in ten-thousandths, as a long."""
    return F.rint(_column(col) * float(UNITS)).cast("long")


def from_units(col: Column) -> Column:
    """Ten-thousandths back to an amount."""
    return col / float(UNITS)


def split_sums(col: Column | str) -> dict[str, Column]:
    """Sums of the high and of the low bits of the units, two longs that do not overflow below 1e12 rows per group, and
    of the large amounts, a decimal that is NULL as a rule.

    Where sums are summed again, these are: turning them into one decimal is left to the last step.
    """
    value = _column(col)
    small = F.abs(value) < LARGE
    u = F.when(small, units(F.when(small, value)))
    return {
        "high": F.sum(F.shiftright(u, LOW_BITS)),
        "low": F.sum(u.bitwiseAND(F.lit((1 << LOW_BITS) - 1))),
        "large": F.sum(F.when(~small, value.cast(SUM))).cast(SUM),
    }


def whole(high: Column, low: Column, large: Column) -> Column:
    """The exact amount from the three sums, a decimal(24,4)."""
    both = high.cast("decimal(28,0)") * F.lit(1 << LOW_BITS) + low.cast("decimal(20,0)")
    small = (both * F.lit(Decimal(1) / UNITS)).cast(SUM)
    return F.coalesce((small + large).cast(SUM), small, large)


def total(col: Column | str) -> Column:
    """Exact sum of amounts of the fact, for use inside ``agg``: a decimal(24,4), NULL for no values."""
    return whole(**split_sums(col))


def total_of_totals(col: Column | str) -> Column:
    """Exact sum of totals, one per client or so."""
    return F.sum(_column(col).cast(SUM)).cast(SUM)


def money(col: Column | str) -> Column:
    """An exact amount rounded half-up to cents, as a double."""
    return F.round(_column(col), 2).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL when the divisor is zero."""
    return top / F.nullif(bottom, F.lit(0))


def mean(col: Column | str) -> Column:
    """Exact mean for use inside ``agg``: exact sum over count, NULL for no values."""
    return ratio(total(col), F.count(col))


def mean_of_totals(col: Column | str) -> Column:
    return ratio(total_of_totals(col), F.count(col))


def share(hits: Column, of: Column) -> Column:
    """A fraction as a double from two counts, NULL for an empty total."""
    return ratio(hits.cast("double"), of)


def total_sql(x: str) -> str:
    """``total`` of an expression as SQL text."""
    small = f"ABS({x}) < {LARGE!r}D"
    units_of = f"CASE WHEN {small} THEN CAST(RINT(({x}) * {float(UNITS)!r}D) AS BIGINT) END"
    high, low = f"SUM(SHIFTRIGHT({units_of}, {LOW_BITS}))", f"SUM(({units_of}) & {(1 << LOW_BITS) - 1}L)"
    both = f"CAST({high} AS DECIMAL(28,0)) * {1 << LOW_BITS} + CAST({low} AS DECIMAL(20,0))"
    part = f"CAST(({both}) * {Decimal(1) / UNITS} AS {SUM})"
    large = f"CAST(SUM(CASE WHEN NOT ({small}) THEN CAST({x} AS {SUM}) END) AS {SUM})"
    return f"COALESCE(CAST({part} + {large} AS {SUM}), {part}, {large})"


def ratio_sql(top: str, bottom: str) -> str:
    return f"({top}) / NULLIF({bottom}, 0)"


def mean_sql(x: str) -> str:
    return ratio_sql(total_sql(x), f"COUNT({x})")


def share_sql(hits: str, of: str) -> str:
    return ratio_sql(f"CAST({hits} AS DOUBLE)", of)
