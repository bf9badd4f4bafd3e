"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first last``; NULL if either part is NULL (``concat``, not ``concat_ws``)."""
    a = F.col(first) if isinstance(first, str) else first
    b = F.col(last) if isinstance(last, str) else last
    return F.concat(a, F.lit(" "), b)


def advisor_email(domain: str) -> Column:
    """The login an advisor row stands for: given.family@domain in lower case, accents kept."""
    return F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name"), F.lit("@" + domain))


def or_zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def or_unknown(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("Unknown"))
