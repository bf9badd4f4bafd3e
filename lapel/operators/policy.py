"""Row filters and column masks as transforms.

A policy is a function of the viewer. ``govern`` puts row filters and masks in front of a star: filters see raw
values, masks come next, and whatever question is asked works on the masked columns. Dropping the policy means
asking the star itself.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.functions.names import advisor_email
from lapel.sources.star import Star, ViewedStar

# Fixed value: what a viewer sees in place of an e-mail address.
HIDDEN_EMAIL = "***@***.***"

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """A transform of one table and the columns it reads."""

    table: str
    reads: tuple[str, ...]
    apply: Transform
    masks: bool = False


def _same(user: str, names: Collection[str]) -> bool:
    return user.lower() in {n.lower() for n in names}


def own_rows(star: Star, user: str, domain: str, table: str = "clients") -> Rule:
    """Only rows of the advisor whose login is ``user``; an unknown user sees none.

    Of several advisors with one login the lowest id counts.
    """
    who = star.advisors("advisor_id", "first_name", "last_name")
    who = who.filter(advisor_email(domain) == user.lower()).agg(F.min("advisor_id"))
    return Rule(table, ("advisor_id",), lambda df: df.filter(F.col("advisor_id") == who.scalar()))


def city_rows(user: str, restricted: Collection[str], city: str) -> Rule:
    """Restricted viewers see the clients of one city."""
    keep = F.col("city") == city if _same(user, restricted) else F.lit(True)
    return Rule("clients", ("city",), lambda df: df.filter(keep))


def mask_email(user: str, restricted: Collection[str]) -> Rule:
    shown = F.lit(HIDDEN_EMAIL) if _same(user, restricted) else F.col("email")
    return Rule("clients", ("email",), lambda df: df.withColumn("email", shown), masks=True)


def mask_lifetime_spend(user: str, restricted: Collection[str]) -> Rule:
    """Restricted viewers see NULL. Sorting by it leaves the order to the tie-break."""
    if not _same(user, restricted):
        return Rule("clients", ("lifetime_spend",), lambda df: df, masks=True)

    def hide(df: DataFrame) -> DataFrame:
        return df.withColumn("lifetime_spend", F.lit(None).cast(df.schema["lifetime_spend"].dataType))

    return Rule("clients", ("lifetime_spend",), hide, masks=True)


def govern(star: Star, *rules: Rule) -> Star:
    """The star as the rules leave it: all row filters on raw values first, then all masks."""
    lens = {}
    for table in {r.table for r in rules}:
        chain = sorted((r for r in rules if r.table == table), key=lambda r: r.masks)
        reads = tuple(dict.fromkeys(c for r in chain for c in r.reads))
        filters = [r for r in chain if not r.masks]
        rows = (_in_turn([r.apply for r in filters]), tuple(dict.fromkeys(c for r in filters for c in r.reads))) if filters else None
        lens[table] = (_in_turn([r.apply for r in chain]), reads, rows)
    return ViewedStar(star, lens)


def _in_turn(steps: list[Transform]) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
