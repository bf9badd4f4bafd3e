"""Client classification as pure column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier names from high to low; the last one has no lower bound.
TIERS = ("Platinum", "Gold", "Silver", "Classic")

# Fixed values: (days up to and including, label at or above the spend bound, label below it).
RISK_BANDS = (
    (90, "Loyal VIP", "Active"),
    (180, "High-Value At-Risk", "Cooling Off"),
    (365, "VIP Dormant", "Dormant"),
)
LOST = "Lost"


@dataclass(frozen=True)
class Bounds:
    """Spend and recency bounds; the defaults are the house rules."""

    platinum: float = 50_000
    gold: float = 20_000
    silver: float = 8_000
    vip: float = 10_000
    vvip: float = 20_000
    risk_spend: float = 20_000
    recent_days: int = 180
    dormant_days: int = 365
    new_orders: int = 3


HOUSE = Bounds()


def membership_tier(spend: Column, bounds: Bounds = HOUSE) -> Column:
    """Strictly above a bound reaches its tier; NULL spend is Classic."""
    tier = F.when(spend > bounds.platinum, TIERS[0]).when(spend > bounds.gold, TIERS[1])
    return tier.when(spend > bounds.silver, TIERS[2]).otherwise(TIERS[3])


def tier_rank(tier: Column) -> Column:
    """1 for Platinum down to 4; anything unknown sorts with Classic."""
    rank = F.when(tier == TIERS[0], 1).when(tier == TIERS[1], 2).when(tier == TIERS[2], 3)
    return rank.otherwise(4)


def is_vip(spend: Column, flagged: Column | None = None, bounds: Bounds = HOUSE) -> Column:
    """Spend above the bound, or flagged by hand."""
    rich = F.coalesce(spend > bounds.vip, F.lit(False))
    return rich if flagged is None else rich | F.coalesce(flagged, F.lit(False))


def is_vvip(vip: Column, spend: Column, bounds: Bounds = HOUSE) -> Column:
    return F.coalesce(vip & (spend > bounds.vvip), F.lit(False))


def risk_tier(days: Column, spend: Column, bounds: Bounds = HOUSE) -> Column:
    """Recency bands split by spend, first match wins.

    Only the oldest band ignores spend in its low half, so NULL spend is Dormant up to 365 days; NULL days and
    anything older is Lost.
    """
    out = None
    for limit, high, low in RISK_BANDS:
        inside = days <= limit
        out = F.when(inside & (spend >= bounds.risk_spend), high) if out is None else out.when(
            inside & (spend >= bounds.risk_spend), high
        )
        below = inside if limit == RISK_BANDS[-1][0] else inside & (spend < bounds.risk_spend)
        out = out.when(below, low)
    return out.otherwise(LOST)


def segment(days: Column, orders: Column, gap: Column, vip: Column, bounds: Bounds = HOUSE) -> Column:
    """Segment from activity; the published definitions overlap, so they are tried in this order.

    New (recent, few orders), Re-engaged (recent, after a gap longer than the dormancy bound), Dormant, At-Risk
    (VIP, not recent), Active. No purchase at all: NULL.
    """
    recent = days <= bounds.recent_days
    return (
        F.when(days.isNull(), F.lit(None).cast("string"))
        .when(recent & (orders < bounds.new_orders), "New")
        .when(recent & (gap > bounds.dormant_days), "Re-engaged")
        .when(days > bounds.dormant_days, "Dormant")
        .when(vip & ~recent, "At-Risk")
        .otherwise("Active")
    )
