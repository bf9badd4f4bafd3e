"""The named metrics evaluated at a stated grain."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lapel.functions import metrics as M
from lapel.functions.dates import month_of, month_start, year_span
from lapel.functions.money import money, ratio, share, total
from lapel.functions.names import or_unknown, or_zero
from lapel.sources.star import Star


def fact_metric(star: Star, by: str, out: str, metric: Column, *cols: str) -> DataFrame:
    """One metric over all fact rows, grouped by a fact column."""
    need = dict.fromkeys((by, *cols))
    return star.transactions(*need).groupBy(by).agg(metric.alias(out))


def revenue_by(star: Star, by: str = "store_id") -> DataFrame:
    return fact_metric(star, by, "revenue", money(M.revenue()), "total_amount", "is_return")


def net_revenue_by(star: Star, by: str = "store_id") -> DataFrame:
    return fact_metric(star, by, "net_revenue", money(M.net_revenue()), "total_amount", "is_return")


def aov_by(star: Star, by: str = "payment_method") -> DataFrame:
    return fact_metric(star, by, "aov", money(M.aov()), "total_amount", "is_return")


def discount_rate_by(star: Star, by: str = "payment_method", as_pct: bool = False) -> DataFrame:
    return fact_metric(star, by, "discount_rate", M.discount_rate(as_pct), "discount_pct")


def return_rate_by(star: Star, by: str = "store_id") -> DataFrame:
    return fact_metric(star, by, "return_rate", M.return_rate(), "is_return")


def live_client_count(star: Star, approx: bool = False) -> DataFrame:
    """Distinct buyers per advisor next to the recorded count; advisors without sales have 0."""
    live = star.sales("advisor_id", "client_id").groupBy("advisor_id")
    live = live.agg(M.live_client_count(approx).alias("live_clients"))
    out = star.advisors("advisor_id", "client_count").join(live, "advisor_id", "left")
    return out.select("advisor_id", "client_count", or_zero("live_clients").alias("live_clients"))


def revenue_per_sqft(star: Star, exclude_returns: bool = False) -> DataFrame:
    """Amount per square foot of each store with rows in the fact. The fact is added up before it meets the stores."""
    source = star.sales if exclude_returns else star.transactions
    sums = source("store_id", "total_amount").groupBy("store_id").agg(total("total_amount").alias("total"))
    out = sums.join(star.stores("store_id", "store_name", "square_footage"), "store_id")
    per = ratio(F.col("total").cast("double"), F.col("square_footage")).alias("revenue_per_sqft")
    return out.select("store_id", "store_name", per)


def days_since_last_purchase(star: Star, as_of: date) -> DataFrame:
    rows = star.clients("client_id", "last_purchase_date")
    return rows.select("client_id", M.days_since_last_purchase(as_of).alias("days_since_last_purchase"))


def vip_at_risk_count(star: Star, by: str = "city") -> DataFrame:
    rows = star.clients("is_vip", "client_segment", by)
    return rows.groupBy(by).agg(M.vip_at_risk_count().alias("vip_at_risk_count"))


def repurchase_rate(star: Star, by: str = "city") -> DataFrame:
    """Fraction of clients per group with more than one order.

    Clients are made distinct by a grouping of their own: one pass, where the metric's two distinct counts side by
    side would double the rows.
    """
    rows = star.clients("client_id", "total_orders", by).filter(F.col("client_id").isNotNull())
    people = rows.groupBy(by, "client_id").agg(F.max(F.col("total_orders") > 1).alias("again"))
    return people.groupBy(by).agg(share(F.count_if("again"), F.count(F.lit(1))).alias("repurchase_rate"))


def growth_mom_naive(star: Star, as_of: date) -> DataFrame:
    rows = star.transactions("transaction_date", "total_amount")
    return rows.agg(M.growth_mom_naive(as_of).alias("growth_mom_naive"))


def growth_mom(star: Star, as_of: date, by: str = "store_id") -> DataFrame:
    """Growth of the month of ``as_of`` over the one before. Only these two months are read.

    A group without any row in the two months is absent.
    """
    span = {"since": month_start(as_of, 1), "before": month_start(as_of, -1)}
    rows = star.transactions(by, "transaction_date", "total_amount", "is_return", **span)
    return rows.groupBy(by).agg(
        money(M.month_revenue(as_of)).alias("current_month"),
        money(M.month_revenue(as_of, 1)).alias("prior_month"),
        M.growth_mom(as_of).alias("growth_mom"),
    )


def growth_mom_series(star: Star, by: str = "store_id") -> DataFrame:
    """Revenue and growth of every month per group. A month after a gap has no prior month, hence NULL growth."""
    rows = star.sales(by, "transaction_date", "total_amount")
    months = rows.groupBy(by, month_of("transaction_date").alias("month")).agg(total("total_amount").alias("total"))
    line = W.partitionBy(by).orderBy("month")
    adjacent = F.lag("month").over(line) == F.add_months("month", -1)
    prior = F.when(adjacent, F.lag("total").over(line))
    growth = ratio((F.col("total") - prior).cast("double"), prior.cast("double"))
    return months.select(by, "month", money("total").alias("revenue"), growth.alias("growth_mom"))


def purchase_frequency(star: Star) -> DataFrame:
    """Purchases per client and calendar year, returns left out."""
    rows = star.sales("client_id", "transaction_date").filter(F.col("client_id").isNotNull())
    out = rows.groupBy("client_id", F.year("transaction_date").alias("year"))
    return out.agg(F.count(F.lit(1)).alias("purchases"))


def yoy(star: Star, as_of: date, by: str = "store_id") -> DataFrame:
    """Revenue of this and the last calendar year. Only these two years are read."""
    span = {"since": year_span(as_of.year - 1)["since"], "before": year_span(as_of.year)["before"]}
    rows = star.sales(by, "transaction_date", "total_amount", **span)
    bucket = M.year_bucket("transaction_date", as_of).alias("period")
    return rows.groupBy(by, bucket).agg(money(total("total_amount")).alias("revenue"))


def null_defaults(star: Star) -> DataFrame:
    """Client figures with 0 for missing numbers and 'Unknown' for missing text."""
    rows = star.clients("client_id", "lifetime_spend", "total_orders", "preferred_category")
    return rows.select(
        "client_id",
        money(or_zero("lifetime_spend")).alias("lifetime_spend"),
        or_zero("total_orders").alias("total_orders"),
        or_unknown("preferred_category").alias("preferred_category"),
    )
