"""Advisor questions. An advisor's store is the one they work at, not the one of the sale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapel.functions.money import mean, money, total
from lapel.functions.names import full_name
from lapel.operators.ranking import number_rows
from lapel.sources.star import Star


def _by_advisor(star: Star, measures: Sequence[Column], *cols: str) -> DataFrame:
    return star.sales("advisor_id", "total_amount", *cols).groupBy("advisor_id").agg(*measures)


def _staffed(star: Star, store_cols: Sequence[str], *cols: str) -> DataFrame:
    """Advisors with name and home store."""
    people = star.advisors("advisor_id", "first_name", "last_name", "store_id", *cols)
    return people.join(star.stores("store_id", *store_cols), "store_id").withColumn(
        "advisor_name", full_name("first_name", "last_name")
    )


def advisor_revenue(star: Star) -> DataFrame:
    """Advisors from most to least revenue."""
    sums = _by_advisor(
        star,
        [
            F.count(F.lit(1)).alias("transactions"),
            money(total("total_amount")).alias("total_revenue"),
            money(mean("total_amount")).alias("avg_order_value"),
            F.count_distinct("client_id").alias("unique_clients"),
        ],
        "client_id",
    )
    out = _staffed(star, ["store_name"], "specialization").join(sums, "advisor_id")
    return out.orderBy(F.desc("total_revenue"), "advisor_id").select(
        "advisor_name",
        "specialization",
        "store_name",
        "transactions",
        "total_revenue",
        "avg_order_value",
        "unique_clients",
    )


def advisor_leaderboard(star: Star) -> DataFrame:
    """The same figures with the city of the home store."""
    sums = _by_advisor(
        star,
        [
            F.count(F.lit(1)).alias("total_transactions"),
            money(total("total_amount")).alias("total_revenue"),
            money(mean("total_amount")).alias("avg_order_value"),
            F.count_distinct("client_id").alias("clients_served"),
        ],
        "client_id",
    )
    out = _staffed(star, ["store_name", "city"], "specialization").join(sums, "advisor_id")
    return out.orderBy(F.desc("total_revenue"), "advisor_id").select(
        "advisor_name",
        "specialization",
        "store_name",
        "city",
        "total_transactions",
        "total_revenue",
        "avg_order_value",
        "clients_served",
    )


def advisors_having(star: Star, min_clients: int = 60, min_aov: float = 800) -> DataFrame:
    """Advisors with more recorded clients than ``min_clients`` and a mean sale above ``min_aov``.

    The bound is tried on the unrounded mean.
    """
    sums = _by_advisor(star, [mean("total_amount").alias("aov"), total("total_amount").alias("total")])
    people = _staffed(star, ["store_name"], "specialization", "client_count")
    people = people.filter(F.col("client_count") > min_clients)
    out = people.join(sums.filter(F.col("aov") > min_aov), "advisor_id")
    out = out.withColumns({"actual_aov": money("aov"), "total_revenue": money("total")})
    return out.orderBy(F.desc("total_revenue"), "advisor_id").select(
        "advisor_name", "specialization", "store_name", "client_count", "actual_aov", "total_revenue"
    )


def best_aov_advisors(star: Star, n: int = 1) -> DataFrame:
    sums = _by_advisor(star, [money(mean("total_amount")).alias("avg_order_value")])
    named = star.advisors("advisor_id", "first_name", "last_name").join(sums, "advisor_id")
    out = named.orderBy(F.desc("avg_order_value"), "advisor_id").limit(n)
    return out.select(full_name("first_name", "last_name").alias("advisor_name"), "avg_order_value")


def rank_by_revenue(star: Star) -> DataFrame:
    """Every advisor with sales, numbered by revenue. The sums are written to the scratch folder."""
    sums = _by_advisor(star, [total("total_amount").alias("total")])
    named = star.advisors("advisor_id", "first_name", "last_name").join(sums, "advisor_id")
    ranked = number_rows(named, "total", "advisor_id")
    return ranked.select(
        "advisor_id",
        full_name("first_name", "last_name").alias("advisor_name"),
        money("total").alias("total_revenue"),
        "rank",
    )
