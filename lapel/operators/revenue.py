"""Sales questions by period, store, city, category, brand and product.

Rows are added up under the key the fact itself carries (store_id, advisor_id, product_id) before names are joined,
so a dimension meets a handful of sums instead of the fact, and equal names with different ids stay apart. Only
groups by an attribute (city, category, brand) join first. Rows are counted rather than transaction ids, which are
never NULL: the widest column is not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapel.functions.bitmaps import distinct_counts
from lapel.functions.dates import days_ago, month_of, months_ago, year_span
from lapel.functions.money import mean, money, ratio, share, total
from lapel.sources.star import Day, Star, day


def _sum(name: str) -> Column:
    return money(total("total_amount")).alias(name)


def _mean(name: str = "avg_order_value") -> Column:
    return money(mean("total_amount")).alias(name)


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _buyers(name: str) -> Column:
    return F.count_distinct("client_id").alias(name)


def revenue_ytd(star: Star, as_of: date, name: str = "total_revenue_ytd") -> DataFrame:
    """Revenue of the calendar year of ``as_of``; one row, NULL if there were no sales."""
    return star.sales("total_amount", **year_span(as_of.year)).agg(_sum(name))


def _by_store(star: Star, keep: Sequence[str], measures: Sequence[Column], **span: Day) -> DataFrame:
    sums = star.sales("store_id", "client_id", "total_amount", **span).groupBy("store_id").agg(*measures)
    return star.stores("store_id", *keep).join(sums, "store_id")


def revenue_by_store_12m(star: Star, as_of: date) -> DataFrame:
    """The last 12 months, counted as ``transaction_date >= as_of - 365``."""
    measures = [_sum("revenue"), _buyers("unique_clients"), _mean()]
    out = _by_store(star, ["store_name", "city", "region"], measures, since=days_ago(as_of, 365))
    return out.orderBy(F.desc("revenue"), "store_id").drop("store_id")


def revenue_by_store_between(star: Star, end: date, days: int = 365) -> DataFrame:
    """``days`` days up to and including ``end``, unrounded, rows without store or amount left out."""
    span = {"since": days_ago(end, days - 1), "before": F.date_add(F.lit(end), 1)}
    rows = star.sales("store_id", "total_amount", **span)
    rows = rows.filter(F.col("store_id").isNotNull() & F.col("total_amount").isNotNull())
    sums = rows.groupBy("store_id").agg(total("total_amount").cast("double").alias("revenue_last_12_months"))
    out = sums.join(star.stores("store_id", "store_name"), "store_id")
    out = out.select("store_id", "store_name", "revenue_last_12_months")
    return out.orderBy(F.desc("revenue_last_12_months"), "store_id")


def revenue_by_store_ytd(star: Star, as_of: date) -> DataFrame:
    measures = [_sum("revenue"), _buyers("unique_clients"), _mean(), _rows("transaction_count")]
    out = _by_store(star, ["store_name", "city", "region"], measures, **year_span(as_of.year))
    return out.orderBy(F.desc("revenue"), "store_id").drop("store_id")


def revenue_by_period(star: Star, region: str, start: Day, end: Day) -> DataFrame:
    """Store figures for one region, or for 'ALL', between two dates, both included. Dates may be ISO strings."""
    rows = star.sales(
        "store_id", "client_id", "total_amount", since=day(start), before=F.date_add(day(end), 1)
    )
    stores = star.stores("store_id", "store_name", "city", "region")
    if region != "ALL":
        stores = stores.filter(F.col("region") == region)
    measures = [_sum("total_revenue"), _rows("transaction_count"), _buyers("unique_clients"), _mean()]
    sums = rows.join(stores.select("store_id"), "store_id", "left_semi").groupBy("store_id").agg(*measures)
    out = stores.join(sums, "store_id")
    return out.select("store_name", "city", "total_revenue", "transaction_count", "unique_clients", "avg_order_value")


def best_stores(star: Star, n: int = 1) -> DataFrame:
    """The stores with the most revenue of all time."""
    sums = star.sales("store_id", "total_amount").groupBy("store_id").agg(_sum("revenue"))
    out = star.stores("store_id", "store_name", "city").join(sums, "store_id")
    return out.orderBy(F.desc("revenue"), "store_id").limit(n).select("store_name", "city", "revenue")


def _in_cities(star: Star, rows: DataFrame, cities: Sequence[str]) -> DataFrame:
    wanted = star.stores("store_id", "city").filter(F.col("city").isin(*cities))
    return rows.join(wanted, "store_id")


def city_compare(star: Star, cities: Sequence[str], as_of: date, ids_repeat: bool = False) -> DataFrame:
    """Figures per city for the past year.

    A transaction id is the key of the fact, so distinct ids are rows. ``ids_repeat`` counts them distinctly all
    the same, for data where they are not; that reads and shuffles every id.

    One pass over the year: clients and stores are counted by bitmaps, which rows are not multiplied for.
    """
    extra = ["transaction_id"] if ids_repeat else []
    rows = star.sales("store_id", "client_id", "total_amount", *extra, since=days_ago(as_of, 365))
    ids = {"unique_clients": "client_id", "store_count": "store_id", **{"transactions": c for c in extra}}
    figures = distinct_counts(_in_cities(star, rows, cities), ["city"], ids, "total_amount")
    out = figures.select(
        "city",
        F.col("transactions" if ids_repeat else "n_rows").alias("transactions"),
        "unique_clients",
        money("total").alias("total_revenue"),
        money(ratio(F.col("total"), F.col("valued"))).alias("avg_order_value"),
        "store_count",
    )
    return out.orderBy(F.desc("total_revenue"), "city")


def city_revenue(star: Star, cities: Sequence[str]) -> DataFrame:
    rows = star.sales("store_id", "total_amount")
    out = _in_cities(star, rows, cities).groupBy("city").agg(_sum("revenue"))
    return out.orderBy(F.desc("revenue"), "city")


def _with_product(star: Star, rows: DataFrame, *attrs: str) -> DataFrame:
    return rows.join(star.products("product_id", *attrs), "product_id")


def top_categories(star: Star, n: int | None = 5) -> DataFrame:
    """Best-selling categories; ``units_sold`` is the number of sales, as the question defines it."""
    rows = _with_product(star, star.sales("product_id", "total_amount"), "category")
    out = rows.groupBy("category").agg(_rows("units_sold"), _sum("total_revenue"), _mean())
    out = out.orderBy(F.desc("total_revenue"), "category")
    return out if n is None else out.limit(n)


def aov_by_category(star: Star) -> DataFrame:
    rows = _with_product(star, star.sales("product_id", "total_amount"), "category")
    out = rows.groupBy("category").agg(
        _mean(),
        money(F.min("total_amount")).alias("min_sale"),
        money(F.max("total_amount")).alias("max_sale"),
        _rows("total_transactions"),
    )
    return out.orderBy(F.desc("avg_order_value"), "category")


def revenue_by_brand(star: Star) -> DataFrame:
    rows = _with_product(star, star.sales("product_id", "client_id", "total_amount"), "brand")
    out = rows.groupBy("brand").agg(_rows("transactions"), _sum("total_revenue"), _mean(), _buyers("unique_buyers"))
    return out.orderBy(F.desc("total_revenue"), "brand")


def top_products(star: Star, n: int = 5) -> DataFrame:
    """Products by revenue. Grouped by id: two products of one name stay two."""
    sums = star.sales("product_id", "total_amount").groupBy("product_id").agg(_sum("revenue"))
    named = star.products("product_id", "product_name", "brand", "category").join(sums, "product_id")
    out = named.orderBy(F.desc("revenue"), "product_id").limit(n)
    return out.select("product_name", "brand", "category", "revenue")


def _percent(hits: Column) -> Column:
    """Hits in percent of the rows, rounded half-up to one decimal."""
    return F.round(share(hits * 100, F.count(F.lit(1))).cast("decimal(30,10)"), 1).cast("double")


def discount_usage(star: Star) -> DataFrame:
    """Share of sales with a discount, and the mean discount where there is one (one decimal each)."""
    hit = F.col("discount_pct") > 0
    hits = F.sum(F.when(hit, 1).otherwise(0))
    return star.sales("discount_pct").agg(
        _rows("total_transactions"),
        hits.alias("discounted_transactions"),
        _percent(hits).alias("discount_rate_pct"),
        F.round(mean(F.when(hit, F.col("discount_pct"))), 1).cast("double").alias("avg_discount_when_applied"),
    )


def monthly_trend(star: Star, as_of: date, months: int = 24) -> DataFrame:
    """Months since ``as_of`` minus ``months``: the first one may be partial, months without sales are absent."""
    rows = star.sales("transaction_date", "client_id", "total_amount", since=months_ago(as_of, months))
    out = rows.groupBy(month_of("transaction_date").alias("month")).agg(
        _sum("monthly_revenue"), _buyers("unique_clients"), _rows("transaction_count")
    )
    return out.orderBy("month")


def return_rate_by(star: Star, attr: str = "category") -> DataFrame:
    """Returned share of all rows by product attribute, in percent with one decimal."""
    rows = _with_product(star, star.transactions("product_id", "is_return"), attr)
    back = F.sum(F.when(F.col("is_return"), 1).otherwise(0))
    out = rows.groupBy(attr).agg(
        _rows("total_transactions"), back.alias("returns"), _percent(back).alias("return_rate_pct")
    )
    return out.orderBy(F.desc("return_rate_pct"), attr)
