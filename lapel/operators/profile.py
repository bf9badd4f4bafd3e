"""Client profiles and segments derived from the fact."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lapel.functions.classify import HOUSE, Bounds, is_vip, segment
from lapel.functions.dates import days_since
from lapel.functions.money import SUM, money, ratio, split_sums, whole
from lapel.sources.star import Star

BASIC = ("lifetime_spend", "total_orders", "avg_order_value", "first_purchase_date", "last_purchase_date")

#: Low bits of a packed count, for the category's number.
NUMBER = 20


class Categories:
    """Categories by number, from 1 on in order of name.

    A number is a long, so sums per category stay in hash aggregation and shuffle no text. The names are one row, an
    array: as many as there are categories, fewer than 2**20, whatever the number of products and sales.
    """

    def __init__(self, rows: DataFrame) -> None:
        names = rows.filter(F.col("category").isNotNull()).select("category").distinct()
        self.names = names.agg(F.array_sort(F.collect_list("category")).alias("names"))

    def numbered(self, rows: DataFrame) -> DataFrame:
        """The rows with their category's number in place of its name."""
        numbers = self.names.select(F.posexplode("names").alias("_number", "category"))
        return rows.join(numbers, "category", "left").withColumn("category", (F.col("_number") + 1).cast("long")).drop("_number")

    @staticmethod
    def packed(rows: Column) -> Column:
        """Rows of a category and its number in one long: the greatest is of the most rows, then of the first name."""
        return F.shiftleft(rows, NUMBER) + F.lit(1 << NUMBER) - F.col("category")

    def name(self, packed: Column) -> Column:
        return F.element_at(self.names.scalar(), (F.lit(1 << NUMBER) - packed.bitwiseAND(F.lit((1 << NUMBER) - 1))).cast("int"))


#: What partial profiles hold beside their keys. All of it can be added up again, in any order.
SUMS = ("high", "low", "large", "valued", "n", "first_day", "last_day")


def _summed(rows: DataFrame, by: Sequence[str], **more: Column) -> DataFrame:
    parts = {**split_sums("total_amount"), "valued": F.count("total_amount"), "n": F.count(F.lit(1)), **more}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])


def _merged(level: DataFrame, by: Sequence[str], **more: Column) -> DataFrame:
    merged = {
        "high": F.sum("high"),
        "low": F.sum("low"),
        "large": F.sum("large").cast(SUM),
        "valued": F.sum("valued"),
        "n": F.sum("n"),
        "first_day": F.min("first_day"),
        "last_day": F.max("last_day"),
    }
    return level.groupBy(*by).agg(*[c.alias(n) for n, c in {**merged, **more}.items()])


def _finished(level: DataFrame, categories: Categories | None, gap: bool) -> DataFrame:
    spend = whole(F.col("high"), F.col("low"), F.col("large"))
    return level.select(
        "client_id",
        spend.alias("lifetime_spend"),
        F.col("n").alias("total_orders"),
        ratio(spend, F.col("valued")).alias("avg_order_value"),
        F.col("first_day").alias("first_purchase_date"),
        F.col("last_day").alias("last_purchase_date"),
        *["gap"] * gap,
        *([categories.name(F.col("favourite")).alias("preferred_category")] if categories is not None else []),
    )


def profile(sales: DataFrame, products: DataFrame | None = None, gap: bool = False) -> DataFrame:
    """One row per client from (client_id, transaction_date, total_amount[, product_id]) rows.

    ``products`` (product_id, category) adds preferred_category, the one bought most often (ties: first by name).
    ``gap`` adds days between the last two purchase days.

    The rows are first added up per client, day and category number. That is combined map-side, so a client with a
    third of all rows reaches the window as at most one row per day and category. The window, the mode (the greatest of
    packed longs) and the totals then share one hash partitioning by client.
    """
    known = sales.filter(F.col("client_id").isNotNull())
    categories = None if products is None else Categories(products)
    if categories is not None:
        known = known.join(categories.numbered(products), "product_id", "left")
    fine = ["client_id"] + ["day"] * gap + ["category"] * (categories is not None)
    if gap:
        level, last = _summed(known.withColumn("day", F.unix_date("transaction_date")), fine), {"gap": F.max_by("gap", "last_day")}
        earlier = W.partitionBy("client_id").orderBy("day").rangeBetween(W.unboundedPreceding, -1)
        level = level.withColumn("gap", F.col("day") - F.max("day").over(earlier))
        level = level.withColumns({c: F.date_from_unix_date("day") for c in ("first_day", "last_day")})
        if categories is not None:
            level = _merged(level, ["client_id", "category"], **last)
    else:
        level, last = _summed(known, fine, first_day=F.min("transaction_date"), last_day=F.max("transaction_date")), {}
    if categories is not None:
        last["favourite"] = F.max(Categories.packed(F.col("n")))
    if len(fine) > 1:
        level = _merged(level, ["client_id"], **last)
    return _finished(level, categories, gap)


def partial_profiles(star: Star) -> DataFrame:
    """sale_month, client_id, category, the sums, and the last two days (last_day, prior_day) of a star's sales.

    A row per month, client and category. Rows of several batches, of one month too, add up to the profile, so an
    append writes the rows of its own sales and reads and touches no others. Categories are those of the day of writing.

    A cell's days are bits of one int, so its last two days come out of the same pass as its sums, with one shuffle of
    the sales, already combined in the map tasks, and no window.
    """
    sales = star.sales("client_id", "transaction_date", "total_amount", "product_id").filter(F.col("client_id").isNotNull())
    sales = sales.join(star.products("product_id", "category"), "product_id", "left")
    one = F.call_function("shiftleft", F.lit(1), F.dayofmonth("transaction_date") - 1)
    cell = ["sale_month", "client_id", "category"]
    cells = _summed(sales.withColumn("sale_month", F.trunc("transaction_date", "MM")), cell, days=F.bit_or(one))
    days = F.col("days")
    before = days - F.call_function("shiftleft", F.lit(1), F.length(F.bin(days)) - 1)
    held = {
        "first_day": _highest_day(days.bitwiseAND(-days)),
        "last_day": _highest_day(days),
        "prior_day": F.when(before != 0, _highest_day(before)),
    }
    return cells.withColumns(held).select("client_id", "category", *SUMS, "prior_day", "sale_month")


def _highest_day(days: Column) -> Column:
    """The last of a month's days, which are bits of an int."""
    return F.date_add("sale_month", F.length(F.bin(days)) - 1)


def merged_profiles(parts: DataFrame, category: bool = False, gap: bool = False) -> DataFrame:
    """What ``profile`` says of the same sales, from partial profiles: no sale is read again."""
    last, names = {}, None
    if gap:
        latest = F.max("last_day").over(W.partitionBy("client_id"))
        parts = parts.withColumn("latest", latest)
        before = F.when(F.col("last_day") < F.col("latest"), F.col("last_day")).otherwise(F.col("prior_day"))
        last["prior_day"] = F.max(before)
    if category:
        names = Categories(parts)
        # partial profiles of a client are few, a row per month, category and batch: one shuffle, by client, does for both sums
        numbered = names.numbered(parts) if gap else names.numbered(parts).repartition("client_id")
        level = _merged(numbered, ["client_id", "category"], **last)
        last["favourite"] = F.max(Categories.packed(F.col("n")))
        last |= {"prior_day": F.max("prior_day")} if gap else {}
    else:
        level = parts
    level = _merged(level, ["client_id"], **last)
    if gap:
        level = level.withColumn("gap", F.datediff("last_day", "prior_day"))
    return _finished(level, names, gap)


def profiles(star: Star, category: bool = False, gap: bool = False) -> DataFrame:
    """The profile of every buyer: from the partial profiles that the star keeps, else from its sales."""
    parts = star.profile_parts()
    if parts is not None:
        return merged_profiles(parts, category, gap)
    sales = star.sales("client_id", "transaction_date", "total_amount", *["product_id"] * category)
    return profile(sales, star.products("product_id", "category") if category else None, gap)


def client_profile(star: Star) -> DataFrame:
    """lifetime_spend, total_orders, avg_order_value, first / last purchase, preferred_category per buyer."""
    out = profiles(star, category=True)
    return out.select(
        "client_id",
        money("lifetime_spend").alias("lifetime_spend"),
        "total_orders",
        money("avg_order_value").alias("avg_order_value"),
        "first_purchase_date",
        "last_purchase_date",
        "preferred_category",
    )


def segment_clients(star: Star, as_of: date, bounds: Bounds = HOUSE) -> DataFrame:
    """client_id, days_since_last, total_orders, gap, is_vip, client_segment from the sales, or partial profiles, alone."""
    base = profiles(star, gap=True).select(
        "client_id",
        days_since("last_purchase_date", as_of).alias("days_since_last"),
        "total_orders",
        "gap",
        is_vip(F.col("lifetime_spend"), bounds=bounds).alias("is_vip"),
    )
    label = segment(F.col("days_since_last"), F.col("total_orders"), F.col("gap"), F.col("is_vip"), bounds)
    return base.withColumn("client_segment", label)
