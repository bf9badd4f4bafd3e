"""Client questions: tiers, VIPs, inactivity, books of business, cross-sell, top lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapel.functions.classify import HOUSE, Bounds, is_vip, is_vvip, membership_tier, risk_tier, tier_rank
from lapel.functions.dates import days_since, inactive_for, year_span
from lapel.functions.money import mean_of_totals, money, total_of_totals
from lapel.functions.names import full_name
from lapel.operators.ranking import number_rows, top_in_group
from lapel.session import id_set, written_once
from lapel.sources.star import Star

NAME = ("first_name", "last_name")


def _name(out: str = "client_name") -> Column:
    return full_name(*NAME).alias(out)


def _spend() -> Column:
    return money("lifetime_spend").alias("lifetime_spend")


def _exact_spend() -> Column:
    return F.col("lifetime_spend").cast("double").alias("lifetime_spend")


def _advisor_names(star: Star, out: str) -> DataFrame:
    return star.advisors("advisor_id", *NAME).select("advisor_id", full_name(*NAME).alias(out))


def _store_names(star: Star) -> DataFrame:
    return star.stores("store_id", "store_name").withColumnRenamed("store_id", "preferred_store_id")


def clients_by_tier(star: Star) -> DataFrame:
    """Client count and spend per tier, best tier first; unknown tiers sort with the lowest."""
    out = star.clients("membership_tier", "lifetime_spend").groupBy("membership_tier").agg(
        F.count(F.lit(1)).alias("client_count"),
        money(mean_of_totals("lifetime_spend")).alias("avg_lifetime_spend"),
        money(total_of_totals("lifetime_spend")).alias("total_lifetime_spend"),
    )
    return out.orderBy(tier_rank(F.col("membership_tier")), "membership_tier")


def vip_by_city(star: Star) -> DataFrame:
    vips = star.clients("city", "province", "is_vip").filter("is_vip")
    out = vips.groupBy("city", "province").agg(F.count(F.lit(1)).alias("vip_client_count"))
    return out.orderBy(F.desc("vip_client_count"), "city", "province")


def top_clients(star: Star, as_of: date, n: int = 10) -> DataFrame:
    """Clients with the highest spend; clients without advisor or store are not listed."""
    cols = ("membership_tier", "client_segment", "is_vip", "lifetime_spend", "last_purchase_date")
    rows = star.clients("client_id", *NAME, "advisor_id", "preferred_store_id", *cols)
    rows = rows.withColumn("client_name", full_name(*NAME)).drop(*NAME)
    rows = rows.join(_advisor_names(star, "advisor"), "advisor_id").join(_store_names(star), "preferred_store_id")
    out = rows.orderBy(F.desc("lifetime_spend"), "client_id").limit(n)
    return out.select(
        "client_id",
        "client_name",
        "membership_tier",
        "client_segment",
        "is_vip",
        _spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_since_last_purchase"),
        "advisor",
        "store_name",
    )


def inactive_high_value(star: Star, as_of: date, days: int = 180, min_spend: float = 10_000) -> DataFrame:
    """Spend above ``min_spend`` and last purchase more than ``days`` days ago, both strictly."""
    cols = ("email", "membership_tier", "lifetime_spend", "last_purchase_date", "preferred_category")
    rows = star.clients("client_id", *NAME, "advisor_id", "preferred_store_id", *cols)
    rows = rows.filter((F.col("lifetime_spend") > min_spend) & inactive_for("last_purchase_date", as_of, days))
    rows = rows.withColumn("client_name", full_name(*NAME)).drop(*NAME)
    rows = rows.join(_advisor_names(star, "assigned_advisor"), "advisor_id")
    rows = rows.join(_store_names(star), "preferred_store_id")
    return rows.orderBy(F.desc("lifetime_spend"), "client_id").select(
        "client_name",
        "email",
        "membership_tier",
        _spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_since_last_purchase"),
        "preferred_category",
        "assigned_advisor",
        "store_name",
    )


def _buyer_ids(star: Star, category: str, year: int) -> DataFrame:
    rows = star.sales("product_id", "client_id", **year_span(year))
    wanted = star.products("product_id", "category").filter(F.col("category") == category)
    return rows.join(wanted.select("product_id"), "product_id", "left_semi").select("client_id")


def category_buyers(star: Star, category: str, year: int) -> DataFrame:
    """Clients who bought from a category in a year. The buyers' ids are written once, then meet the clients."""
    ids = id_set(_buyer_ids(star, category, year))
    out = star.clients("client_id", *NAME, "email", "membership_tier", "last_purchase_date", ids=ids)
    return out.select("client_id", _name(), "email", "membership_tier", "last_purchase_date")


def buyers_now_inactive(star: Star, buyers: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """The follow-up "of those, who has not bought for ``days`` days": takes the first answer's client ids, written once."""
    cols = ("email", "membership_tier", "lifetime_spend", "last_purchase_date")
    rows = star.clients("client_id", *NAME, "advisor_id", *cols, ids=id_set(buyers.select("client_id")))
    rows = rows.filter(inactive_for("last_purchase_date", as_of, days))
    rows = rows.withColumn("client_name", full_name(*NAME)).drop(*NAME)
    rows = rows.join(_advisor_names(star, "advisor"), "advisor_id")
    return rows.orderBy(F.desc("lifetime_spend"), "client_id").select(
        "client_name",
        "email",
        "membership_tier",
        _exact_spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_inactive"),
        "advisor",
    )


def category_buyers_now_inactive(star: Star, category: str, year: int, as_of: date, days: int = 90) -> DataFrame:
    return buyers_now_inactive(star, _buyer_ids(star, category, year), as_of, days)


def advisor_at_risk_book(star: Star, first: str, last: str, as_of: date) -> DataFrame:
    """At-risk clients in the book of one advisor, by name."""
    cols = ("email", "membership_tier", "client_segment", "lifetime_spend", "last_purchase_date", "preferred_category")
    who = star.advisors("advisor_id", *NAME).filter((F.col("first_name") == first) & (F.col("last_name") == last))
    book = star.clients("client_id", "advisor_id").join(who.select("advisor_id"), "advisor_id", "left_semi")
    rows = star.clients("client_id", *NAME, "advisor_id", *cols, ids=book.select("client_id"))
    rows = rows.filter(F.col("client_segment") == "At-Risk")
    return rows.orderBy(F.desc("lifetime_spend"), "client_id").select(
        _name(),
        "email",
        "membership_tier",
        _spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_since_purchase"),
        "preferred_category",
    )


def bought_x_never_y(
    star: Star,
    brand: str,
    category: str,
    never: str,
    never_brand: str | None = None,
    method: str = "anti",
    client_ids: bool = False,
) -> DataFrame:
    """Clients who bought ``brand`` in ``category`` and never category ``never`` (of ``never_brand`` if given).

    One pass over the fact finds them; each sale of either kind marks its client, and the marks are combined map-side.
    ``anti`` and ``except`` (the difference of the two sets of ids) are clients with the first mark and not the second.
    ``not_in``: the same, but as ``NOT IN`` has it a sale of ``never`` without client empties the answer. The clients
    found, and that mark, are written once.
    """
    is_x = (F.col("brand") == brand) & (F.col("category") == category)
    is_y = F.col("category") == never
    if never_brand is not None:
        is_y = is_y & (F.col("brand") == never_brand)
    items = star.products("product_id", "brand", "category").filter(is_x | is_y)
    either = [F.coalesce(flag, F.lit(False)).alias(name) for flag, name in ((is_x, "x"), (is_y, "y"))]
    items = items.select("product_id", *either)
    rows = star.sales("product_id", "client_id").join(items, "product_id")
    marks = rows.groupBy("client_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    found = marks.filter(F.when(F.col("client_id").isNull(), F.col("y")).otherwise(F.col("x") & ~F.col("y")))
    if method == "not_in":
        found = written_once(found.select("client_id"))
        found = found.filter(F.lit(found.filter(F.col("client_id").isNull()).isEmpty()))
    ids = id_set(found.select("client_id"))
    cols = ("membership_tier", "lifetime_spend", "preferred_category")
    people = star.clients("client_id", *NAME, "advisor_id", *cols, ids=ids)
    people = people.withColumn("client_name", full_name(*NAME)).drop(*NAME)
    out = people.join(_advisor_names(star, "advisor"), "advisor_id").orderBy(F.desc("lifetime_spend"), "client_id")
    keep = ["client_id"] if client_ids else []
    return out.select(*keep, "client_name", "membership_tier", _spend(), "preferred_category", "advisor")


def at_risk_clients(star: Star, as_of: date) -> DataFrame:
    """Every client of the at-risk segment (which by definition holds VIPs)."""
    cols = ("email", "membership_tier", "client_segment", "lifetime_spend", "last_purchase_date", "preferred_category")
    rows = star.clients("client_id", *NAME, "advisor_id", "preferred_store_id", *cols)
    rows = rows.filter(F.col("client_segment") == "At-Risk")
    rows = rows.withColumn("client_name", full_name(*NAME)).drop(*NAME)
    rows = rows.join(_advisor_names(star, "advisor_name"), "advisor_id")
    rows = rows.join(_store_names(star), "preferred_store_id")
    return rows.orderBy(F.desc("lifetime_spend"), "client_id").select(
        "client_id",
        "client_name",
        "email",
        "membership_tier",
        _spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_since_purchase"),
        "preferred_category",
        "advisor_name",
        "store_name",
    )


def vip_count(star: Star) -> DataFrame:
    return star.clients("is_vip").filter("is_vip").agg(F.count(F.lit(1)).alias("vip_client_count"))


def at_risk_count(star: Star) -> DataFrame:
    rows = star.clients("client_segment").filter(F.col("client_segment") == "At-Risk")
    return rows.agg(F.count(F.lit(1)).alias("at_risk_count"))


def at_risk_vips(star: Star, as_of: date) -> DataFrame:
    """Clients both VIP and at risk, spend unrounded."""
    cols = ("email", "is_vip", "client_segment", "lifetime_spend", "last_purchase_date")
    rows = star.clients("client_id", *NAME, *cols)
    rows = rows.filter(F.col("is_vip") & (F.col("client_segment") == "At-Risk"))
    return rows.orderBy(F.desc("lifetime_spend"), "client_id").select(
        _name(),
        "email",
        _exact_spend(),
        "last_purchase_date",
        days_since("last_purchase_date", as_of).alias("days_inactive"),
    )


def inactive_clients(star: Star, as_of: date, days: int = 180) -> DataFrame:
    """Everybody whose last purchase is more than ``days`` days ago, longest first."""
    rows = star.clients("client_id", *NAME, "email", "last_purchase_date")
    rows = rows.filter(inactive_for("last_purchase_date", as_of, days))
    return rows.orderBy("last_purchase_date", "client_id").select(
        _name(), "email", "last_purchase_date", days_since("last_purchase_date", as_of).alias("days_inactive")
    )


def client_preview(star: Star, n: int = 10) -> DataFrame:
    """The top VIP rows as the current viewer sees them; ask it of a governed star for the masked form."""
    cols = ("email", "city", "membership_tier", "is_vip", "lifetime_spend", "client_segment")
    rows = star.clients("client_id", *NAME, *cols).filter("is_vip")
    out = rows.orderBy(F.desc("lifetime_spend"), "client_id").limit(n)
    return out.select("client_id", _name(), "email", "city", "membership_tier", _exact_spend(), "client_segment")


def with_risk_tier(clients: DataFrame, as_of: date, bounds: Bounds = HOUSE) -> DataFrame:
    """Add the risk label to client rows: a projection, where the table function would be a lateral join."""
    return clients.withColumn(
        "risk_tier", risk_tier(days_since("last_purchase_date", as_of), F.col("lifetime_spend"), bounds)
    )


def classify_client_risk(star: Star, as_of: date, bounds: Bounds = HOUSE) -> DataFrame:
    """days_since_purchase, lifetime_spend and risk label of every client."""
    rows = with_risk_tier(star.clients("client_id", "lifetime_spend", "last_purchase_date"), as_of, bounds)
    days = days_since("last_purchase_date", as_of).alias("days_since_purchase")
    return rows.select("client_id", days, _spend(), "risk_tier")


def classify_vip_clients(star: Star, as_of: date, bounds: Bounds = HOUSE, n: int = 10) -> DataFrame:
    rows = star.clients("client_id", *NAME, "is_vip", "lifetime_spend", "last_purchase_date").filter("is_vip")
    out = with_risk_tier(rows, as_of, bounds).orderBy(F.desc("lifetime_spend"), "client_id").limit(n)
    return out.select(_name(), _exact_spend(), "last_purchase_date", "risk_tier")


RANKED = ("email", "membership_tier", "lifetime_spend", "total_orders", "last_purchase_date", "preferred_store_id")


def _ranked(rows: DataFrame, as_of: date, bounds: Bounds, top_n: int | None) -> DataFrame:
    how = ("lifetime_spend", "client_id")
    if top_n is None:
        rows = number_rows(rows, *how, ["preferred_store_id"])
    else:
        rows = top_in_group(rows, ["preferred_store_id"], *how, top_n)
    return with_risk_tier(rows, as_of, bounds).select(
        "preferred_store_id",
        _name(),
        "email",
        "membership_tier",
        _spend(),
        "total_orders",
        "last_purchase_date",
        "risk_tier",
        "rank",
    )


def get_top_clients(
    star: Star, store_id: int, as_of: date, bounds: Bounds = HOUSE, top_n: int | None = None
) -> DataFrame:
    """Clients of one store ranked by spend with their risk label; all of them unless ``top_n`` is given.

    Numbering all writes the rows to the scratch folder.
    """
    book = star.clients("client_id", "preferred_store_id").filter(F.col("preferred_store_id") == store_id)
    rows = star.clients("client_id", *NAME, *RANKED, ids=book.select("client_id"))
    return _ranked(rows, as_of, bounds, top_n).drop("preferred_store_id")


def top_clients_by_store(star: Star, as_of: date, bounds: Bounds = HOUSE, top_n: int | None = None) -> DataFrame:
    """The same for all stores at once."""
    return _ranked(star.clients("client_id", *NAME, *RANKED), as_of, bounds, top_n)


def register_ranked_clients(star: Star, as_of: date, bounds: Bounds = HOUSE, prefix: str = "") -> None:
    """The SQL table function get_ranked_clients(p_store_id): ``get_top_clients`` of stores of any size, as of now.

    All clients are numbered once, in many tasks, and written; a call is a filter, and ``WHERE rank <= n`` reaches the
    scan. Clients that come later are not in it: register it again.
    """
    top_clients_by_store(star, as_of, bounds).createOrReplaceTempView(f"{prefix}ranked_clients")
    star.spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}get_ranked_clients(p_store_id INT)
        RETURNS TABLE (client_name STRING, email STRING, membership_tier STRING, lifetime_spend DOUBLE,
                       total_orders INT, last_purchase_date DATE, risk_tier STRING, rank INT)
        RETURN
          SELECT client_name, email, membership_tier, lifetime_spend, total_orders, last_purchase_date, risk_tier,
                 CAST(rank AS INT)
          FROM {prefix}ranked_clients WHERE preferred_store_id = p_store_id""")


def tier_table(star: Star, bounds: Bounds = HOUSE) -> DataFrame:
    """client_id, spend, derived tier."""
    rows = star.clients("client_id", "lifetime_spend")
    return rows.select("client_id", _spend(), membership_tier(F.col("lifetime_spend"), bounds).alias("tier"))


def vip_flags(star: Star, bounds: Bounds = HOUSE) -> DataFrame:
    """client_id, is_vip (spend or stored flag), is_vvip."""
    rows = star.clients("client_id", "lifetime_spend", "is_vip")
    vip = is_vip(F.col("lifetime_spend"), F.col("is_vip"), bounds)
    return rows.select("client_id", vip.alias("is_vip"), is_vvip(vip, F.col("lifetime_spend"), bounds).alias("is_vvip"))
