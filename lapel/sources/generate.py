"""Distributed generators of clients and transactions for the star.

Every value is a function of the row's key, so any partition can make its rows alone, in any order, again and again.
Draws are integer arithmetic modulo a prime (cheap, in generated code, the same in any SQL engine).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.functions.classify import HOUSE, membership_tier
from lapel.operators.ranking import running_start
from lapel.sources import catalogue as C

PRIME = 2_147_483_647
ORDERS = 1 << 20  # of one client, before two of them would share a key


def draw(key: Column, salt: int) -> Column:
    """A number from 0 to PRIME - 1 that looks random in ``key``."""
    p = F.lit(PRIME).cast("long")
    x = F.pmod(F.pmod(key, p) + F.call_function("div", key, p) * 7919 + salt * 1_000_003, p)
    x = F.pmod(x * 48_271, p)
    x = F.pmod(x * x + salt, p)
    return F.pmod(x * 69_621, p)


def draw_int(key: Column, salt: int, low: Column | int, high: Column | int) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.pmod(draw(key, salt), (high - low + 1).cast("long"))).cast("int")


def _pick(values: tuple, slot: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (slot + 1).cast("int"))


def _by_segment(name: str) -> tuple[Column, Column]:
    """Low and high of a range, by the row's segment."""
    low, high = F.lit(None), F.lit(None)
    for segment, ranges in C.SEGMENT_RANGES.items():
        here = F.col("client_segment") == segment
        low = F.when(here, ranges[name][0]).otherwise(low)
        high = F.when(here, ranges[name][1]).otherwise(high)
    return low, high


def gen_clients(
    spark: SparkSession,
    n: int = C.CLIENTS,
    today: date = C.TODAY,
    ids: DataFrame | None = None,
    seed: int = 42,
    partitions: int | None = None,
) -> DataFrame:
    """Clients 1..n in ``partitions`` partitions, or one for each ``client_id`` of ``ids``. Money is drawn and divided in whole cents."""
    made = spark.range(1, n + 1, 1, partitions).withColumnRenamed("id", "client_id")
    keys = made if ids is None else ids.select("client_id")
    i = F.col("client_id").cast("long")
    salt = seed * 100
    place = F.pmod(i, F.lit(len(C.HOMES)))
    staff = F.array(*[F.array(*[F.lit(a) for a in C.ADVISORS_OF_STORE[h[2]]]) for h in C.HOMES])
    team = F.element_at(staff, (place + 1).cast("int"))
    df = keys.select(
        i.cast("int").alias("client_id") if ids is None else F.col("client_id"),
        _pick(C.FIRST_NAMES, F.pmod(i, F.lit(len(C.FIRST_NAMES)))).alias("first_name"),
        _pick(C.LAST_NAMES, F.pmod(i * 7, F.lit(len(C.LAST_NAMES)))).alias("last_name"),
        _pick(tuple(h[0] for h in C.HOMES), place).alias("city"),
        _pick(tuple(h[1] for h in C.HOMES), place).alias("province"),
        _pick(tuple(h[2] for h in C.HOMES), place).alias("preferred_store_id"),
        F.element_at(team, (F.pmod(i, F.size(team)) + 1).cast("int")).alias("advisor_id"),
        _pick(C.SEGMENT_CYCLE, F.pmod(i, F.lit(len(C.SEGMENT_CYCLE)))).alias("client_segment"),
        _pick(C.CATEGORIES, F.pmod(i, F.lit(len(C.CATEGORIES)))).alias("preferred_category"),
    )
    spend_low, spend_high = _by_segment("spend")
    cents = draw_int(i, salt + 1, spend_low * 100, spend_high * 100)
    df = df.select(
        "*",
        cents.alias("cents"),
        draw_int(i, salt + 2, *_by_segment("orders")).alias("total_orders"),
        F.date_sub(F.lit(today), draw_int(i, salt + 3, *_by_segment("last_days"))).alias("last_purchase_date"),
        F.date_sub(F.lit(today), draw_int(i, salt + 4, *_by_segment("first_days"))).alias("first_purchase_date"),
    )
    spend = F.col("cents") / 100.0
    order_cents = F.expr("(cast(cents as bigint) * 2 + total_orders) div (2 * total_orders)")
    flagged = (F.pmod(i, F.lit(4)) == 0) | (F.pmod(i, F.lit(7)) == 0) | (F.col("client_segment") == "At-Risk")
    login = F.format_string(f"%s.%s%d@{C.CLIENT_DOMAIN}", F.lower("first_name"), F.lower("last_name"), i)
    return df.select(
        "client_id",
        "first_name",
        "last_name",
        login.alias("email"),
        "city",
        "province",
        "preferred_store_id",
        "advisor_id",
        membership_tier(spend).alias("membership_tier"),
        (flagged | (spend > HOUSE.vip)).alias("is_vip"),
        "client_segment",
        spend.alias("lifetime_spend"),
        "last_purchase_date",
        "first_purchase_date",
        "total_orders",
        (order_cents / 100.0).alias("avg_order_value"),
        "preferred_category",
    )


def gen_transactions(clients: DataFrame, products: DataFrame, today: date = C.TODAY, seed: int = 42) -> DataFrame:
    """One row per order of every client, numbered 1.. in client order.

    ``products`` holds ``product_no`` 0..k-1 next to ``product_id`` and ``unit_price``. The ids come from a running
    sum over runs of clients, so no task sees all of them; everything else is a projection after ``explode``.
    """
    salt = seed * 100 + 50
    amount = products.agg(F.count(F.lit(1))).scalar()
    base = clients.select(
        "client_id",
        "preferred_store_id",
        "advisor_id",
        "total_orders",
        "first_purchase_date",
        F.greatest(F.datediff("last_purchase_date", "first_purchase_date"), F.lit(1)).alias("days"),
    )
    base = running_start(base, "client_id", "total_orders", "ids_before")
    order = F.explode(F.sequence(F.lit(0), F.col("total_orders") - 1)).alias("o")
    rows = base.filter(F.col("total_orders") > 0).select("*", order)
    key = draw(F.col("client_id").cast("long"), salt) * ORDERS + F.col("o")
    number = F.col("ids_before") + F.col("o") + 1
    step = F.expr("cast(cast(o as bigint) * days div greatest(total_orders - 1, 1) as int)")
    drawn = F.date_add(F.date_add("first_purchase_date", step), draw_int(key, salt + 1, -5, 5))
    rows = rows.select(
        "*",
        number.alias("number"),
        F.greatest(F.least(drawn, F.lit(today)), F.col("first_purchase_date")).alias("transaction_date"),
        F.pmod(draw(key, salt + 2), amount).alias("product_no"),
        F.pmod(draw(key, salt + 3), F.lit(4)).alias("pair"),
        _pick(C.DISCOUNTS, F.pmod(draw(key, salt + 4), F.lit(len(C.DISCOUNTS)))).alias("discount_pct"),
        _pick(C.PAYMENTS, F.pmod(number, F.lit(len(C.PAYMENTS)))).alias("payment_method"),
        (F.pmod(number, F.lit(C.RETURN_EVERY)) == 0).alias("is_return"),
    )
    goods = products.select(F.col("product_no").cast("long").alias("product_no"), "product_id", "unit_price")
    rows = rows.join(goods, "product_no")
    price = F.col("unit_price")
    quantity = F.when((price <= 1000) & (F.col("pair") == 3), 2).otherwise(1)
    after_discount = F.rint(price * 100).cast("long") * quantity * (F.lit(100) - F.col("discount_pct"))
    cents = F.call_function("div", after_discount + 50, F.lit(100))
    return rows.select(
        F.format_string("TXN-%06d", "number").alias("transaction_id"),
        "transaction_date",
        "client_id",
        F.col("preferred_store_id").alias("store_id"),
        "advisor_id",
        "product_id",
        quantity.alias("quantity"),
        "unit_price",
        F.col("discount_pct").cast("double").alias("discount_pct"),
        (cents / 100.0).alias("total_amount"),
        "payment_method",
        "is_return",
    )


def sample_star(spark: SparkSession, n: int = C.CLIENTS, house: str = "", seed: int = 42) -> dict[str, DataFrame]:
    """All five tables: literal stores, advisors and products, generated clients and transactions."""
    clients = gen_clients(spark, n, seed=seed)
    tables = C.load_dims(spark, house)
    tables["clients"] = clients
    tables["transactions"] = gen_transactions(clients, C.products(spark, numbered=True), seed=seed)
    return tables
