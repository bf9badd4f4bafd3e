"""The retail star seen in an order-processing schema (customer, orders, lineitem, supplier, part, nation, region).

A line of an order is a fact row, a supplier an advisor, a nation a store and a home city, a part a product.
Client profile columns are derived from the fact.

Columns of the fact that live in ``orders`` or ``supplier`` are joined in only when asked for. These are left joins
on unique keys, which neither drop nor repeat a line, so asking for fewer columns never changes the rows. A date
bound turns the join into an inner one and reaches the scan of ``orders``.

No side is broadcast by hint: suppliers, parts and customers grow with the data. Spark compares their size with
``spark.sql.autoBroadcastJoinThreshold`` and AQE does so again at run time, splitting skewed keys when it sort-merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.functions.classify import Bounds, is_vip, membership_tier, segment
from lapel.functions.dates import days_since
from lapel.functions.money import from_units, money, ratio
from lapel.operators.profile import BASIC, profile
from lapel.session import written_once
from lapel.sources.raw import read_raw
from lapel.sources.schema import SCHEMAS
from lapel.sources.star import Star

# Orders run from 1995-01-01 to 2001-08-01; the day after is the "as of" day of this mapping.
AS_OF = date(2001, 8, 2)

# Spend quartiles of this data take the place of the house bounds.
BOUNDS = Bounds(
    platinum=1_670_000, gold=1_300_000, silver=970_000, vip=1_300_000, vvip=1_670_000, risk_spend=1_300_000
)

SPECIALIZATIONS = ("Suiting", "Casual", "Formalwear", "Tailoring", "Accessories")
DOMAIN = "example.com"
EXACT = "decimal(18,2)"

FROM_ORDERS = {"transaction_date", "client_id", "payment_method"}
#: What the fact reads of lines and orders.
LINES = (
    *("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"),
    *("o_orderdate", "o_custkey", "o_orderpriority"),
)
FROM_SUPPLIER = {"store_id"}
FROM_GAP = {"client_segment"}
FROM_PROFILE = {*BASIC, "membership_tier", "is_vip", "preferred_category", "client_segment"}


class ConformedStar(Star):
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        as_of: date = AS_OF,
        bounds: Bounds = BOUNDS,
        fact: Star | None = None,
        lines: DataFrame | None = None,
    ):
        self.spark, self.folder, self.as_of, self.bounds, self.fact, self.lines = spark, folder, as_of, bounds, fact, lines
        self._scans: dict[str, DataFrame] = {}

    def derives(self, cols: Iterable[str]) -> bool:
        return bool(FROM_PROFILE & set(cols))

    def clients(self, *cols: str, ids: DataFrame | None = None) -> DataFrame:
        return self._clients(cols or tuple(SCHEMAS["clients"].names), ids)

    def on_fact(self, stored: Star) -> Star:
        return ConformedStar(self.spark, self.folder, self.as_of, self.bounds, stored)

    def joined_once(self) -> ConformedStar:
        """The same star for several passes over the fact: the lines meet their orders now, and are written for all of them.

        Both sides of that join are large. What is written are the columns that the fact is made from, which take less
        room than the fact's own.
        """
        rows = self._with_orders().withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        return ConformedStar(self.spark, self.folder, self.as_of, self.bounds, self.fact, written_once(rows.select(*LINES)))

    def _with_orders(self) -> DataFrame:
        return self.scan("lineitem").join(self.scan("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")

    def scan(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = read_raw(self.spark, self.folder, name)
        return self._scans[name]

    def table(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        build = {
            "stores": self._stores,
            "advisors": self._advisors,
            "products": self._products,
            "clients": self._clients,
            "transactions": self._transactions,
        }[name]
        return build(tuple(cols) or tuple(SCHEMAS[name].names))

    def _transactions(self, cols: tuple[str, ...]) -> DataFrame:
        if self.fact is not None:
            return self.fact.table("transactions", cols)
        if FROM_ORDERS & set(cols):
            df = self._with_orders() if self.lines is None else self.lines
        else:
            df = self.scan("lineitem")
        if FROM_SUPPLIER & set(cols):
            df = df.join(self.scan("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")

        def discount() -> Column:
            """Hundredths of a percent."""
            return F.rint(F.col("l_discount") * 10_000).cast("long")

        made = {
            "transaction_id": lambda: F.concat_ws("-", "l_orderkey", "l_linenumber"),
            "transaction_date": lambda: F.col("o_orderdate").cast("date"),
            "client_id": lambda: F.col("o_custkey"),
            "store_id": lambda: F.col("s_nationkey"),
            "advisor_id": lambda: F.col("l_suppkey"),
            "product_id": lambda: F.col("l_partkey"),
            "quantity": lambda: F.col("l_quantity").cast("int"),
            "unit_price": lambda: money(ratio(F.col("l_extendedprice").cast(EXACT), F.col("l_quantity").cast(EXACT))),
            "discount_pct": lambda: discount() / 100.0,
            "total_amount": lambda: from_units(
                F.rint(F.rint(F.col("l_extendedprice") * 100) * (F.lit(10_000) - discount()) / 100.0)
            ),
            "payment_method": lambda: F.col("o_orderpriority"),
            "is_return": lambda: F.col("l_returnflag") == "R",
        }
        return _select(df, made, cols)

    def _stores(self, cols: tuple[str, ...]) -> DataFrame:
        df = self.scan("nation")
        if {"region", "province"} & set(cols):
            df = df.join(self.scan("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        made = {
            "store_id": lambda: F.col("n_nationkey"),
            "store_name": lambda: F.col("n_name"),
            "city": lambda: F.col("n_name"),
            "province": lambda: F.col("r_name"),
            "region": lambda: F.col("r_name"),
            "square_footage": lambda: F.lit(1000) + F.lit(100) * F.col("n_nationkey"),
            "opened_year": lambda: F.lit(1950) + F.col("n_nationkey"),
            "manager_name": lambda: F.concat(F.lit("Manager "), F.col("n_name")),
        }
        return _select(df, made, cols)

    def _advisors(self, cols: tuple[str, ...]) -> DataFrame:
        df = self.scan("supplier")

        def slot() -> Column:
            return F.pmod(F.col("s_suppkey"), F.lit(len(SPECIALIZATIONS))).cast("int")

        hired = F.pmod(F.col("s_suppkey"), F.lit(1500)).cast("int")
        made = {
            "advisor_id": lambda: F.col("s_suppkey"),
            "first_name": lambda: F.split(F.col("s_name"), "#")[0],
            "last_name": lambda: F.split(F.col("s_name"), "#")[1],
            "store_id": lambda: F.col("s_nationkey"),
            "hire_date": lambda: F.date_add(F.lit(date(1990, 1, 1)), hired),
            "specialization": lambda: F.array(*[F.lit(s) for s in SPECIALIZATIONS])[slot()],
            "commission_rate": lambda: F.lit(0.06) + slot() * F.lit(0.01),
            "ytd_revenue": lambda: F.col("s_acctbal"),
            "client_count": lambda: (F.lit(300) + F.pmod(F.col("s_suppkey") * 37, F.lit(100))).cast("int"),
        }
        return _select(df, made, cols)

    def _products(self, cols: tuple[str, ...]) -> DataFrame:
        made = {
            "product_id": lambda: F.col("p_partkey"),
            "product_name": lambda: F.col("p_name"),
            "category": lambda: F.col("p_type"),
            "subcategory": lambda: F.concat(F.lit("Size "), F.col("p_size").cast("string")),
            "brand": lambda: F.col("p_brand"),
            "unit_price": lambda: F.col("p_retailprice"),
            "colour": lambda: F.split(F.col("p_name"), " ")[0],
            "season": lambda: F.lit("All-Season"),
            "stock_qty": lambda: F.col("p_size"),
            "is_active": lambda: F.lit(True),
        }
        return _select(self.scan("part"), made, cols)

    def _clients(self, cols: tuple[str, ...], ids: DataFrame | None = None) -> DataFrame:
        want = set(cols)
        df = self.scan("customer")
        if ids is not None:
            ids = ids.select(F.col("client_id").alias("wanted_id"))
            df = df.join(ids, F.col("c_custkey") == F.col("wanted_id"), "left_semi")
        if {"city", "province"} & want:
            homes = self._stores(("store_id", "city", *(["province"] if "province" in want else [])))
            homes = homes.withColumnRenamed("store_id", "home_id")
            df = df.join(homes, F.col("c_nationkey") == F.col("home_id"), "left")
        if FROM_PROFILE & want:
            df = df.join(self._profile(want, ids), F.col("c_custkey") == F.col("client_id"), "left").drop("client_id")

        def spend() -> Column:
            return F.coalesce(F.col("lifetime_spend").cast("double"), F.lit(0.0))

        def orders() -> Column:
            return F.coalesce(F.col("total_orders"), F.lit(0)).cast("int")

        def vip() -> Column:
            return is_vip(spend(), bounds=self.bounds)

        def label() -> Column:
            days = days_since("last_purchase_date", self.as_of)
            return segment(days, orders(), F.col("gap"), vip(), self.bounds)

        made = {
            "client_id": lambda: F.col("c_custkey"),
            "first_name": lambda: F.split(F.col("c_name"), "#")[0],
            "last_name": lambda: F.split(F.col("c_name"), "#")[1],
            "email": lambda: F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@" + DOMAIN)),
            "city": lambda: F.col("city"),
            "province": lambda: F.col("province"),
            "preferred_store_id": lambda: F.col("c_nationkey"),
            "advisor_id": lambda: F.pmod(F.col("c_custkey"), self.scan("supplier").agg(F.count(F.lit(1))).scalar()),
            "membership_tier": lambda: membership_tier(spend(), self.bounds),
            "is_vip": vip,
            "client_segment": label,
            "lifetime_spend": spend,
            "last_purchase_date": lambda: F.col("last_purchase_date"),
            "first_purchase_date": lambda: F.col("first_purchase_date"),
            "total_orders": orders,
            "avg_order_value": lambda: money("avg_order_value"),
            "preferred_category": lambda: F.col("preferred_category"),
        }
        return _select(df, made, cols)

    def _profile(self, want: set[str], ids: DataFrame | None) -> DataFrame:
        category, gap = "preferred_category" in want, bool(FROM_GAP & want)
        cols = ["client_id", "transaction_date", "total_amount"]
        sales = self.sales(*cols, *(["product_id"] if category else []))
        if ids is not None:
            sales = sales.join(ids, F.col("client_id") == F.col("wanted_id"), "left_semi")
        return profile(sales, self._products(("product_id", "category")) if category else None, gap)


def _select(df: DataFrame, made: dict[str, Callable[[], Column]], cols: tuple[str, ...]) -> DataFrame:
    """The asked-for columns only; the others are not even built."""
    return df.select(*[made[c]().alias(c) for c in cols])
