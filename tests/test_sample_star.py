"""The questions on the sample star, against plain SQL over its five tables."""

from __future__ import annotations

import duckdb
import pytest

from lapel.functions.metrics import NAMED
from lapel.functions.sql_functions import register_advisor_filter, register_masks, register_sql_functions
from lapel.operators import advisors as A
from lapel.operators import clients as C
from lapel.operators import metric_reports as M
from lapel.operators import revenue as R
from lapel.sources import catalogue
from lapel.sources.catalogue import TODAY
from lapel.sources.schema import SCHEMAS
from lapel.sources.star import fk_check, register_views, row_counts
from tests.conftest import comparable, rows

TORONTO = ("Toronto", "Vancouver")
D = "DATE '2026-03-17'"
NAME = "first_name || ' ' || last_name"


@pytest.fixture(scope="module")
def duck(sample):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.register(name, sample.table(name).toPandas())
    con.execute("CREATE VIEW s AS SELECT * FROM transactions WHERE NOT is_return")
    return con


AMOUNT = "CAST(total_amount AS DECIMAL(18,4))"
SUM = f"CAST(ROUND(SUM({AMOUNT}), 2) AS DOUBLE)"
AVG = f"CAST(ROUND(CAST(CAST(SUM({AMOUNT}) AS DOUBLE) / COUNT(*) AS DECIMAL(30,10)), 2) AS DOUBLE)"

CASES = {
    "year to date": (
        lambda s: R.revenue_ytd(s, TODAY),
        f"SELECT {SUM} FROM s WHERE year(transaction_date) = 2026",
    ),
    "stores, 12 months": (
        lambda s: R.revenue_by_store_12m(s, TODAY),
        f"""SELECT store_name, city, region, {SUM}, COUNT(DISTINCT client_id), {AVG} FROM s JOIN stores USING (store_id)
            WHERE transaction_date >= {D} - 365 GROUP BY ALL""",
    ),
    "stores, year": (
        lambda s: R.revenue_by_store_ytd(s, TODAY),
        f"""SELECT store_name, city, region, {SUM}, COUNT(DISTINCT client_id), {AVG}, COUNT(*)
            FROM s JOIN stores USING (store_id) WHERE year(transaction_date) = 2026 GROUP BY ALL""",
    ),
    "tiers": (
        lambda s: C.clients_by_tier(s).select("membership_tier", "client_count"),
        "SELECT membership_tier, COUNT(*) FROM clients GROUP BY 1",
    ),
    "categories": (
        lambda s: R.top_categories(s),
        f"""SELECT category, COUNT(*), {SUM}, {AVG} FROM s JOIN products USING (product_id) GROUP BY 1
            ORDER BY 3 DESC LIMIT 5""",
    ),
    "VIPs by city": (
        lambda s: C.vip_by_city(s),
        "SELECT city, province, COUNT(*) FROM clients WHERE is_vip GROUP BY ALL",
    ),
    "inactive, high value": (
        lambda s: C.inactive_high_value(s, TODAY).select("client_name", "email", "lifetime_spend", "store_name"),
        f"""SELECT {NAME}, email, lifetime_spend, store_name FROM clients
            JOIN stores ON store_id = preferred_store_id
            WHERE lifetime_spend > 10000 AND last_purchase_date < {D} - 180""",
    ),
    "advisors": (
        lambda s: A.advisor_revenue(s).select("advisor_name", "transactions", "total_revenue", "unique_clients"),
        f"""SELECT {NAME}, COUNT(*), {SUM}, COUNT(DISTINCT client_id) FROM s JOIN advisors USING (advisor_id)
            GROUP BY advisor_id, 1""",
    ),
    "advisors above bounds": (
        lambda s: A.advisors_having(s).select("advisor_name", "client_count", "actual_aov"),
        f"""SELECT {NAME}, client_count, {AVG} FROM s JOIN advisors USING (advisor_id)
            GROUP BY advisor_id, 1, 2 HAVING client_count > 60 AND SUM(total_amount) / COUNT(*) > 800""",
    ),
    "two cities": (
        lambda s: R.city_compare(s, TORONTO, TODAY),
        f"""SELECT city, COUNT(DISTINCT transaction_id), COUNT(DISTINCT client_id), {SUM}, {AVG},
                   COUNT(DISTINCT store_id)
            FROM s JOIN stores USING (store_id)
            WHERE transaction_date >= {D} - 365 AND city IN ('Toronto', 'Vancouver') GROUP BY city""",
    ),
    "suit buyers now inactive": (
        lambda s: C.buyers_now_inactive(s, C.category_buyers(s, "Suits", 2025), TODAY).select("email", "days_inactive"),
        f"""SELECT email, CAST({D} - last_purchase_date AS INTEGER) FROM clients
            WHERE last_purchase_date < {D} - 90 AND client_id IN (
              SELECT client_id FROM s JOIN products USING (product_id)
              WHERE category = 'Suits' AND year(transaction_date) = 2025)""",
    ),
    "suits of one brand, never shoes": (
        lambda s: C.bought_x_never_y(s, "Canali", "Suits", "Shoes", client_ids=True).select("client_id"),
        """SELECT client_id FROM clients WHERE client_id IN (
             SELECT client_id FROM s JOIN products USING (product_id) WHERE brand = 'Canali' AND category = 'Suits')
           AND client_id NOT IN (SELECT client_id FROM s JOIN products USING (product_id) WHERE category = 'Shoes')""",
    ),
    "trend": (
        lambda s: R.monthly_trend(s, TODAY),
        f"""SELECT CAST(date_trunc('month', transaction_date) AS DATE), {SUM}, COUNT(DISTINCT client_id), COUNT(*)
            FROM s WHERE transaction_date >= {D} - INTERVAL 24 MONTH GROUP BY 1""",
    ),
    "returns": (
        lambda s: R.return_rate_by(s).select("category", "total_transactions", "returns"),
        """SELECT category, COUNT(*), COUNT(*) FILTER (is_return) FROM transactions JOIN products USING (product_id)
           GROUP BY 1""",
    ),
    "live client counts": (
        lambda s: M.live_client_count(s),
        """SELECT advisor_id, client_count, COUNT(DISTINCT client_id) FROM advisors LEFT JOIN s USING (advisor_id)
           GROUP BY ALL""",
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_question(sample, duck, name):
    ask, sql = CASES[name]
    assert comparable(rows(ask(sample))) == comparable(duck.execute(sql).fetchall())


def test_counts_and_keys(sample):
    n = dict(rows(row_counts(sample)))
    assert {k: n[k] for k in ("stores", "advisors", "products", "clients")} == {
        "stores": 8,
        "advisors": 20,
        "products": 40,
        "clients": 250,
    }
    assert all(r[2] == 0 for r in rows(fk_check(sample)))


def test_at_risk_book_of_first_advisor_is_empty(sample):
    assert C.advisor_at_risk_book(sample, "Alessandro", "Ferretti", TODAY).count() == 0


def test_six_advisors_without_sales(sample):
    assert A.advisor_revenue(sample).count() == 14


def test_totals_agree(sample):
    """Stores add up to the total, and so do categories and brands; net revenue is revenue less returns."""
    everything = R.revenue_by_period(sample, "ALL", "1990-01-01", "2100-01-01").agg({"total_revenue": "sum"})
    stores = rows(everything)[0][0]
    categories = sum(r.total_revenue for r in R.top_categories(sample, None).collect())
    brands = sum(r.total_revenue for r in R.revenue_by_brand(sample).collect())
    assert stores == pytest.approx(categories, abs=0.1) == pytest.approx(brands, abs=0.1)
    revenue = {r.store_id: r.revenue for r in M.revenue_by(sample).collect()}
    net = {r.store_id: r.net_revenue for r in M.net_revenue_by(sample).collect()}
    back = sample.transactions("store_id", "total_amount", "is_return").filter("is_return").toPandas()
    back = back.groupby("store_id").total_amount.sum()
    assert all(net[s] == pytest.approx(revenue[s] - back.get(s, 0.0), abs=0.005) for s in revenue)


def test_sql_functions(spark, sample):
    register_views(sample, "s_")
    register_sql_functions(spark, prefix="s_", as_of=TODAY)
    direct = R.revenue_by_period(sample, "East", "2025-01-01", "2025-12-31")
    via_sql = spark.sql("SELECT * FROM s_get_revenue_by_period('East', '2025-01-01', '2025-12-31')")
    assert comparable(rows(via_sql)) == comparable(rows(direct))
    direct = C.get_top_clients(sample, 1, TODAY, top_n=5)
    via_sql = spark.sql("SELECT * FROM s_get_top_clients(1) WHERE rank <= 5")
    assert comparable(rows(via_sql)) == comparable(rows(direct))
    one = rows(spark.sql("SELECT * FROM s_classify_client_risk(120, 25000)"))
    assert one == [(120, 25000.0, "High-Value At-Risk")]
    joined = spark.sql(
        """SELECT c.client_id, r.risk_tier FROM s_clients c, LATERAL s_classify_client_risk(
             DATEDIFF(DATE '2026-03-17', c.last_purchase_date), c.lifetime_spend) r"""
    )
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()
    direct = C.classify_client_risk(sample, TODAY).select("client_id", "risk_tier")
    assert comparable(rows(joined)) == comparable(rows(direct))


def test_sql_masks(spark):
    query = "SELECT mask_email('a@b.c'), mask_lifetime_spend(5.0), city_row_filter('Toronto'), city_row_filter('Rome')"
    register_masks(spark, "Viewer@x.com", "viewer@X.com", "Toronto")
    assert rows(spark.sql(query)) == [("***@***.***", None, True, False)]
    register_masks(spark, "admin@x.com", "viewer@x.com", "Toronto")
    assert rows(spark.sql(query)) == [("a@b.c", 5.0, True, True)]


def test_sql_advisor_filter(spark, sample):
    register_views(sample, "rls_")
    seen = "SELECT COUNT(*) FROM rls_clients WHERE rls_advisor_row_filter(advisor_id)"
    for user, n in (("Kevin.O'Brien@house.com", 31), ("nobody@house.com", 0)):
        register_advisor_filter(spark, user, "house.com", "rls_")
        assert rows(spark.sql(seen)) == [(n,)]


def test_free_sql_over_views(spark, sample):
    """Questions can be asked in SQL as well."""
    register_views(sample, "v_")
    free = spark.sql(
        """SELECT s.city, COUNT(DISTINCT t.client_id) AS unique_clients
           FROM v_transactions t JOIN v_stores s ON t.store_id = s.store_id
           WHERE t.is_return = FALSE AND t.transaction_date >= DATE_SUB(DATE '2026-03-17', 365)
             AND s.city IN ('Toronto', 'Vancouver') GROUP BY s.city"""
    )
    built = R.city_compare(sample, TORONTO, TODAY).select("city", "unique_clients")
    assert comparable(rows(free)) == comparable(rows(built))


def test_every_named_metric_is_described():
    assert len(NAMED) == 12 and all(f.__doc__ for f in NAMED.values())


def test_top_clients_is_a_prefix_of_the_full_ranking(sample):
    whole = comparable(rows(C.top_clients_by_store(sample, TODAY)))
    assert comparable(rows(C.top_clients_by_store(sample, TODAY, top_n=5000))) == whole and len(whole) == 250
    first = [r for r in rows(C.top_clients_by_store(sample, TODAY)) if r[-1] <= 4]
    assert comparable(rows(C.top_clients_by_store(sample, TODAY, top_n=4))) == comparable(first)


def test_dates_as_text_or_dates(sample):
    from datetime import date

    text = R.revenue_by_period(sample, "West", "2025-01-01", "2025-06-30")
    dates = R.revenue_by_period(sample, "West", date(2025, 1, 1), date(2025, 6, 30))
    assert comparable(rows(text)) == comparable(rows(dates))


def test_catalogue_rows():
    rows = catalogue.PRODUCTS
    assert len({r[0] for r in rows}) == len(rows) == 40
    assert sum(r[8] for r in rows) == 831 and sum(r[5] for r in rows) == 72_658
    assert {r[7] for r in rows} == {"All-Season", "Spring/Summer", "Fall/Winter"}
    assert [r[6] for r in rows if r[0] in ("SKU-S003", "SKU-SHO003", "SKU-A003")] == ["Midnight Blue", "Dark Brown", "Multi"]
