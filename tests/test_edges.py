"""Hand-made rows for what the generated data does not hold: NULLs, ties, equal names, boundary days."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from lapel.operators import advisors as A
from lapel.operators import clients as C
from lapel.operators import metric_reports as M
from lapel.operators import profile as P
from lapel.operators import revenue as R
from lapel.sources.schema import SCHEMAS
from lapel.sources.star import MappedStar, amount_check, fk_check
from tests.conftest import rows

NOW = date(2026, 3, 17)


def ago(days):
    return NOW - timedelta(days=days)


def table(spark, name, *records):
    """Rows given as dicts; columns left out are NULL."""
    names = SCHEMAS[name].names
    data = [tuple(r.get(n) for n in names) for r in records]
    assert all(set(r) <= set(names) for r in records)
    return spark.createDataFrame(data, SCHEMAS[name])


def sale(n, client, product="A", amount=10.0, day=NOW, store=1, advisor=1, back=False, discount=0.0):
    return {
        "transaction_id": f"T{n}",
        "transaction_date": day,
        "client_id": client,
        "store_id": store,
        "advisor_id": advisor,
        "product_id": product,
        "quantity": 1,
        "unit_price": amount,
        "discount_pct": discount,
        "total_amount": amount,
        "payment_method": "Debit",
        "is_return": back,
    }


def client(key, spend=0.0, last=NOW, first="Ann", family="Lee", advisor=1, store=1, **more):
    return {
        "client_id": key,
        "first_name": first,
        "last_name": family,
        "email": f"c{key}@x.com",
        "city": "Rome",
        "province": "RM",
        "preferred_store_id": store,
        "advisor_id": advisor,
        "lifetime_spend": spend,
        "last_purchase_date": last,
        **more,
    }


STORES = [
    {"store_id": 1, "store_name": "Twin", "city": "Rome", "region": "East", "square_footage": 100},
    {"store_id": 2, "store_name": "Twin", "city": "Rome", "region": "East", "square_footage": 0},
    {"store_id": 3, "store_name": "Empty", "city": "Oslo", "region": "West", "square_footage": 50},
]
ADVISORS = [
    {"advisor_id": 1, "first_name": "Max", "last_name": "Roe", "store_id": 1, "client_count": 61},
    {"advisor_id": 2, "first_name": "Max", "last_name": "Roe", "store_id": 2, "client_count": 60},
]
PRODUCTS = [
    {"product_id": "A", "product_name": "Tie", "category": "Ties", "brand": "B1"},
    {"product_id": "B", "product_name": "Tie", "category": "Ties", "brand": "B2"},
    {"product_id": "C", "product_name": "Boot", "category": "Shoes", "brand": "B1"},
]


def star(spark, sales=(), clients=()):
    return MappedStar(
        spark,
        {
            "stores": table(spark, "stores", *STORES),
            "advisors": table(spark, "advisors", *ADVISORS),
            "products": table(spark, "products", *PRODUCTS),
            "clients": table(spark, "clients", *clients),
            "transactions": table(spark, "transactions", *sales),
        },
    )


def test_year_without_sales_is_one_null_row(spark):
    s = star(spark, [sale(1, 1, day=date(2025, 12, 31)), sale(2, 1, back=True)])
    assert rows(R.revenue_ytd(s, NOW)) == [(None,)]
    assert rows(R.revenue_ytd(s, date(2025, 6, 1))) == [(10.0,)]


def test_calendar_year_ends(spark):
    days = [date(2025, 12, 31), date(2026, 1, 1), date(2026, 12, 31), date(2027, 1, 1)]
    s = star(spark, [sale(i, 1, day=d, amount=10.0**i) for i, d in enumerate(days)])
    assert rows(R.revenue_ytd(s, NOW)) == [(110.0,)]


def test_twelve_months_and_365_days_differ_by_a_day(spark):
    days = [0, 364, 365, 366]
    s = star(spark, [sale(i, 1, day=ago(d), amount=10.0**i) for i, d in enumerate(days)])
    assert R.revenue_by_store_12m(s, NOW).first().revenue == 111.0
    assert R.revenue_by_store_between(s, NOW).first().revenue_last_12_months == 11.0


def test_null_guards(spark):
    s = star(spark, [sale(1, 1, store=None), sale(2, 1, amount=None), sale(3, 1, amount=5.0)])
    assert rows(R.revenue_by_store_between(s, NOW)) == [(1, "Twin", 5.0)]


def test_equal_names_stay_apart(spark):
    s = star(
        spark,
        [
            sale(1, 1, "A", 5.0, store=1, advisor=1),
            sale(2, 1, "B", 7.0, store=2, advisor=2),
        ],
    )
    assert [r.revenue for r in R.top_products(s).collect()] == [7.0, 5.0]
    assert [r.total_revenue for r in A.advisor_revenue(s).collect()] == [7.0, 5.0]
    assert [r.revenue for r in R.revenue_by_store_12m(s, NOW).collect()] == [7.0, 5.0]
    assert R.city_compare(s, ["Rome"], NOW).first().store_count == 2


def test_repeated_ids_count_once_on_request(spark):
    s = star(spark, [sale(1, 1), sale(1, 2), sale(2, 1, store=2)])
    assert R.city_compare(s, ["Rome"], NOW).first().transactions == 3
    assert R.city_compare(s, ["Rome"], NOW, ids_repeat=True).first().transactions == 2


def test_half_cents_round_up(spark):
    s = star(spark, [sale(1, 1, amount=10.005)])
    assert R.revenue_by_store_12m(s, NOW).first().revenue == 10.01


def test_advisor_bounds_are_strict(spark):
    s = star(spark, [sale(1, 1, amount=800.0, advisor=1), sale(2, 1, amount=900.0, advisor=2)])
    assert rows(A.advisors_having(s)) == []
    s = star(spark, [sale(1, 1, amount=800.001, advisor=1), sale(2, 1, amount=900.0, advisor=2)])
    assert [r.actual_aov for r in A.advisors_having(s).collect()] == [800.0]


def test_store_of_the_advisor_not_of_the_sale(spark):
    s = star(spark, [sale(1, 1, store=3, advisor=1)])
    assert A.advisor_revenue(s).first().store_name == "Twin"


def test_discounts(spark):
    s = star(spark, [sale(1, 1, discount=10.0), sale(2, 1, discount=15.0), sale(3, 1), sale(4, 1, back=True)])
    assert rows(R.discount_usage(s)) == [(3, 2, 66.7, 12.5)]
    assert M.discount_rate_by(s).first().discount_rate == 0.5
    assert M.discount_rate_by(s, as_pct=True).first().discount_rate == 50.0
    none = star(spark, [sale(1, 1)])
    assert rows(R.discount_usage(none)) == [(1, 0, 0.0, None)]
    assert rows(R.discount_usage(star(spark))) == [(0, None, None, None)]


def test_all_returns(spark):
    s = star(spark, [sale(1, 1, back=True, amount=5.0)])
    assert rows(M.revenue_by(s)) == [(1, 0.0)]
    assert rows(M.net_revenue_by(s)) == [(1, -5.0)]
    assert M.aov_by(s).first().aov is None
    assert R.return_rate_by(s).first().return_rate_pct == 100.0


def test_revenue_per_square_foot(spark):
    s = star(spark, [sale(1, 1, amount=50.0), sale(2, 1, amount=50.0, back=True), sale(3, 1, store=2)])
    assert sorted(rows(M.revenue_per_sqft(s))) == [(1, "Twin", 1.0), (2, "Twin", None)]
    assert sorted(rows(M.revenue_per_sqft(s, exclude_returns=True)))[0] == (1, "Twin", 0.5)


def test_growth(spark):
    s = star(
        spark,
        [
            sale(1, 1, amount=30.0, day=date(2026, 3, 31)),
            sale(2, 1, amount=20.0, day=date(2026, 2, 1)),
            sale(3, 1, amount=99.0, day=date(2026, 2, 1), back=True),
            sale(4, 1, amount=5.0, day=date(2026, 3, 1), store=2),
            sale(5, 1, amount=500.0, day=date(2025, 3, 1)),
        ],
    )
    for day in (date(2026, 3, 1), date(2026, 3, 31)):
        assert sorted(rows(M.growth_mom(s, day))) == [(1, 30.0, 20.0, 0.5), (2, 5.0, 0.0, None)]
    naive = M.growth_mom_naive(s, date(2026, 3, 31)).first()[0]
    assert naive == 0.0  # 30 days before 31 March is still March
    series = {(r.store_id, r.month): r.growth_mom for r in M.growth_mom_series(s).collect()}
    assert series[1, date(2026, 3, 1)] == 0.5
    assert series[1, date(2026, 2, 1)] is None  # the month before has no sales
    assert sorted(r[1:] for r in rows(M.yoy(s, NOW)) if r[0] == 1) == [("Current Year", 50.0), ("Prior Year", 500.0)]


def test_purchase_frequency(spark):
    s = star(spark, [sale(1, 1), sale(2, 1), sale(3, 1, day=date(2025, 1, 1)), sale(4, None), sale(5, 1, back=True)])
    assert sorted(rows(M.purchase_frequency(s))) == [(1, 2025, 1), (1, 2026, 2)]


def test_inactive_high_value_bounds(spark):
    people = [
        client(1, 10000.0, ago(181)),
        client(2, 10000.01, ago(180)),
        client(3, 10000.01, ago(181)),
        client(4, None, ago(400)),
        client(5, 99999.0, None),
        client(6, 99999.0, ago(400), advisor=None),
    ]
    s = star(spark, clients=people)
    assert [r.email for r in C.inactive_high_value(s, NOW).collect()] == ["c3@x.com"]
    assert [r.email for r in C.inactive_clients(s, NOW).collect()] == ["c4@x.com", "c6@x.com", "c1@x.com", "c3@x.com"]


def test_ties_are_broken_by_id(spark):
    s = star(spark, clients=[client(k, 5.0) for k in (3, 1, 2)])
    assert [r.client_id for r in C.top_clients(s, NOW, 2).collect()] == [1, 2]


def test_null_name_part(spark):
    s = star(spark, clients=[client(1, 5.0, first=None)])
    assert C.top_clients(s, NOW).first().client_name is None


def test_cross_sell(spark):
    sales = [sale(1, 1, "A"), sale(2, 2, "A"), sale(3, 2, "C"), sale(4, 3, "A"), sale(5, 3, "C", back=True)]
    people = [client(1), client(2), client(3)]

    def ids(extra, method):
        s = star(spark, sales + extra, people)
        df = C.bought_x_never_y(s, "B1", "Ties", "Shoes", method=method, client_ids=True)
        return sorted(r.client_id for r in df.collect())

    for method in ("anti", "not_in", "except"):
        assert ids([], method) == [1, 3]
    unknown = [sale(6, None, "C")]
    assert ids(unknown, "anti") == [1, 3] == ids(unknown, "except")
    assert ids(unknown, "not_in") == []
    assert ids([sale(7, None, "A")], "not_in") == [1, 3]


def test_category_buyers(spark):
    sales = [
        sale(1, 1, "A", day=date(2025, 1, 1)),
        sale(2, 1, "B", day=date(2025, 12, 31)),
        sale(3, 2, "A", day=date(2026, 1, 1)),
        sale(4, 3, "A", day=date(2025, 5, 5), back=True),
        sale(5, 4, "C", day=date(2025, 5, 5)),
    ]
    s = star(spark, sales, [client(k, last=ago(91 if k == 1 else 90)) for k in (1, 2, 3, 4)])
    first = C.category_buyers(s, "Ties", 2025)
    assert [r.client_id for r in first.collect()] == [1]
    assert [r.email for r in C.buyers_now_inactive(s, first, NOW).collect()] == ["c1@x.com"]
    assert rows(C.category_buyers_now_inactive(s, "Ties", 2026, NOW)) == []


def test_profile(spark):
    sales = [
        sale(1, 1, "A", 10.0, ago(800)),
        sale(2, 1, "C", 20.0, ago(100)),
        sale(3, 1, "C", 30.0, ago(100)),
        sale(4, 1, "A", 5.0, ago(100)),
        sale(5, 2, "A", 1.0, ago(10), back=True),
        sale(6, None, "A", 1.0, ago(10)),
        sale(7, 3, "missing", 2.0, ago(1)),
    ]
    s = star(spark, sales)
    got = {r.client_id: r for r in P.client_profile(s).collect()}
    assert set(got) == {1, 3}
    one = got[1]
    assert (one.lifetime_spend, one.total_orders, one.avg_order_value) == (65.0, 4, 16.25)
    assert (one.first_purchase_date, one.last_purchase_date) == (ago(800), ago(100))
    assert one.preferred_category == "Shoes"  # two each: first by name
    assert got[3].preferred_category is None and got[3].lifetime_spend == 2.0
    segments = {r.client_id: (r.gap, r.client_segment) for r in P.segment_clients(s, NOW).collect()}
    assert segments == {1: (700, "Re-engaged"), 3: (None, "New")}


def test_profile_with_and_without_extras_agree(spark, sample):
    sales = sample.sales("client_id", "transaction_date", "total_amount", "product_id")
    products = sample.products("product_id", "category")
    plain = sorted(rows(P.profile(sales)))
    cols = ["client_id", *P.BASIC]
    for flags in ({"products": products}, {"gap": True}, {"products": products, "gap": True}):
        assert sorted(rows(P.profile(sales, **flags).select(*cols))) == plain


def test_amounts_beyond_what_is_exact_are_counted(spark):
    amounts = [1.0, 0.1, 19.99, 1234567.8901, 1.00005, 9e11, 1e15, None, -2.5, -0.33333]
    s = star(spark, [sale(k, 1, amount=a) for k, a in enumerate(amounts)])
    assert tuple(amount_check(s).first()) == (10, 2, 2, 1)


def test_orphans(spark):
    s = star(spark, [sale(1, 1), sale(2, 9), sale(3, 9), sale(4, None, store=8)], [client(1, advisor=7)])
    got = {r.foreign_key: r.orphans for r in fk_check(s).collect()}
    assert got == {
        "transactions.client_id": 2,
        "transactions.store_id": 1,
        "transactions.advisor_id": 0,
        "transactions.product_id": 0,
        "clients.preferred_store_id": 0,
        "clients.advisor_id": 1,
        "advisors.store_id": 0,
    }


@pytest.mark.parametrize("by", ["city", "province"])
def test_client_ratios(spark, by):
    people = [
        client(1, total_orders=2, is_vip=True, client_segment="At-Risk"),
        client(2, total_orders=1, is_vip=True, client_segment="Active"),
        client(3, total_orders=None, is_vip=None, client_segment="At-Risk"),
    ]
    s = star(spark, clients=people)
    assert M.repurchase_rate(s, by).first().repurchase_rate == pytest.approx(1 / 3)
    assert M.vip_at_risk_count(s, by).first().vip_at_risk_count == 1
