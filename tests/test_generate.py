"""Invariants of the generators: exact counts, ranges, keys."""

from __future__ import annotations

from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from lapel.operators.ranking import running_start
from lapel.sources import catalogue as K
from lapel.sources import generate as G


def test_clients(sample):
    people = sample.clients().collect()
    assert len(people) == 250 and len({p.email for p in people}) == 250
    assert Counter(p.client_segment for p in people) == {
        "Active": 95,
        "At-Risk": 62,
        "New": 31,
        "Dormant": 31,
        "Re-engaged": 31,
    }
    stores = Counter(p.preferred_store_id for p in people)
    assert [stores[s] for s in range(1, 9)] == [31, 32, 32, 31, 31, 31, 31, 31]
    assert {a[0] for a in K.ADVISORS} - {p.advisor_id for p in people} == {2, 3, 4, 6, 14, 17}
    assert len({(p.first_name, p.last_name) for p in people}) == 40
    home = {a[0]: a[3] for a in K.ADVISORS}
    for p in people:
        limits = K.SEGMENT_RANGES[p.client_segment]
        assert limits["spend"][0] <= p.lifetime_spend <= limits["spend"][1]
        assert limits["orders"][0] <= p.total_orders <= limits["orders"][1]
        assert limits["last_days"][0] <= (K.TODAY - p.last_purchase_date).days <= limits["last_days"][1]
        assert limits["first_days"][0] <= (K.TODAY - p.first_purchase_date).days <= limits["first_days"][1]
        assert home[p.advisor_id] == p.preferred_store_id
        assert p.is_vip or p.client_segment != "At-Risk"
        assert p.is_vip == (
            p.client_id % 4 == 0 or p.client_id % 7 == 0 or p.client_segment == "At-Risk" or p.lifetime_spend > 10_000
        )
        assert p.email == f"{p.first_name.lower()}.{p.last_name.lower()}{p.client_id}@email.com"
        assert abs(p.avg_order_value - p.lifetime_spend / p.total_orders) <= 0.0051


def test_transactions(sample):
    people = {p.client_id: p for p in sample.clients().collect()}
    sales = sample.transactions().collect()
    price = {row[0]: row[5] for row in K.PRODUCTS}
    assert Counter(s.client_id for s in sales) == {c: p.total_orders for c, p in people.items()}
    assert {s.transaction_id for s in sales} == {f"TXN-{i:06d}" for i in range(1, len(sales) + 1)}
    assert sum(s.is_return for s in sales) == len(sales) // 47
    for s in sales:
        who, number = people[s.client_id], int(s.transaction_id[4:])
        assert who.first_purchase_date <= s.transaction_date <= date(2026, 3, 17)
        assert (s.store_id, s.advisor_id) == (who.preferred_store_id, who.advisor_id)
        assert s.unit_price == price[s.product_id] and s.discount_pct in (0, 5, 10, 15, 20)
        assert s.quantity == 1 if s.unit_price > 1000 else s.quantity in (1, 2)
        assert abs(s.total_amount - s.unit_price * s.quantity * (1 - s.discount_pct / 100)) < 0.0051
        assert s.is_return == (number % 47 == 0)
        assert s.payment_method == K.PAYMENTS[number % 5]
    by_client = {}
    for s in sales:
        by_client.setdefault(s.client_id, []).append(int(s.transaction_id[4:]))
    last = 0
    for c in sorted(by_client):
        assert min(by_client[c]) == last + 1
        last = max(by_client[c])


def test_weights_are_roughly_as_stated(spark):
    clients = G.gen_clients(spark, 4000)
    sales = G.gen_transactions(clients, K.products(spark, numbered=True))
    n = sales.count()
    share = {r[0]: r[1] / n for r in sales.groupBy("discount_pct").count().collect()}
    assert abs(share[0.0] - 0.5) < 0.02 and all(abs(share[float(d)] - 0.125) < 0.02 for d in (5, 10, 15, 20))
    items = [r[1] / n for r in sales.groupBy("product_id").count().collect()]
    assert len(items) == 40 and max(items) < 0.03 and min(items) > 0.02
    cheap = sales.filter("unit_price <= 1000").agg(F.avg((F.col("quantity") == 2).cast("int"))).first()[0]
    assert abs(cheap - 0.25) < 0.02


def test_same_seed_same_rows_other_seed_other_rows(spark):
    a, b, c = G.gen_clients(spark, 50), G.gen_clients(spark, 50).repartition(7), G.gen_clients(spark, 50, seed=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() > 40


def test_running_start_over_several_runs(spark):
    df = spark.range(1, 500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r.k: r.s for r in running_start(df, "k", "n", "s", span=50).collect()}
    total = 0
    for k in range(1, 500):
        assert got[k] == total
        total += k % 7


def test_dimension_rows(spark):
    dims = K.load_dims(spark, house="House")
    stores = {r.store_id: r for r in dims["stores"].collect()}
    assert stores[1].store_name == "House - Bloor Street" and stores[5].store_name.endswith("Montréal Ogilvy")
    advisors = {r.advisor_id: r for r in dims["advisors"].collect()}
    assert advisors[13].last_name == "O'Brien" and advisors[1].hire_date == date(2015, 3, 10)
    counts = Counter(r.category for r in dims["products"].collect())
    assert counts == {"Suits": 10, "Shirts": 8, "Shoes": 5, "Outerwear": 5, "Accessories": 8, "Trousers": 4}
