"""What the plans must and must not hold, also when no side is small enough to broadcast."""

from __future__ import annotations

import re

import pytest

from lapel import session
from lapel.plans.registry import REGISTRY
from lapel.sources import star
from lapel.sources.conform import ConformedStar
from tests.conftest import DATA, comparable, rows

@pytest.fixture
def nothing_is_small(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_plans(spark, nothing_is_small):
    """No broadcast is forced, nothing is multiplied out, nothing leaves the JVM, no window lacks a partitioning."""
    for key, query in REGISTRY.items():
        if key in ("row_counts_in_batches", "segment_clients_in_batches"):  # of a star written in the same way as the third's
            continue
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan, key
        assert "Python" not in plan and "Pandas" not in plan, key
        windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
        keys = [re.findall(r"\], \[([^\]]+)\]", w) for w in windows]  # partitioning, ordering, or one of the two
        unpartitioned = [w for w, k in zip(windows, keys, strict=True) if len(k) < 2 and (not k or re.search("ASC|DESC", k[0]))]
        assert all("_range" in w for w in unpartitioned), key  # a row per range of a numbering
        assert "SortAggregate" not in plan, key
        objects = [line for line in plan.splitlines() if "ObjectHashAggregate" in line]
        assert all("collect_list(category" in line or "collect_list(p_type" in line for line in objects), key  # the names of categories
        scans = len(re.findall(r"FileScan parquet \[[^\]]*\bl_", plan))
        assert scans <= 1, (key, scans)


ONCE = ("q11a_category_buyers", "q11b_buyers_now_inactive", "q17_bought_x_never_y", "q17_except", "q17_not_in")


@pytest.mark.parametrize("key", ONCE)
def test_ids_are_worked_out_once(spark, nothing_is_small, monkeypatch, key):
    """Of all that the question runs, two scans read the fact: one finds the ids, one reads their clients' sales."""
    plans, save = [], session.save
    monkeypatch.setattr(session, "save", lambda df, path: (plans.append(df), save(df, path)))
    answer = REGISTRY[key](spark, DATA)
    scans = [len(re.findall(r"FileScan parquet \[[^\]]*\bl_", df._jdf.queryExecution().executedPlan().toString())) for df in [*plans, answer]]
    assert sum(scans) == 2 and scans[0] == scans[-1] == 1, scans


@pytest.mark.parametrize("key", ONCE)
def test_ids_filter_the_scan_at_run_time(spark, nothing_is_small, key):
    """Between which values they lie, and, where the other side is large (here: whatever its size), a Bloom filter."""
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    spark.conf.set(size, "0")
    try:
        plan = REGISTRY[key](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(size)
    assert re.search(r"Filter .*\(o_custkey#\d+L? >= \d+\).*might_contain\(.*o_custkey", plan), plan


def test_ids_reach_the_fact_before_it_is_added_up(spark):
    for key in ("q16_advisor_at_risk_book", "policy_advisor_rows", "policy_city_rows", "policy_all"):
        plan = REGISTRY[key](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Aggregate [client_id") :] if "Aggregate [client_id" in plan else plan
        assert "LeftSemi" in below, key


def test_weeks_of_the_log_reach_the_scan(spark):
    for key in ("score_compare", "score_delta"):
        plan = REGISTRY[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan and "LessThan(ts,2024-01-15T00:00)" in plan
        assert len(re.findall("FileScan parquet", plan)) == 1 and "SortAggregate" not in plan


def test_only_needed_columns_and_joins(spark):
    star = ConformedStar(spark, DATA)
    plan = star.sales("product_id", "total_amount")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "orders" not in plan
    read = plan.split("ReadSchema: ")[1]
    assert "l_partkey" in read and "l_suppkey" not in read and "l_orderkey" not in read


def test_date_bound_reaches_orders_and_makes_the_join_inner(spark):
    star = ConformedStar(spark, DATA)
    plan = star.sales("client_id", "total_amount", since="2001-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01T00:00)" in plan and "LeftOuter" not in plan
    assert "Not(EqualTo(l_returnflag,R))" in plan


def test_distinct_counts_without_row_expansion(spark):
    for key in ("q02_revenue_by_store_12m", "q10_city_compare", "q10_city_compare_distinct_ids", "metric_repurchase_rate"):
        assert "Expand" not in REGISTRY[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_sql_top_lists_sort_no_store_in_one_task(spark):
    """Pruned in each task before the store's rows meet, cut off by a limit, or numbered beforehand."""
    pruned, cut, numbered = (
        REGISTRY[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        for key in ("sql_get_top_clients", "sql_get_top_n_clients", "sql_get_ranked_clients")
    )
    assert re.search(r"WindowGroupLimit .preferred_store_id.*, 10, Partial", pruned)
    assert re.search("TakeOrderedAndProject|WindowGroupLimit .*Partial", cut)
    assert "row_number" not in numbered and "EqualTo(preferred_store_id,3)" in numbered


def test_lines_meet_their_orders_once(spark, monkeypatch):
    """However often the fact is asked for: a star in batches writes it three times, and its clients' profiles come from it."""
    plain, once = ConformedStar(spark, DATA), ConformedStar(spark, DATA).joined_once()
    for cols in ((), ("client_id", "total_amount"), ("store_id", "quantity")):
        assert comparable(rows(once.transactions(*cols))) == comparable(rows(plain.transactions(*cols)))
    assert comparable(rows(once.clients())) == comparable(rows(plain.clients()))
    facts, write = [], star._write_fact
    monkeypatch.setattr(star, "_write_fact", lambda df, folder: (facts.append(df), write(df, folder)))
    REGISTRY["row_counts_in_batches"](spark, DATA)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*facts, once.clients()]]
    assert len(plans) == 4 and not any("lineitem" in p or "orders.parquet" in p for p in plans)
