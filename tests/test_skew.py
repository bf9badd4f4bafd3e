"""The registered queries on data where one key holds a third of the rows, and some keys are missing or unknown."""

from __future__ import annotations

import duckdb
import pytest

from lapel.plans.oracle import ORACLE
from lapel.plans.registry import REGISTRY
from tests.conftest import DATA, comparable

KEYS = [
    "fk_check",
    "q02_revenue_by_store_12m",
    "q03_clients_by_tier",
    "q08_advisor_revenue",
    "q10_city_compare",
    "q10_city_compare_distinct_ids",
    "q11b_buyers_now_inactive",
    "q14_monthly_trend",
    "q15_revenue_by_brand",
    "q17_bought_x_never_y",
    "q17_not_in",
    "q17_except",
    "client_profile",
    "segment_clients",
    "get_top_clients_all_stores",
    "get_top_clients_top_n",
    "rank_by_revenue",
    "metric_growth_mom_series",
    "metric_live_client_count",
    "log_top_questions",
    "log_user_activity",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of the lines in one order, of one advisor, of one product; a third of the orders of one client."""
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changes = {
        "orders": "SELECT * REPLACE (IF(o_orderkey % 3 = 0, 7, o_custkey) AS o_custkey) FROM {t}",
        "lineitem": """SELECT * EXCLUDE (x) REPLACE (
            CASE WHEN x % 3 = 0 THEN 5 WHEN x % 101 = 1 THEN 99999999 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN x % 3 = 1 THEN 3 WHEN x % 103 = 2 THEN NULL ELSE l_suppkey END AS l_suppkey,
            CASE WHEN x % 3 = 2 THEN 11 WHEN x % 107 = 0 THEN 88888888 ELSE l_partkey END AS l_partkey)
            FROM (SELECT *, row_number() OVER () AS x FROM {t})""",
        "events": """SELECT * REPLACE (IF(event_id % 3 = 0, 1, user_id) AS user_id,
            IF(event_id % 3 = 0, '{{"k": 50}}', props) AS props) FROM {t}""",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        source = f"'{DATA}/{name}.parquet'"
        query = changes.get(name, "SELECT * FROM {t}").format(t=source)
        con.execute(f"COPY ({query}) TO '{out}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return str(out), con


@pytest.mark.parametrize("key", KEYS)
def test_same_answer(spark, skewed, key):
    folder, duck = skewed
    df = REGISTRY[key](spark, folder)
    answer = duck.execute(ORACLE[key])
    order = [d[0] for d in answer.description]
    names = sorted(order)
    expected = [tuple(row[order.index(n)] for n in names) for row in answer.fetchall()]
    assert comparable([tuple(r[n] for n in names) for r in df.collect()]) == comparable(expected)
