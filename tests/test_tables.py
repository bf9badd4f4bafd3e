"""Catalog tables: namespace, declared schemas, append, reading back, stored layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lapel.functions.sql_functions import create_sql_functions
from lapel.operators import revenue as R
from lapel.operators.clients import get_top_clients
from lapel.session import scratch_dir
from lapel.sources import generate
from lapel.sources.catalogue import TODAY
from lapel.sources.conform import AS_OF, ConformedStar
from lapel.sources.schema import SCHEMAS
from lapel.sources.star import (
    MappedStar,
    StoredStar,
    append_table,
    create_schema,
    create_star_tables,
    row_counts,
    write_star,
)
from tests.conftest import DATA, comparable, rows


@pytest.fixture(scope="module")
def namespace(spark, tmp_path_factory):
    spark.sql(f"CREATE SCHEMA lapel_test LOCATION '{tmp_path_factory.mktemp('warehouse')}'")
    yield "lapel_test"
    spark.sql("DROP SCHEMA lapel_test CASCADE")


def test_set_up_can_be_repeated(spark, namespace):
    tables = generate.sample_star(spark)
    for _ in range(2):
        create_schema(spark, namespace, "It's ours")
        create_star_tables(spark, namespace)
        for name, df in tables.items():
            append_table(df, namespace, name)
    star = StoredStar(spark, namespace=namespace)
    counts = dict(rows(row_counts(star)))
    assert (counts["stores"], counts["advisors"], counts["products"], counts["clients"]) == (8, 20, 40, 250)
    for name, schema in SCHEMAS.items():
        stored = spark.table(f"{namespace}.{name}").schema
        assert [(f.name, f.dataType) for f in stored] == [(f.name, f.dataType) for f in schema]
        assert [f.metadata["comment"] for f in stored] == [f.metadata["comment"] for f in schema]
    same = MappedStar(spark, tables)
    assert rows(R.revenue_by_store_12m(star, TODAY)) == rows(R.revenue_by_store_12m(same, TODAY))


def test_permanent_functions(spark, namespace):
    star = StoredStar(spark, namespace=namespace)
    create_sql_functions(spark, namespace, as_of=TODAY)
    spark.sql(f"USE {namespace}")
    try:
        assert spark.sql("SELECT * FROM get_top_clients(p_store_id => 2) WHERE rank = 1").count() == 1
        call = "get_revenue_by_period(p_region => 'West', p_start_date => '2025-01-01', p_end_date => '2025-12-31')"
        west = rows(spark.sql(f"SELECT * FROM {call}"))
        risk = "classify_client_risk(p_days_since_purchase => 400, p_lifetime_spend => 1.0)"
        assert rows(spark.sql(f"SELECT risk_tier FROM {risk}")) == [("Lost",)]
        top = spark.sql("SELECT * FROM get_top_clients(2) ORDER BY rank")
        assert top.schema["rank"].dataType.simpleString() == "int"
        assert [tuple(r) for r in top.collect()] == rows(get_top_clients(star, 2, TODAY).orderBy("rank"))
        rich = spark.table("clients").filter("preferred_store_id = 2").limit(1)
        rich = rich.withColumns({"client_id": F.lit(9_999), "lifetime_spend": F.lit(1e15), "email": F.lit("new@x")})
        append_table(rich, namespace, "clients")
        assert rows(spark.sql("SELECT email, rank FROM get_top_clients(2) WHERE rank = 1")) == [("new@x", 1)]
    finally:
        spark.sql("USE default")
    assert comparable(west) == comparable(rows(R.revenue_by_period(star, "West", "2025-01-01", "2025-12-31")))


def test_append_adds_rows(spark, namespace):
    create_star_tables(spark, namespace, ["stores"])
    stores = generate.sample_star(spark)["stores"]
    append_table(stores, namespace, "stores")
    append_table(stores.limit(3), namespace, "stores")
    assert spark.table(f"{namespace}.stores").count() == 11


def test_date_bounds_reach_partitions_and_files(sample):
    plan = sample.sales("total_amount", since="2025-06-15", before="2025-08-02")
    text = plan._jdf.queryExecution().executedPlan().toString()
    parts = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "2025-06-01" in parts and "2025-08-02" in parts
    assert "GreaterThanOrEqual(transaction_date,2025-06-15)" in text
    assert "transaction_id" not in text.split("ReadSchema")[1]


def test_written_star_answers_like_its_source(spark):
    source = ConformedStar(spark, DATA)
    stored = write_star(source, scratch_dir(spark) + "/star")
    for ask in (lambda s: R.revenue_by_store_12m(s, AS_OF), lambda s: R.monthly_trend(s, AS_OF), row_counts):
        assert comparable(rows(ask(stored))) == comparable(rows(ask(source)))
    assert comparable(rows(stored.clients())) == comparable(rows(source.clients()))
    assert comparable(rows(stored.advisors())) == comparable(rows(source.advisors()))


class Session:
    """Stands for a session started with these settings, which cannot be changed afterwards."""

    def __init__(self, master, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_dir_is_the_cluster_folder():
    assert scratch_dir(Session("yarn", spark_checkpoint_dir="/shared/checkpoints/")).startswith("/shared/checkpoints/lapel-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session("yarn"))


def test_star_can_be_written_over_itself(spark, tmp_path):
    stored = write_star(ConformedStar(spark, DATA), f"{tmp_path}/star")
    again = write_star(stored, f"{tmp_path}/star/")
    assert rows(row_counts(again)) == rows(row_counts(stored)) and again.stores().count() == 25


def test_star_needs_one_place(spark):
    with pytest.raises(ValueError):
        StoredStar(spark)
