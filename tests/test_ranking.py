"""Distributed numbering against the plain window, with one group and one value holding most rows, and keys of any type."""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lapel.operators import ranking
from lapel.operators.ranking import number_rows, top_in_group
from lapel.operators.usage import question_counts, top_questions
from tests.conftest import rows


def skewed(spark, n=3000):
    k = F.col("id")
    value = F.when(k % 3 == 0, F.lit(0.0)).when(k % 7 == 0, F.lit(None)).otherwise((k * 7919 % 50_000) / 100.0)
    group = F.when(k % 2 == 0, 1).when(k % 5 == 0, F.lit(None)).otherwise((k % 4).cast("int"))
    return spark.range(n).select(k, group.alias("g"), (value - 100).alias("v"))


def by_window(df, group, value, tie):
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last(value), tie)))


def windows_of(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]


def test_same_as_window(spark):
    df = skewed(spark)
    got = number_rows(df, "v", "id", ["g"])
    assert sorted(rows(got.select("id", "rank"))) == sorted(rows(by_window(df, ["g"], "v", "id").select("id", "rank")))
    assert got.columns == ["id", "g", "v", "rank"]


def test_no_group(spark):
    df = skewed(spark)
    assert sorted(rows(number_rows(df, "v", "id").select("id", "rank"))) == sorted(rows(by_window(df, [], "v", "id").select("id", "rank")))


@pytest.mark.parametrize("parts", ["1", "40"])
def test_number_of_ranges_does_not_matter(spark, parts):
    """More ranges than values and than groups, too."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = skewed(spark, 500)
        expected = sorted(rows(by_window(df, ["g"], "v", "id").select("id", "rank")))
        assert sorted(rows(number_rows(df, "v", "id", ["g"]).select("id", "rank"))) == expected
        best = top_in_group(df, ["g"], "v", "id", 20).select("id", "rank")
        assert sorted(rows(best)) == [r for r in expected if r[1] <= 20]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


TIES = {
    "text": "CONCAT('key ', id * 37 % 3001)",
    "date": "DATE_ADD(DATE '2000-01-01', CAST(id * 37 % 3001 AS INT))",
    "double": "id * 37 % 3001 / 7.0D",
    "decimal with a null": "CASE WHEN id > 0 THEN CAST(id * 37 % 3001 AS DECIMAL(20,0)) END",
    "array": "ARRAY('a', CAST(id AS STRING))",
}


@pytest.mark.parametrize("tie", TIES)
def test_ties_of_any_type(spark, tie):
    df = skewed(spark).withColumn("k", F.expr(TIES[tie]))
    expected = sorted(rows(by_window(df, ["g"], "v", "k").select("id", "rank")))
    assert sorted(rows(number_rows(df, "v", "k", ["g"]).select("id", "rank"))) == expected
    for n in (3, 1000, 1001):
        assert sorted(rows(top_in_group(df, ["g"], "v", "k", n).select("id", "rank"))) == [r for r in expected if r[1] <= n]


def test_groups_of_several_columns_and_no_rows(spark):
    df = skewed(spark).withColumn("h", F.when(F.col("id") % 9 > 0, F.concat(F.lit("h"), F.col("id") % 2)))
    expected = sorted(rows(by_window(df, ["g", "h"], "v", "id").select("id", "rank")))
    assert sorted(rows(number_rows(df, "v", "id", ["g", "h"]).select("id", "rank"))) == expected
    assert number_rows(df.limit(0), "v", "id", ["g"]).collect() == top_in_group(df.limit(0), ["g"], "v", "id", 5).collect() == []


def test_no_window_sorts_a_whole_group(spark):
    """Rows are numbered where their range lies; the only window adds up one row per range and group."""
    assert len(windows_of(number_rows(skewed(spark), "v", "id", ["g"]))) == 1
    assert "_range" in windows_of(number_rows(skewed(spark), "v", "id", ["g"]))[0]
    first, last = sorted(windows_of(top_in_group(skewed(spark), ["g"], "v", "id", 2000)), key=lambda w: "xxhash64" not in w and "_w" not in w)
    assert "g#" in first and "g#" in last and first != last


def test_one_value_and_one_group_lie_in_many_ranges(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    dealt, once = [], ranking.written_once
    monkeypatch.setattr(ranking, "written_once", lambda df: dealt.append(once(df)) or dealt[0])
    try:
        df = spark.range(20_000).select("id", F.lit(1).alias("g"), F.lit(2.5).alias("v"), F.concat(F.lit("t"), "id").alias("t"))
        got = number_rows(df, "v", "t", ["g"]).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.rank, r.t) for r in got] == list(enumerate(sorted(f"t{k}" for k in range(20_000)), 1))
    assert max(r["count"] for r in dealt[0].groupBy(F.shiftright("_at", 33)).count().collect()) < 8_000


def test_values_of_any_size_are_ordered_as_they_are(spark):
    near = [(1, Decimal("1000000000000.0001")), (2, Decimal("1000000000000.0002")), (3, Decimal("-5")), (4, None)]
    df = spark.createDataFrame(near, "id int, v decimal(24,4)")
    assert sorted(rows(number_rows(df, "v", "id").select("id", "rank"))) == [(1, 2), (2, 1), (3, 3), (4, 4)]
    fine = spark.createDataFrame([(1, 10.00001), (2, 10.00002), (3, 1e300), (4, 1e15), (5, float("nan"))], "id int, v double")
    expected = [(1, 5), (2, 4), (3, 2), (4, 3), (5, 1)]
    assert sorted(rows(number_rows(fine, "v", "id").select("id", "rank"))) == expected
    assert sorted(rows(top_in_group(fine, [], "v", "id", 9).select("id", "rank"))) == expected


def test_one_rule_whatever_the_number_asked_for(spark):
    df = skewed(spark)
    few, more = (dict(rows(top_in_group(df, ["g"], "v", "id", n).select("id", "rank"))) for n in (1000, 1001))
    assert few == {k: r for k, r in more.items() if r <= 1000} and len(more) > len(few)


def test_top_in_group_prunes_before_both_shuffles(spark):
    df = top_in_group(skewed(spark), ["g"], "v", "id", 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert max(r.rank for r in df.collect()) == 3


def test_questions_beyond_a_thousand(spark):
    """The tie is the question's text; every week has more than a thousand of them."""
    day = date(2024, 1, 1)
    log = spark.range(9_000).select(
        F.lit(day).cast("timestamp").alias("ts") + F.make_dt_interval(F.col("id") % 2 * 7), F.concat(F.lit("question "), F.col("id") % 3000).alias("question")
    ).toDF("ts", "question")
    certified = spark.createDataFrame([("question 7",), ("question 8",)], "question string")
    counts = rows(question_counts(log, certified))
    expected = []
    for week in (day, day + timedelta(days=7)):
        own = sorted(((-n, q) for w, q, n, sure in counts if w == week and not sure))
        expected += [(week, q, -n, k + 1) for k, (n, q) in enumerate(own)]
    for n in (5, 1000, 1001):
        got = rows(top_questions(log, certified, n))
        assert sorted(got) == sorted(r for r in expected if r[3] <= n)
        assert set(Counter(r[0] for r in got).values()) == {min(n, len(expected) // 2)}
