"""Classification, dates, names and money, value by value."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lapel.functions import classify as K
from lapel.functions.dates import days_since, in_last_days, inactive_for, month_of, month_start, months_ago
from lapel.functions.money import mean, money, total
from lapel.functions.names import advisor_email, full_name, or_unknown, or_zero
from tests.conftest import rows


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("spend", "tier"),
    [
        (8000.0, "Classic"),
        (8000.01, "Silver"),
        (20000.0, "Silver"),
        (20000.01, "Gold"),
        (50000.0, "Gold"),
        (50000.01, "Platinum"),
        (None, "Classic"),
    ],
)
def test_membership_tier(spark, spend, tier):
    assert one(spark, K.membership_tier(F.col("m")), m=("double", spend)) == tier


@pytest.mark.parametrize(
    ("days", "spend", "label"),
    [
        (90, 20000.0, "Loyal VIP"),
        (90, 19999.99, "Active"),
        (91, 20000.0, "High-Value At-Risk"),
        (180, 100.0, "Cooling Off"),
        (181, 20000.0, "VIP Dormant"),
        (365, 100.0, "Dormant"),
        (366, 99999.0, "Lost"),
        (None, 99999.0, "Lost"),
        (10, None, "Dormant"),
        (365, None, "Dormant"),
        (366, None, "Lost"),
        (-5, 20000.0, "Loyal VIP"),
        (-5, 5.0, "Active"),
    ],
)
def test_risk_tier(spark, days, spend, label):
    column = K.risk_tier(F.col("d"), F.col("m"))
    assert one(spark, column, d=("int", days), m=("double", spend)) == label


@pytest.mark.parametrize(
    ("spend", "flag", "vip", "vvip"),
    [
        (10000.0, False, False, False),
        (10000.01, False, True, False),
        (20000.0, True, True, False),
        (20000.01, False, True, True),
        (None, True, True, False),
        (None, None, False, False),
    ],
)
def test_vip(spark, spend, flag, vip, vvip):
    is_vip = K.is_vip(F.col("m"), F.col("f"))
    both = F.array(is_vip, K.is_vvip(is_vip, F.col("m")))
    assert one(spark, both, m=("double", spend), f=("boolean", flag)) == [vip, vvip]


@pytest.mark.parametrize(
    ("days", "orders", "gap", "vip", "label"),
    [
        (180, 2, None, True, "New"),
        (180, 2, 400, True, "New"),
        (180, 3, 366, False, "Re-engaged"),
        (180, 3, 365, False, "Active"),
        (181, 3, 400, True, "At-Risk"),
        (365, 9, None, True, "At-Risk"),
        (366, 9, None, True, "Dormant"),
        (300, 9, 10, False, "Active"),
        (None, 0, None, False, None),
    ],
)
def test_segment(spark, days, orders, gap, vip, label):
    column = K.segment(F.col("d"), F.col("o"), F.col("g"), F.col("v"))
    assert one(spark, column, d=("int", days), o=("int", orders), g=("int", gap), v=("boolean", vip)) == label


def test_unknown_tier_sorts_with_classic(spark):
    df = spark.createDataFrame([("Classic",), ("Odd",), ("Gold",), ("Platinum",), ("Silver",)], "t string")
    assert [r[0] for r in rows(df.orderBy(K.tier_rank(F.col("t")), "t"))] == [
        "Platinum",
        "Gold",
        "Silver",
        "Classic",
        "Odd",
    ]


def test_date_bounds(spark):
    as_of = date(2026, 3, 17)
    assert one(spark, in_last_days("d", as_of, 365), d=("date", date(2025, 3, 17)))
    assert not one(spark, in_last_days("d", as_of, 365), d=("date", date(2025, 3, 16)))
    assert not one(spark, inactive_for("d", as_of, 180), d=("date", date(2025, 9, 18)))
    assert one(spark, inactive_for("d", as_of, 180), d=("date", date(2025, 9, 17)))
    assert one(spark, inactive_for("d", as_of, 180), d=("date", None)) is None
    assert one(spark, days_since("d", as_of), d=("date", date(2026, 3, 20))) == -3
    assert one(spark, months_ago(date(2024, 3, 31), 1), d=("int", 1)) == date(2024, 2, 29)
    assert one(spark, month_of("d"), d=("date", date(2025, 12, 31))) == date(2025, 12, 1)
    assert month_start(date(2026, 1, 31), 1) == date(2025, 12, 1)
    assert month_start(date(2026, 12, 5), -1) == date(2027, 1, 1)


def test_names(spark):
    assert one(spark, full_name("a", "b"), a=("string", "Étienne"), b=("string", "Leblanc")) == "Étienne Leblanc"
    assert one(spark, full_name("a", "b"), a=("string", None), b=("string", "Leblanc")) is None
    mail = advisor_email("x.com")
    assert one(spark, mail, first_name=("string", "É"), last_name=("string", "O'B")) == "é.o'b@x.com"
    assert one(spark, or_zero("a"), a=("double", None)) == 0
    assert one(spark, or_unknown("a"), a=("string", None)) == "Unknown"


def test_money_is_exact_and_rounds_half_up(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1.005,), (None,)], "x double")
    exact, cents, avg = df.select(total("x"), money(total("x")), money(mean("x"))).first()
    assert str(exact) == "2.0050" and cents == 2.01 and avg == 0.18
    negative = spark.createDataFrame([(-0.01,), (-1234567.89,), (0.02,)], "x double")
    assert str(negative.select(total("x")).first()[0]) == "-1234567.8800"
    empty = df.filter("x > 100").select(total("x"), mean("x")).first()
    assert tuple(empty) == (None, None)


def test_money_against_decimal_arithmetic(spark):
    import random
    from decimal import Decimal

    rng = random.Random(5)
    data = [(g, rng.randint(-(10**12), 10**12) / 10_000) for g in range(40) for _ in range(rng.randint(1, 60))]
    expected = {}
    for g, x in data:
        expected[g] = expected.get(g, Decimal(0)) + Decimal(str(x))
    df = spark.createDataFrame(data, "g int, x double").repartition(7)
    assert dict(rows(df.groupBy("g").agg(total("x")))) == expected


def test_money_beyond_long(spark):
    """Sums of units that a long could not hold."""
    df = spark.range(1000).select(F.lit(9e11).alias("x"))
    wide = df.select(F.explode(F.array_repeat("x", 2000)).alias("x"))
    assert str(wide.select(total("x")).first()[0]) == "1800000000000000000.0000"


def test_malformed_date_raises(spark):
    from lapel.sources.star import cast_dates

    good = spark.createDataFrame([("2026-03-17", None)], "a string, b string")
    assert tuple(cast_dates(good, "a", "b").first()) == (date(2026, 3, 17), None)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        cast_dates(spark.createDataFrame([("17 March",)], "a string"), "a").collect()
