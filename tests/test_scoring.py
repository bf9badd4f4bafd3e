"""Answer scoring: verdicts, bands, run comparison, and the known mistakes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lapel.operators import clients as C
from lapel.operators import revenue as R
from lapel.operators import scoring as S
from lapel.sources.catalogue import TODAY
from tests.conftest import rows


def frame(spark, *values):
    return spark.createDataFrame(list(values), "a int, b string")


def test_verdicts(spark):
    base = frame(spark, (1, "x"), (1, "x"), (2, None))
    assert rows(S.score_answer(base, base.select(F.col("a").alias("z"), "b"))) == [("Pass", 0, 0)]
    assert rows(S.score_answer(base, frame(spark, (2, None), (1, "x"), (1, "x")))) == [("Partial", 0, 0)]
    assert rows(S.score_answer(base, frame(spark, (2, None), (1, "x")))) == [("Fail", 1, 0)]
    assert rows(S.score_answer(base, frame(spark, (2, "y"), (1, "x"), (1, "x")))) == [("Fail", 1, 1)]
    assert rows(S.score_answer(base, base.select("a"))) == [("Fail", None, None)]
    assert rows(S.score_answer(base, base.select("b", "a"))) == [("Fail", None, None)]


def test_fingerprints_settle_what_differs(spark, monkeypatch):
    """Verdicts are those of the comparison row by row, which is not asked for where fingerprints differ."""
    base = frame(spark, (1, "x"), (1, "x"), (2, None), (None, "y"))
    others = [
        frame(spark, (None, "y"), (2, None), (1, "x"), (1, "x")), frame(spark, (2, None), (1, "x"), (None, "y")),
        frame(spark, (1, "x"), (2, None), (2, None), (None, "y")), frame(spark, (1, "x"), (1, "x"), (2, "y"), (None, None)),
        frame(spark, (1, "x"), (1, "x"), (None, "y"), (None, None)), base.select("a"), base.select("a", F.lit("x").alias("b")), base.limit(0),
    ]
    verdicts = [rows(S.score_answer(base, o))[0][0] for o in others]
    assert verdicts == ["Partial"] + ["Fail"] * 7 == [rows(S.score_answer(base, o, counts=False))[0][0] for o in others]
    monkeypatch.setattr(S, "differences", lambda *_: 1 / 0)
    assert rows(S.score_answers({"q": (base, others[1])}, counts=False)) == [("q", "Fail", None, None)]
    with pytest.raises(ZeroDivisionError):
        S.score_answer(base, others[0], counts=False)
    double, decimal = spark.sql("SELECT -0.0D AS a, 2 AS b"), spark.sql("SELECT CAST(0 AS DECIMAL(9,2)) AS a, 2.0D AS b")
    assert not S.surely_differ(double, decimal) and S.surely_differ(double, spark.sql("SELECT 0.0D AS a, 2.01D AS b"))


def test_number_types_do_not_matter(spark):
    whole, decimal = spark.sql("SELECT 1 AS a, 2.0D AS b"), spark.sql("SELECT 1L AS a, CAST(2 AS DECIMAL(9,2)) AS b")
    assert rows(S.score_answer(whole, decimal)) == [("Partial", 0, 0)]
    assert rows(S.score_answer(whole, spark.sql("SELECT '1' AS a, 2.0D AS b")))[0][0] == "Fail"


def test_empty_answers_are_equal(spark):
    nothing = frame(spark, (1, "x")).limit(0)
    assert rows(S.score_answer(nothing, frame(spark, (2, "x")).filter("a > 5")))[0][0] == "Partial"


def mistakes(s):
    """question -> (expected, answer with a known mistake)."""
    total = R.money(R.total("total_amount"))
    stores = s.stores("store_id", "city")
    wrong_store = s.sales("advisor_id", "total_amount").join(stores, F.col("advisor_id") == F.col("store_id"))
    return {
        "returns included": (
            R.revenue_ytd(s, TODAY),
            s.transactions("total_amount", since="2026-01-01", before="2027-01-01").agg(total.alias("r")),
        ),
        "wrong segment": (
            C.at_risk_count(s),
            s.clients("client_segment").filter("client_segment = 'Dormant'").agg(F.count(F.lit(1)).alias("n")),
        ),
        "wrong join": (
            R.city_revenue(s, ["Toronto", "Vancouver"]),
            wrong_store.filter(F.col("city").isin("Toronto", "Vancouver")).groupBy("city").agg(total.alias("r")),
        ),
        "wrong year": (R.revenue_ytd(s, TODAY), R.revenue_ytd(s, TODAY.replace(year=2025))),
        "wrong grain": (R.return_rate_by(s), R.return_rate_by(s, "brand")),
    }


def test_known_mistakes_fail(sample):
    scored = S.score_answers(mistakes(sample)).collect()
    assert len(scored) == 5 and {r.verdict for r in scored} == {"Fail"}


@pytest.mark.parametrize(
    ("passed", "total", "band"),
    [(10, 10, S.READY), (8, 10, S.READY), (7, 10, S.IMPROVE), (5, 10, S.IMPROVE), (4, 10, S.REVIEW), (16, 20, S.READY)],
)
def test_bands(spark, passed, total, band):
    data = [("r", f"q{i}", "Pass" if i < passed else "Partial") for i in range(total)]
    verdicts = spark.createDataFrame(data, "run_id string, question_id string, verdict string")
    assert rows(S.score_benchmark(verdicts)) == [("r", total, passed, band)]


def test_compare(spark):
    before = [("a", "q1", "Pass"), ("a", "q2", "Fail"), ("a", "q3", "Pass")]
    data = before + [("b", "q1", "Partial"), ("b", "q2", "Pass"), ("b", "q4", "Pass")]
    verdicts = spark.createDataFrame(data, "run_id string, question_id string, verdict string")
    assert sorted(rows(S.score_compare(verdicts, "a", "b"))) == [
        ("q1", "Pass", "Partial", True, False),
        ("q2", "Fail", "Pass", False, True),
        ("q3", "Pass", None, True, False),
        ("q4", None, "Pass", False, True),
    ]
    assert rows(S.score_delta(verdicts, "a", "b")) == [(2, 2, 0, 2, 2)]
