"""Reports over a small hand-made log."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from lapel.operators import usage as U
from tests.conftest import rows

SCHEMA = (
    "ts timestamp_ntz, user_id string, question string, sql string, runtime_ms double, status string, "
    "failure_cause string, rating int"
)
MON = date(2026, 3, 16)


@pytest.fixture(scope="module")
def log(spark):
    data = [
        (datetime(2026, 3, 16, 9), "u1", "sales", "s", 10.0, "ok", None, 1),
        (datetime(2026, 3, 16, 10), "u1", "sales", "s", 20.0, "ok", None, -1),
        (datetime(2026, 3, 17, 9), "u2", "stock", "s", 99.5, "ok", None, -1),
        (datetime(2026, 3, 18, 9), "u1", "sales", "s", None, "failed", "ambiguous question", None),
        (datetime(2026, 3, 22, 23, 59), "u1", "churn", "s", 5.0, "failed", None, None),
        (datetime(2026, 3, 23), "u2", "stock", "s", 0.5, "ok", None, 1),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_top_questions(spark, log):
    certified = spark.createDataFrame([("sales",)], "question string")
    top = sorted(rows(U.top_questions(log, certified, 1)))
    assert top == [(MON, "churn", 1, 1), (date(2026, 3, 23), "stock", 1, 1)]
    counts = {(r.week, r.question): (r.asked, r.is_certified) for r in U.question_counts(log, certified).collect()}
    assert counts[MON, "sales"] == (3, True) and counts[MON, "stock"] == (1, False)


def test_users(spark, log):
    got = {r.user_id: (r.questions, r.active_days, r.is_power_user) for r in U.user_activity(log).collect()}
    assert got == {"u1": (4, 3, True), "u2": (2, 2, False)}
    people = spark.createDataFrame([("u1",), ("u9",)], "user_id string")
    assert rows(U.never_seen(log, people)) == [("u9",)]


def test_feedback(log):
    assert rows(U.feedback(log)) == [("sales", 1, 1, 0.5), ("stock", 1, 1, 0.5)]
    assert (date(2026, 3, 16), 1, 1) in rows(U.feedback_daily(log))


def test_failures_and_runtime(log):
    assert rows(U.failures(log)) == [
        (MON, "churn", "Unknown", 1),
        (MON, "sales", "ambiguous question", 1),
    ]
    got = {r.question: (r.runs, r.avg_runtime_ms, r.is_slow) for r in U.runtime(log, 20.0).collect()}
    assert got == {"stock": (2, 50.0, True), "sales": (2, 15.0, False), "churn": (1, 5.0, False)}
