"""The query-usage log and what goes with it, seen in an ``events`` table.

Log rows are ``ts, user_id, question, sql, runtime_ms, status, failure_cause, rating``.
"""

from __future__ import annotations

from collections.abc import Collection
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.sources.raw import read_raw

# The published causes of failed questions, in short.
CAUSES = ("table not added", "term not defined", "ambiguous question")


def usage_log(spark: SparkSession, folder: str) -> DataFrame:
    """One log row per event; an error is a failed question. The rating is taken from the event id."""
    e = read_raw(spark, folder, "events")
    number = F.regexp_extract("props", "[0-9]+", 0)
    failed = F.col("event_type") == "error"
    cause = F.pmod("event_id", F.lit(3))
    slot = F.pmod("event_id", F.lit(5))
    return e.select(
        "ts",
        "user_id",
        F.concat(F.lit("Q"), number).alias("question"),
        F.concat(F.lit("SELECT "), number).alias("sql"),
        F.col("value").alias("runtime_ms"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed & (cause == 0), CAUSES[0])
        .when(failed & (cause == 1), CAUSES[1])
        .when(failed, CAUSES[2])
        .alias("failure_cause"),
        F.when(slot == 0, 1).when(slot == 1, -1).alias("rating"),
    )


def roster(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone who was given access: the customer keys."""
    return read_raw(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))


def certified(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with an approved query: one per nation key."""
    nation = read_raw(spark, folder, "nation")
    return nation.select(F.concat(F.lit("Q"), F.col("n_nationkey")).alias("question"))


def verdicts(spark: SparkSession, folder: str, weeks: Collection[str] = ()) -> DataFrame:
    """(run_id, question_id, verdict): each week of the log is a run; the last event of a question decides.

    With ``weeks`` (their Mondays) only those are read. Time, id and kind of an event are one number, so the last one is
    a plain maximum.
    """
    e = read_raw(spark, folder, "events")
    if weeks:
        days = [(date.fromisoformat(w), date.fromisoformat(w) + timedelta(days=7)) for w in weeks]
        first, end = min(d[0] for d in days), max(d[1] for d in days)
        e = e.filter((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    week = F.date_trunc("week", "ts").cast("date")
    code = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(17,0)")
    event = micros * F.lit(Decimal(10) ** 20) + F.col("event_id").cast("decimal(19,0)") * 10 + code
    question = F.concat(F.lit("Q"), F.regexp_extract("props", "[0-9]+", 0))
    last = e.groupBy(week.alias("week"), question.alias("question_id")).agg(F.max(event.cast("decimal(38,0)")).alias("last"))
    kind = F.pmod(F.col("last"), F.lit(10))
    label = F.when(kind == 0, "Fail").when(kind == 1, "Partial").otherwise("Pass")
    rows = last.select(F.date_format("week", "yyyy-MM-dd").alias("run_id"), "question_id", label.alias("verdict"))
    return rows.filter(F.col("run_id").isin(*weeks)) if weeks else rows
