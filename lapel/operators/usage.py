"""Reports over a query-usage log: what is asked, by whom, how it is rated, what fails, what is slow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.functions.money import mean, money, share
from lapel.operators.ranking import top_in_group


def _period(unit: str):
    return F.date_trunc(unit, "ts").cast("date")


def question_counts(log: DataFrame, certified: DataFrame) -> DataFrame:
    """week, question, asked, is_certified."""
    counts = log.groupBy(_period("week").alias("week"), "question").agg(F.count(F.lit(1)).alias("asked"))
    marks = certified.distinct().withColumn("is_certified", F.lit(True))
    out = counts.join(marks, "question", "left")
    return out.select("week", "question", "asked", F.coalesce("is_certified", F.lit(False)).alias("is_certified"))


def top_questions(log: DataFrame, certified: DataFrame, n: int = 5) -> DataFrame:
    """The most-asked questions per week that are not certified yet."""
    counts = log.groupBy(_period("week").alias("week"), "question").agg(F.count(F.lit(1)).alias("asked"))
    open_ones = counts.join(certified.select("question"), "question", "left_anti")
    return top_in_group(open_ones, ["week"], "asked", "question", n).select(
        "week", "question", "asked", "rank"
    )


def user_activity(log: DataFrame, power_days: int = 3) -> DataFrame:
    """month, user_id, questions, active_days, is_power_user (active on at least ``power_days`` days)."""
    out = log.groupBy(_period("month").alias("month"), "user_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_distinct(F.to_date("ts")).alias("active_days")
    )
    return out.withColumn("is_power_user", F.col("active_days") >= power_days)


def never_seen(log: DataFrame, roster: DataFrame) -> DataFrame:
    """Users on the roster who never asked anything. The log is made distinct before it is joined."""
    return roster.join(log.select("user_id").distinct(), "user_id", "left_anti")


def feedback(log: DataFrame) -> DataFrame:
    """question, up, down, up_rate of rated answers, lowest rate first."""
    rated = log.filter(F.col("rating").isNotNull())
    up = F.count_if(F.col("rating") > 0)
    out = rated.groupBy("question").agg(
        up.alias("up"), F.count_if(F.col("rating") < 0).alias("down"), share(up, F.count("rating")).alias("up_rate")
    )
    return out.orderBy("up_rate", F.desc("down"), "question")


def feedback_daily(log: DataFrame) -> DataFrame:
    """day, up, down."""
    rated = log.filter(F.col("rating").isNotNull())
    return rated.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down")
    )


def failures(log: DataFrame) -> DataFrame:
    """week, question, failure_cause, failures; most frequent first. An unnamed cause is 'Unknown'."""
    bad = log.filter(F.col("status") == "failed")
    cause = F.coalesce("failure_cause", F.lit("Unknown")).alias("failure_cause")
    out = bad.groupBy(_period("week").alias("week"), "question", cause).agg(F.count(F.lit(1)).alias("failures"))
    return out.orderBy("week", F.desc("failures"), "question", "failure_cause")


def runtime(log: DataFrame, slow_ms: float) -> DataFrame:
    """month, question, runs, avg_runtime_ms, is_slow; slowest first."""
    out = log.groupBy(_period("month").alias("month"), "question").agg(
        F.count("runtime_ms").alias("runs"), money(mean("runtime_ms")).alias("avg_runtime_ms")
    )
    out = out.withColumn("is_slow", F.col("avg_runtime_ms") > slow_ms)
    return out.orderBy("month", F.desc("avg_runtime_ms"), "question")
