"""Does a query's answer equal the expected one, and how good is a run of a question set?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Verdicts and bands. The bands are for ten questions: 8 or more, 5 to 7, fewer than 5.
PASS, PARTIAL, FAIL = "Pass", "Partial", "Fail"
READY, IMPROVE, REVIEW = "production-ready", "add certified queries", "review instructions"


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: rows missing from ``actual`` and rows it has in excess, duplicates counted.

    Columns are compared by position, numbers by value whatever their type. Both sides are counted together under one
    grouping (NULL equals NULL), which combines map-side; no join, no sort.
    """
    names = [f"c{i}" for i in range(len(expected.columns))]
    both = expected.toDF(*names).withColumn("_d", F.lit(1)).union(actual.toDF(*names).withColumn("_d", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("_d").alias("_d"))
    return left.agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("extra_rows"),
    )


def _alike(expected: DataFrame, actual: DataFrame) -> bool:
    """Same number of columns, each of one type or both numbers."""
    a, b = [f.dataType for f in expected.schema], [f.dataType for f in actual.schema]
    number = T.NumericType
    return len(a) == len(b) and all(x == y or isinstance(x, number) and isinstance(y, number) for x, y in zip(a, b))


def fingerprint(answer: DataFrame, types: Sequence[T.DataType]) -> tuple:
    """Number of rows, and sums over the rows of two hashes of each: whatever the order, equal for equal rows.

    The columns are taken as the given types, -0.0 as 0.0. One aggregate without a shuffle of rows: a line per task.
    """
    names = [f"c{i}" for i in range(len(types))]
    real = (T.DoubleType, T.FloatType)
    cols = [F.col(n).cast(t) + F.lit(0.0).cast(t) if isinstance(t, real) else F.col(n).cast(t) for n, t in zip(names, types, strict=True)]
    null = F.array(*[F.col(n).isNull() for n in names])  # a hash passes over nulls
    sums = [F.sum(F.xxhash64(F.lit(seed), null, *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(answer.toDF(*names).agg(F.count(F.lit(1)), *sums).first())


def surely_differ(expected: DataFrame, actual: DataFrame) -> bool:
    """Whether fingerprints tell the answers apart; they are worked out here and now. Equal ones prove nothing."""
    types = [f.dataType for f in expected.union(actual).schema]
    return fingerprint(expected, types) != fingerprint(actual, types)


def score_answer(expected: DataFrame, actual: DataFrame, counts: bool = True) -> DataFrame:
    """One row: verdict, missing_rows, extra_rows.

    Pass: the plans mean the same, hence so do the results, and nothing is run. Partial: another plan, the same
    rows. Fail: other rows or other columns. Without ``counts``, answers whose fingerprints differ fail at once, with the
    two numbers unknown; others are compared row by row.
    """
    spark = expected.sparkSession
    if expected.sameSemantics(actual):
        return _line(spark, PASS)
    if not _alike(expected, actual) or not counts and surely_differ(expected, actual):
        return _line(spark, FAIL)
    diff = differences(expected, actual)
    clean = (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)
    return diff.select(F.when(clean, PARTIAL).otherwise(FAIL).alias("verdict"), "missing_rows", "extra_rows")


def _line(spark: SparkSession, verdict: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = zero if verdict == PASS else F.lit(None).cast("long")
    return spark.range(1).select(F.lit(verdict).alias("verdict"), rows.alias("missing_rows"), rows.alias("extra_rows"))


def score_answers(pairs: dict[str, tuple[DataFrame, DataFrame]], counts: bool = True) -> DataFrame:
    """question_id, verdict, missing_rows, extra_rows for (expected, actual) per question, each by ``score_answer``."""
    out = None
    for question, (expected, actual) in pairs.items():
        line = score_answer(expected, actual, counts).select(F.lit(question).alias("question_id"), "*")
        out = line if out is None else out.unionByName(line)
    return out


def band(passed: Column, total: Column) -> Column:
    """Band of a run, scaled from ten questions to ``total``."""
    share = passed * 10
    return F.when(share >= total * 8, READY).when(share >= total * 5, IMPROVE).otherwise(REVIEW)


def score_benchmark(verdicts: DataFrame) -> DataFrame:
    """run_id, questions, passed, band from (run_id, question_id, verdict)."""
    out = verdicts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("verdict") == PASS).alias("passed")
    )
    return out.withColumn("band", band(F.col("passed"), F.col("questions")))


def score_compare(verdicts: DataFrame, before: str, after: str) -> DataFrame:
    """question_id, before, after, regressed, improved for two runs; a question missing from a run has NULL there.

    A question regressed if it passed before and does not now. One pass: verdicts count as numbers, one per run.
    """
    code = F.when(F.col("verdict") == FAIL, 0).when(F.col("verdict") == PARTIAL, 1).when(F.col("verdict") == PASS, 2)
    runs = {"_before": before, "_after": after}
    both = verdicts.filter(F.col("run_id").isin(before, after)).groupBy("question_id")
    both = both.agg(*[F.max(F.when(F.col("run_id") == run, code)).alias(name) for name, run in runs.items()])

    def label(name: str) -> Column:
        return F.when(F.col(name) == 0, FAIL).when(F.col(name) == 1, PARTIAL).when(F.col(name) == 2, PASS)

    out = both.select("question_id", label("_before").alias("before"), label("_after").alias("after"))
    was = F.coalesce(F.col("before") == PASS, F.lit(False))
    now = F.coalesce(F.col("after") == PASS, F.lit(False))
    return out.select(
        "question_id", "before", "after", (was & ~now).alias("regressed"), (~was & now).alias("improved")
    )


def score_delta(verdicts: DataFrame, before: str, after: str) -> DataFrame:
    """One row: passes before and after, their difference, regressions, improvements."""
    return score_compare(verdicts, before, after).agg(
        F.count_if(F.col("before") == PASS).alias("passed_before"),
        F.count_if(F.col("after") == PASS).alias("passed_after"),
        (F.count_if(F.col("after") == PASS) - F.count_if(F.col("before") == PASS)).alias("delta"),
        F.count_if("regressed").alias("regressions"),
        F.count_if("improved").alias("improvements"),
    )
