"""Exact numbering of rows without ever holding a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lapel.session import written_once

TIE_SPAN = 1 << 16


def top_in_group(df: DataFrame, group: Sequence[str], value: str, tie: str, n: int, out: str = "rank") -> DataFrame:
    """The rows of the n highest ``value`` per group (NULL last, ties by ``tie``, of any type), numbered; lazy.

    One path whatever the n: a group is dealt out in slots by a hash of ``tie`` and each slot keeps its n best, then the
    group keeps the n best of those. So a task sorts one slot of a group, and at the end n rows per slot of it, never the
    group. Where n is within Spark's bound for that, map tasks drop what cannot be among the best before both shuffles.
    """
    best_first = [F.desc_nulls_last(value), F.col(tie)]
    slot = F.pmod(F.xxhash64(tie), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = F.row_number().over(W.partitionBy(*group, slot).orderBy(*best_first))
    best = df.withColumn("_own", own).filter(F.col("_own") <= n).drop("_own")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*best_first))
    return best.withColumn(out, rank).filter(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))


def number_rows(df: DataFrame, value: str, tie: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY group ORDER BY value DESC NULLS LAST, tie), for every row; ``tie`` of any type.

    A plain window would sort a whole group in one task, and one group may hold a third of all rows. Here the rows are
    dealt out by ranges of (group, value, tie), between splitters that Spark samples, so that a group, or a value that
    most rows hold, lies in as many tasks as its size asks for. Each task sorts its range and numbers it; ranges follow
    each other, so a row's number is its place among its group's rows in its range, plus those in the ranges before: a
    prefix sum over one row per (range, group).

    The sorted rows are written to the scratch folder, since splitters differ from one evaluation to the next. ``df``
    is evaluated twice, for the sample and for the rows. Rows equal in group, value and tie are numbered in any order.
    """
    order = [*(F.col(g) for g in group), F.desc_nulls_last(value), F.col(tie)]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written_once(dealt.withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of that id are the number of the task, the lower ones that of the row in it
    ranged = placed.withColumn("_range", F.shiftright("_at", 33))
    heads = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select(*group, "_range", (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    numbered = _same(ranged, heads, [*group, "_range"])
    return numbered.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys where NULL equals NULL, keeping the left key columns."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


def running_start(df: DataFrame, key: str, amount: str, out: str, span: int = TIE_SPAN) -> DataFrame:
    """Sum of ``amount`` over all rows with a smaller ``key`` (a unique integer), for every row.

    Two levels: totals per run of ``span`` keys are added up first, then rows within their run.
    """
    keyed = df.withColumn("_run", F.expr(f"{key} div {span}"))
    runs = keyed.groupBy("_run").agg(F.sum(amount).alias("_sum"))
    before = W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_run").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("_off", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return keyed.join(runs, "_run").select(*df.columns, (F.col("_base") + F.col("_off")).alias(out))
