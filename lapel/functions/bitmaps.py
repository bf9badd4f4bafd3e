"""Exact distinct counts of several columns in one pass over the rows, without multiplying them.

Whole-number ids are kept as bitmaps of 64 neighbours: one long per (group, id / 64), joined by OR. Longs stay in hash
aggregation, a map task hands on a row for up to 64 ids, and bitmaps of parts, of months say, OR together later. Other
ids are their own row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapel.functions.money import SUM, split_sums, whole


def word(col: str) -> Column:
    """Which run of 64 neighbours a whole number is in; negative ones, too."""
    return F.shiftright(F.col(col).cast("long"), 6)


def bit(col: str) -> Column:
    """The number's place in its run, as a long with one bit set."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, F.col(col).cast("long").bitwiseAND(F.lit(63)).cast("int"))


def distinct_counts(rows: DataFrame, by: Sequence[str], ids: Mapping[str, str], amount: str | None = None) -> DataFrame:
    """``by``, a distinct count (NULL left out) of the column ``ids[name]`` for each name, n_rows[, total, valued].

    ``total`` is the exact sum of ``amount`` and ``valued`` the number of its values, as ``functions.money`` has them.

    Rows meet the other columns' ids only as bitmaps, already combined in the map tasks: the rows are read and shuffled
    once, what is left is a row per group and pair of runs of ids. Those fall apart into a row per column and run, to OR
    the runs, before bits are counted.
    """
    whole_numbers = {n: isinstance(rows.schema[c].dataType, T.IntegralType) for n, c in ids.items()}
    keys = [(word(c) if whole_numbers[n] else F.col(c)).alias(f"_k_{n}") for n, c in ids.items()]
    sums = {"n_rows": F.count(F.lit(1))}
    if amount is not None:
        sums |= {**split_sums(amount), "valued": F.count(amount)}
    bits = {f"_b_{n}": F.bit_or(bit(c)) if whole_numbers[n] else F.max(F.when(F.col(c).isNotNull(), F.lit(1).cast("long"))) for n, c in ids.items()}
    near = rows.groupBy(*by, *keys).agg(*[c.alias(n) for n, c in {**sums, **bits}.items()])

    def run(k: int, name: str) -> Column:
        key = F.col(f"_k_{name}")
        sides = (key, F.lit(None).cast("string")) if whole_numbers[name] else (F.lit(None).cast("long"), key.cast("string"))
        own = [F.col(s) if k == 0 else F.lit(None).cast(near.schema[s].dataType) for s in sums]
        fields = (F.lit(k), *sides, F.col(f"_b_{name}"), *own)
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("_column", "_run", "_text", "_bits", *sums), strict=True)])

    apart = near.select(*by, F.inline(F.array(*[run(k, n) for k, n in enumerate(ids)])))
    merged = {s: F.sum(s) for s in sums} | ({"large": F.sum("large").cast(SUM)} if amount is not None else {})
    runs = apart.groupBy(*by, "_column", "_run", "_text").agg(F.bit_or("_bits").alias("_bits"), *[c.alias(s) for s, c in merged.items()])
    counts = [F.coalesce(F.sum(F.when(F.col("_column") == k, F.bit_count("_bits"))), F.lit(0)).alias(n) for k, n in enumerate(ids)]
    out = runs.groupBy(*by).agg(*counts, *[c.alias(s) for s, c in merged.items()])
    figures = ["n_rows"]
    if amount is not None:
        figures += [whole(F.col("high"), F.col("low"), F.col("large")).alias("total"), "valued"]
    return out.select(*by, *ids, *figures)
