"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditions.

Sequential covering: a rule for bad documents grows one threshold at a time by information gain on two thirds of the
labelled rows, is pruned from its end on the last third, and is kept only if it is precise there; then the rows it
covers go and the next rule grows. The list becomes one CASE expression. Labelled rows are sampled by a hash of their
id down to a documented bound; statistics and verdicts cover every document and whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapel.llm.common import _BLANK, by_position, flat, named_as, slices

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks"]
_PREFIX = "__quality_"


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL, _CAPITAL, _DIGIT, _MARK = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"!?")
_CONTINUES = np.arange(256) & 0xC0 == 0x80


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of consecutive words found twice or more, the first time included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    covered, upto = 0, 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered += i + window - max(upto, i)
            upto = i + window
    return covered


def _statistics(column: pa.Array) -> list[np.ndarray]:
    """One array for each of STATISTICS."""
    data, offsets = flat(column)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

    raw = data.tobytes()
    n_words, n_dup, n_repeat, n_lines = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = raw[a:b].split()
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        n_words.append(len(words))
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
        n_repeat.append(repeated_words(words))
    chars = count(~_BLANK[data] & ~_CONTINUES[data])
    return [np.array(n_words, np.int64), chars, count(_SYMBOL[data]), np.array(n_dup, np.int64), np.array(n_repeat, np.int64), np.array(n_lines, np.int64), count(_CAPITAL[data]), count(_DIGIT[data]), count(_MARK[data])]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a column per statistic, under a prefix that no table uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            found = _statistics(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, *(_PREFIX + s for s in STATISTICS)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(_PREFIX + s, LongType()) for s in STATISTICS)]))


def statistic(name: str) -> Column:
    return F.col(_PREFIX + name)


def features() -> dict[str, Column]:
    """What a rule may compare with a threshold."""
    words, chars, lines = (F.greatest(statistic(s), F.lit(1)).cast("double") for s in ("n_words", "word_chars", "n_lines"))
    return {
        "words": statistic("n_words").cast("double"),
        "word_length": statistic("word_chars") / words,
        "symbols_per_word": statistic("n_symbols") / words,
        "repeated_line_share": statistic("n_dup_lines") / lines,
        "repeated_word_share": statistic("n_repeat_words") / words,
        "capital_share": statistic("n_capitals") / chars,
        "digit_share": statistic("n_digits") / chars,
        "marks_per_word": statistic("n_marks") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.at_least else x < self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the highest gain over the rows still covered; ties go to the first feature and threshold."""
    p, n = int(bad.sum()), int((~bad).sum())
    before = np.log2(p / (p + n))
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below_p, below_n = np.cumsum(b)[cuts - 1], np.cumsum(~b)[cuts - 1]
        for at_least, cp, cn in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - before), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, at_least, float((v[cuts[k] - 1] + v[cuts[k]]) / 2)))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < most and bad[covered].any() and (~bad[covered]).any():
        condition = _best_condition({k: v[covered] for k, v in x.items()}, bad[covered])[1]
        if condition is None:
            break
        rule += (condition,)
        covered &= condition.holds(x[condition.feature])
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it has not seen; of equals, the shortest."""

    def worth(length: int) -> float:
        covered = _covers(rule[:length], x, len(bad))
        p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 5) -> list[Rule]:
    """Ordered rules for bad rows. Deterministic: rows are split by their id's hash, and ties have a fixed order."""
    order = np.lexsort((ids,))
    x, bad, ids = {k: v[order] for k, v in x.items()}, bad[order], ids[order]
    hold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    hold = hold % np.uint64(3) == 0
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, test = left & ~hold, left & hold
        if bad[grow].sum() < min_covered or not (~bad[grow]).any():
            break
        rule = _prune(_grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions), {k: v[test] for k, v in x.items()}, bad[test])
        covered = _covers(rule, x, len(bad)) & left
        p, n = int(bad[covered & hold].sum()), int((~bad[covered & hold]).sum())
        if not rule or bad[covered].sum() < min_covered or p < (p + n) * min_precision or p + n == 0:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that matches rejects, a row that none matches stays."""
    out = None
    for rule in rules:
        matches = F.lit(True)
        for c in rule:
            matches = matches & c.column()
        out = F.when(matches, F.lit(False)) if out is None else out.when(matches, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> list[Rule]:
    """Rules from about `most` labelled rows at most, chosen by a hash of the id; quality 0 is bad, null is no label.

    The sample alone is gathered: its ids decide which documents are read for it, and only numbers reach the driver.
    """
    rated = labels.filter("quality IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min("quality").alias("__quality"))
    total = rated.count()
    if not total:
        return []
    share = min(1 << 20, (most << 20) // total)

    def chosen(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 20)) < share

    rows = docs.filter(chosen(id_col)).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = with_statistics(rows, "__text").select("__id", *(c.alias(k) for k, c in features().items()))
    table = rows.join(rated.filter(chosen("__id")), "__id").toPandas()
    if table.empty:
        return []
    return learn_rules({k: table[k].to_numpy(np.float64) for k in features()}, table["__quality"].to_numpy() == 0, table["__id"].to_numpy(np.int64))


def base_failed(least_words: int = 50, most_repeated_percent: int = 50) -> Column:
    return (statistic("n_words") < least_words) | (100 * statistic("n_repeat_words") > most_repeated_percent * statistic("n_words"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, the five base statistics, base_failed, kept.

    Null text counts as empty and fails the base test, as every text of under 50 words does. Without labelled rows, or
    without a precise rule, the base test alone decides. Labels that contradict each other count as bad. Repeated rows
    get equal results; other columns are not read.
    """
    rules = learn(docs, labels, id_col, text_col, sample)
    rows = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")), "__text")
    base = [statistic(s).alias(s) for s in STATISTICS[:5]]
    return rows.select("doc_id", *base, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> DataFrame:
    """The documents that `quality` keeps, all columns whatever their names; null and empty texts, which fail the base
    test, go. Repeated rows stay repeated or all go. An empty table gives no rows."""
    rules = learn(docs, labels, id_col, text_col, sample)
    rows, (text,) = by_position(docs, text_col)
    return named_as(with_statistics(rows, text).filter(~base_failed() & verdict(rules)), docs)
