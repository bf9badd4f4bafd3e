"""Source divergence audit: how far the sources of a language lie from each other, and which terms set each apart.

Terms are runs of letters and of anything beyond ASCII. One bytes.translate lowers A-Z and turns every separator into a
blank, bytes.split gives the words, and a Counter per document gives its counts; a task adds documents up per language
and source before anything is shuffled. Counts stay sparse: a term that a source lacks is never a row, its probability
is the source's floor and is filled in where blocks of sources meet blocks of terms, in numpy, in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapel.llm.common import materialise, partitions_of, slices

#: A-Z to a-z; everything else below 0x80 that is no letter to a blank; bytes of longer characters as they are.
LOWER_OR_BLANK = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCALE = 1_000_000_000
_COUNTS = "lang string, source string, term string, docs long, n long"
_PART = "lang string, a string, b string, value long, seen long, floor long, terms long"


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = 300_000) -> DataFrame:
    """lang, source, term, docs, n: sums of a task over its documents, and a row without term for each group it met.

    Null text, lang and source count as ''. A task holds at most about `most` counts (or one document's) and hands
    them on when there are more, so a term may have several rows.
    """

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (have, total) in held.items():
            terms = [None, *have]
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *have.values()], pa.int64()), pa.array([0, *(total[t] for t in have)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches, "text", 8 << 20):
            texts, langs, sources = (batch.column(c).to_pylist() for c in ("text", "lang", "source"))
            # group after group: the counts of one are at hand while its documents are added
            for lang, source, k in sorted(zip(langs, sources, range(len(texts)), strict=True)):
                words = texts[k].translate(LOWER_OR_BLANK).split()
                own = Counter(words)
                have, total = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(have)
                have.update(own.keys())
                total.update(words)  # as adding `own` does, in one C loop
                size += len(have) - before
                if size > most:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def known(name: str, kind: str = "string") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).cast(kind)

    whole = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), known(text_col, "binary").alias("text"))
    return whole.mapInArrow(run, _COUNTS)


def _probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null where there are no terms."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of distances over one block of terms, for each pair of sources that this pair of blocks is for.

    Rows without term say which sources there are and their probability of a term that they lack. The table filled in
    here has the sources of two blocks by those terms of one that any of them holds: `seen` of them. Any other term lies
    `floor` apart.
    """
    one, other = rows["one"].iloc[0], rows["other"].iloc[0]
    groups = rows[rows["term"].isna()].sort_values("source")
    own = rows[rows["term"].notna()]
    names, blocks = groups["source"].to_numpy(), groups["block"].to_numpy()
    code, terms = pd.factorize(own["term"])
    least = groups["p"].fillna(1).to_numpy(np.int64)
    dense = np.repeat(least[:, None], len(terms) + 1, axis=1)  # the last column: a term that none of them holds
    dense[np.searchsorted(names, own["source"].to_numpy()), code] = own["p"].to_numpy(np.int64)
    out = []
    for a in np.flatnonzero(blocks == one):
        rest = np.flatnonzero(blocks == other)
        rest = rest[rest > a] if one == other else rest
        gap = dense[rest] - dense[a]
        apart = gap * gap // (dense[rest] + dense[a])
        out.append(pd.DataFrame({"a": names[a], "b": names[rest], "value": apart[:, :-1].sum(axis=1), "floor": apart[:, -1]}))
    found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": [], "floor": []})
    return found.assign(lang=rows["lang"].iloc[0], seen=len(terms), terms=rows["terms"].iloc[0])[["lang", "a", "b", "value", "seen", "floor", "terms"]]


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, block_sources: int = 256, block_cells: int = 1 << 15) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every (lang, source) group.

    A language keeps the terms that at least `least_docs` of its documents hold. A group's p of a kept term with count c
    is 1 + floor(10^9 (c + 2) / (N + 2 V)), N being its count of all V kept terms; the language has such numbers, too. Two
    numbers are floor((p - q)^2 / (p + q)) apart. Part `pair` has each other source of the language, its distance summed
    over all kept terms; part `term` the `top` terms that the group holds and has a greater p of than its language. Ranks
    go by value downwards, then by the item's bytes.

    Null text, lang and source count as ''; a document without terms makes its group occur all the same; a language
    without kept terms has pairs of distance 0. Rows that repeat count each. An empty table gives no rows; other columns
    are not read. Each (lang, term) has a row per source at most once tasks have added up, so neither a hot source nor
    a hot term outweighs others; a block holds about `block_cells` numbers, or 16 terms for each pair of its sources, however
    many terms and sources there are.
    """
    n = partitions_of(docs.sparkSession)
    spread = term_counts(docs, text_col, lang_col, source_col).repartition(n, "lang", "term")
    sums = spread.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    over = Window.partitionBy("lang", "term")
    wide = sums.withColumns({"lang_docs": F.sum("docs").over(over), "lang_n": F.sum("n").over(over)})
    kept = materialise(wide.filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"), "terms")

    counted = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(~counted).alias("sources"))
    terms = kept.filter(counted).select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = langs.join(terms, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    facts = materialise(groups.join(langs, "lang"), "groups")  # a row per group

    rows = kept.join(facts, ["lang", "source"]).select(
        "lang", "source", "term", "n", "sources", "terms",
        _probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )

    def ranked(found: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    apart = rows.filter(counted & (F.col("p") > F.col("q")))
    telling = ranked(apart.select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value")), "term")
    telling = telling.filter(F.col("rank") <= top)

    # every source of a language meets every block of its terms; with many sources, two blocks of them at a time
    blocks = F.ceil(F.col("sources") / block_sources).cast("int")
    side = F.least("sources", F.lit(2 * block_sources))
    slots = F.greatest(F.lit(1), F.ceil(F.col("terms") * side / F.greatest(F.lit(block_cells), 16 * side * side))).cast("int")
    mine = F.pmod(F.xxhash64("source"), blocks).cast("int")
    slot = F.when(counted, F.array(F.pmod(F.xxhash64("term"), slots).cast("int"))).otherwise(F.sequence(F.lit(0), slots - 1))
    dealt = rows.select("lang", "source", "term", "p", "terms", mine.alias("block"), blocks.alias("blocks"), F.explode(slot).alias("slot"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = dealt.withColumns({"one": F.least("block", "mate"), "other": F.greatest("block", "mate")}).drop("mate")
    parts = dealt.groupBy("lang", "slot", "one", "other").applyInPandas(_block_sums, _PART)
    unseen = F.max("terms") - F.sum("seen")
    pairs = parts.groupBy("lang", "a", "b").agg((F.sum("value") + unseen * F.max("floor")).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    return ranked(pairs, "pair").unionByName(telling)


def oracle() -> str:
    return r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p,
                     1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
                   LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM y)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(n AS INTEGER) AS rank
        FROM z WHERE part = 'pair' OR n <= 10
    """
