"""Token counts by source, language and tokenizer version, kept as a rollup that signed deltas maintain.

A batch turns inserts, deletes and revised counts into signed sums per key and writes those; one small file, put in place
under the batch's name by a rename, commits them, so a batch that broke off counts for nothing and one that is there is
not counted again. Counts are additive: totals are a base plus the deltas committed since, and every so many batches
those are folded into a new base. Work grows with the changes, and reading with the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.llm.byte_bpe import encode, vocabulary
from lapel.llm.common import flat, slices, word_bounds
from lapel.sources.snapshots import Snapshot, Snapshots

KEY = ["source", "lang", "tokenizer_version"]
_DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long"
_NAMES = "batch string"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """doc_id, source, lang, words, tokens: a row per document. Null text counts as empty and has none of either."""
    path, added = vocabulary(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            words = np.diff(word_bounds(*flat(batch.column("text")))[2])
            tokens = np.diff(encode(batch.column("text"), path, added)[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(words), pa.array(tokens)], ["doc_id", "source", "lang", "words", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, words long, tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas for counts (KEY and tokens) that are new, one per row: repeated rows count each. Null tokens add none."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("documents"), F.col("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas that take back what `inserted` adds for the same rows."""
    return counts.select(*KEY, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas for documents counted anew, under the same key or another."""
    return deleted(old).unionAll(inserted(new))


def _sums(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return sums.filter("documents <> 0 OR tokens <> 0")


class TokenLedger:
    """A rollup in a shared folder. Null keys are keys like any other; an empty batch is a batch. `fold_every` batches
    are read beside the base at most, by a reader that comes after the fold."""

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = 50) -> None:
        self.spark, self.fold_every = spark, fold_every
        self.store = Snapshots(spark, folder)

    def committed(self, batch: str) -> bool:
        """Whether a batch is in, folded or not."""
        base = self.store.base()
        if base is None:
            return False
        if self.store.appended(base, batch):
            return True
        names = self.store.content(base).get("names")
        return names is not None and not self._read(_NAMES, [names]).filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the deltas under the batch's name, once; False if the batch is in the ledger already.

        Deltas sum map-side, so a key with a third of all rows is one row per task. Of two writers of one batch that
        have both written their sums, the first to commit is the batch.
        """
        if self.store.base() is None:
            with suppress(FileExistsError):  # another writer's first batch
                self.store.replace({}, None)
        if self.committed(batch):
            return False
        folder = self.store.new_folder("deltas")
        _sums(deltas).write.parquet(folder)
        added = self.store.append(batch, {"deltas": self.store.relative(folder)})
        if added and len(self.store.appends(self.store.base())) >= self.fold_every:
            with suppress(FileExistsError):  # another writer has folded
                self.fold()
        return added

    def fold(self) -> None:
        """The committed deltas become part of the base. Names of batches go to a table of their own."""
        now = self.store.current()
        if now is None or not now.appends:
            return
        content = {}
        for table, rows in (("deltas", _sums(self._read(_DELTA, self._folders(now, "deltas")))), ("names", self._names(now))):
            folder = self.store.new_folder(table)
            rows.write.parquet(folder)
            content[table] = self.store.relative(folder)
        self.store.replace(content, now.base, now.appends)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, documents, tokens; keys without documents and tokens are left out."""
        now = self.store.current()
        return _sums(self._read(_DELTA, self._folders(now, "deltas") if now else []))

    def _folders(self, now: Snapshot, table: str) -> list[str]:
        return [self.store.relative(f) for f in now.folders.get(table, [])]

    def _names(self, now: Snapshot) -> DataFrame:
        fresh = self.spark.createDataFrame([(b,) for b in now.batches], _NAMES)
        return self._read(_NAMES, self._folders(now, "names")).unionAll(fresh)

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        places = [f"{self.store.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)


def versions(counts: DataFrame, bpe: str = "byte_bpe_50k", words: str = "words") -> DataFrame:
    """Counts with a row per tokenizer version."""
    both = F.explode(F.array(F.struct(F.lit(bpe).alias("v"), F.col("tokens").alias("n")), F.struct(F.lit(words).alias("v"), F.col("words").alias("n"))))
    return counts.select("doc_id", "source", "lang", both.alias("c")).select("doc_id", "source", "lang", F.col("c.v").alias("tokenizer_version"), F.col("c.n").alias("tokens"))
