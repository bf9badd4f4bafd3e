"""Exact deduplication by Grace hashing.

Equal texts meet in one shuffle partition (hash of the content). A task there streams its records into an
open-addressing table that compares complete content; once the distinct contents outgrow the memory bound, table and
input go to spill files by the next digit of the digest, and each file is handled the same way, recursively.

Copies are combined within each batch before the shuffle, so a text that makes up a third of all rows sends one record
per batch. Only (digest, keeper, size) leaves the table; rows get it by a join on narrow columns, which Spark can split
where one digest is hot.
"""

from __future__ import annotations

import marshal
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapel.llm.common import by_position, named_as, partitions_of

Record = tuple[str, bytes, int | None, int]  # digest, content, least id, rows
_ENTRY = pa.schema([("digest", pa.string()), ("content", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
_GROUP = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class ContentTable:
    """Open addressing with linear probing over complete contents; the digest only says where to look."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64).tolist()
        self.entries: list[list] = []
        self.bytes = 0

    def find(self, digest: str, content: bytes) -> int:
        """The slot that holds the content, or the empty one where it belongs."""
        mask = len(self.slots) - 1
        at = int(digest[:15], 16) & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == digest and entry[1] == content:
                return at
            if entry[0] == digest:
                raise ValueError(f"two contents share the SHA-256 {digest}")
            at = (at + 1) & mask
        return at

    def merge(self, slot: int, least: int | None, n: int) -> None:
        entry = self.entries[self.slots[slot]]
        entry[2] = least if entry[2] is None else entry[2] if least is None else min(entry[2], least)
        entry[3] += n

    def insert(self, slot: int, record: Record) -> None:
        self.slots[slot] = len(self.entries)
        self.entries.append(list(record))
        self.bytes += len(record[1]) + 200
        if 2 * len(self.entries) > len(self.slots):
            entries, self.slots = self.entries, [-1] * (4 * len(self.slots))
            for i, entry in enumerate(entries):
                self.slots[self.find(entry[0], entry[1])] = i


def grace(records: Iterator[Record], memory: int, level: int = 0) -> Iterator[Record]:
    """One record per distinct content, with the least id and the number of rows; `memory` bounds a table's bytes."""
    table = ContentTable()
    for digest, content, least, n in records:
        slot = table.find(digest, content)
        if table.slots[slot] >= 0:
            table.merge(slot, least, n)
        elif table.entries and table.bytes + len(content) > memory and level < 40:
            rest = ((digest, content, least, n), *(tuple(x) for x in table.entries))
            del table
            yield from _spilled(rest, records, memory, level)
            return
        else:
            table.insert(slot, (digest, content, least, n))
    yield from map(tuple, table.entries)


def _spilled(first: tuple[Record, ...], records: Iterator[Record], memory: int, level: int) -> Iterator[Record]:
    """The records, dealt to 16 files by the digest's next digit (the first 15 place entries in the table)."""
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = {c: f"{folder}/{c}" for c in "0123456789abcdef"}
        files = {c: open(p, "wb") for c, p in paths.items()}  # noqa: SIM115
        for source in (iter(first), records):
            for record in source:
                marshal.dump(record, files[record[0][20 + level]])
        del first
        for f in files.values():
            f.close()
        for path in paths.values():
            with open(path, "rb") as f:
                yield from grace(_reread(f), memory, level + 1)


def _reread(f) -> Iterator[Record]:
    while True:
        try:
            yield marshal.load(f)
        except EOFError:
            return


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal contents of a batch as one record."""
    for batch in batches:
        if batch.num_rows:
            grouped = pa.table(batch).group_by(["digest", "content"], use_threads=False).aggregate([("id", "min"), ("n", "sum")])
            grouped = grouped.rename_columns(["digest", "content", "id", "n"]).cast(_ENTRY)
            yield from grouped.combine_chunks().to_batches()


def _grace_task(memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in _ENTRY.names), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for digest, _, least, n in grace(records(batches), memory):
            out.append((digest, least, n))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _GROUP.types, strict=True)], schema=_GROUP)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _GROUP.types, strict=True)], schema=_GROUP)

    return run


def normalised(text: str | Column) -> Column:
    """Each run of blanks as one space; null as empty. (Single spaces are left out of the search: they stay as they are.)"""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_of(text: str | Column) -> Column:
    return F.sha2(normalised(text), 256)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (the least id, null if all are null), group_size."""
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("text"))
    entries = norm.select(F.sha2("text", 256).alias("digest"), F.col("text").cast("binary").alias("content"), "id", F.lit(1).cast("long").alias("n"))
    combined = entries.mapInArrow(_combine, "digest string, content binary, id long, n long")
    dealt = combined.repartition(partitions_of(docs.sparkSession), "digest")
    return dealt.mapInArrow(_grace_task(memory_bytes), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null id comes after all others. Of rows that repeat both id and text one is kept.
    Other columns are not read. An empty table gives no rows.
    """
    groups = content_groups(docs, id_col, text_col, memory_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("text_sha256"))
    rows = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    marked = rows.join(groups, "text_sha256").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return marked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def row_key(digest: Column, id_col: str) -> Column:
    """Tells rows apart that differ in id or text."""
    return F.concat_ws("/", digest, F.col(id_col).cast("long"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns whatever their names, without the rows that exact_dedup drops.

    Null text counts as empty and stays null; a null id comes after all others. Of rows that repeat both id and text one
    stays. An empty table gives no rows.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(row_key(F.col("text_sha256"), "doc_id").alias("key"))
    rows, (own, text) = by_position(docs, id_col, text_col)
    return named_as(first_of_each(rows.withColumn("key", row_key(digest_of(text), own)), kept), docs)


def first_of_each(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Of the rows with each key that is kept, one."""
    met = rows.join(kept, "key", "left_semi")
    return met.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key"))).filter("nth = 1")


def oracle() -> str:
    return r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """
