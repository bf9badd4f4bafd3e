"""Shared helpers: intermediate tables, and a text column as flat numpy arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five control characters that end a word; bytes.split() without an argument splits at the same six.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lapel-llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_texts(rows: DataFrame, documents: int = 2_000, characters: int = 8_192) -> list[str]:
    """At most so many sampled texts, of each the first characters: for balance, never for results."""
    share = min(1.0, 2 * documents / max(rows.count(), 1))
    return [r["text"] for r in rows.sample(share, seed=8).limit(documents).select(F.substring("text", 1, characters).alias("text")).collect()]


def by_position(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns named by their position, so that no name clashes, and what the given columns are called then."""
    at = [k for n in names for k, c in enumerate(docs.columns) if c == n or c.lower() == n.lower()]
    if len(at) != len(names):
        raise ValueError(f"no column, or several, for one of {', '.join(names)}")
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), [f"c{k}" for k in at]


def named_as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `by_position` under their own names again, and no others."""
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Hands freed memory back to the system, where the C library can; a worker's peaks then do not add up."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


@lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after the other, and their n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most so many text bytes (or one row)."""
    for batch in batches:
        offsets = flat(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def ranges(starts: np.ndarray, counts: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of starts[1], and so on."""
    total = int(counts.sum())
    out = np.repeat((np.asarray(starts) - (np.cumsum(counts) - counts)).astype(kind), counts)
    out += np.arange(total, dtype=kind)
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and for each text the number of words before it (n + 1 numbers).

    `outside` says for each of the 256 bytes whether it parts words.
    """
    blank = outside[data]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = ~blank
    first[1:] &= blank[:-1]
    first[inner] = ~blank[inner]
    last = ~blank
    last[:-1] &= blank[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = ~blank[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def take_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The named stretches of the data, one after the other."""
    small = len(data) < 2**31 and int(lengths.sum()) < 2**31
    return data[ranges(starts, lengths, np.int32 if small else np.int64)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values
