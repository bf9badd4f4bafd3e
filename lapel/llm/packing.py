"""Best-fit packing of token sequences under several capacities at once.

A piece is a vector: its tokens, one document, and its attention cost (the square of its tokens). A bin has a residual
in each. Pieces go longest first to the bin, of those with room in every dimension, that a weighted score prefers: the
least norm of what stays free, or the greatest dot product of piece and residual. The vector follows from the length
alone, so the whole assignment is made from the histogram of lengths: bins with equal residuals are one class, and a
step fills as many bins of a class with equal pieces as there are of both. The work on the driver depends on the number of lengths
(`max_tokens` at most), never on the number of documents; pieces find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapel.llm.byte_bpe import encode, vocabulary
from lapel.llm.common import materialise, partitions_of, slices

#: Where tokens alone bind, the other two choose among bins with equal room for tokens: at 2048 tokens one token more or
#: less weighs 2.4e-7 at least. So they change which pieces share a sequence, and not how many sequences there are.
TOKENS_FIRST = (1.0, 1e-8, 1e-8)

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """Token pieces of every document with its end id: whole, or cut so that only the first is shorter than the maximum."""
    path, added = vocabulary(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            ids, at = encode(batch.column("text"), path, added)
            rows: list[tuple] = []
            for doc, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                n = len(own)
                cuts = range(n - max_tokens * ((n - 1) // max_tokens), n + 1, max_tokens)
                start = 0
                for piece, end in enumerate(cuts):
                    rows.append((doc, piece, start, end - start, zlib.crc32(own[start:end].tobytes())))
                    start = end
            table = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k]) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE)


def best_fit(counts: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = TOKENS_FIRST, score: str = "norm") -> np.ndarray:
    """Runs (length, first rank, pieces, first bin, offset): that many pieces of a length go to consecutive bins."""
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    caps = np.array([max_tokens, max_docs, max_cost], np.float64)
    w = np.asarray(weights, np.float64)
    states: dict[tuple[int, int, int], list[list[int]]] = {}  # residuals -> [first bin, bins]
    left = np.zeros((1024, 3), np.int64)
    keys: list[tuple[int, int, int] | None] = []
    row: dict[tuple[int, int, int], int] = {}
    empty: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def add(state: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal left
        if state[0] <= 0 or state[1] <= 0 or state[2] <= 0:
            return  # nothing fits any more
        if state not in states:
            states[state] = []
            if empty:
                row[state] = empty.pop()
                keys[row[state]] = state
            else:
                row[state] = len(keys)
                keys.append(state)
                if len(keys) > len(left):
                    left = np.concatenate([left, np.zeros_like(left)])
            left[row[state]] = state
        states[state].append([first, n])

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens is beyond a capacity")
        rank, todo = 0, counts[length]
        while todo:
            now = left[: len(keys)]
            fits = np.flatnonzero((now >= item).all(axis=1))
            if len(fits):
                free = now[fits] / caps
                part = item / caps
                value = (w * (free - part) ** 2).sum(axis=1) if score == "norm" else -(w * free * part).sum(axis=1)
                state = keys[int(fits[np.argmin(value)])]
                assert state is not None
                spans = states[state]
            else:
                state = (max_tokens, max_docs, max_cost)
                spans = [[bins, todo]]  # as many new ones as it takes, todo at most
            # a bin that took a piece is now the tightest, so it takes all that it can before the next one does
            each = min(state[0] // length, state[1], state[2] // (length * length))
            while spans and todo:
                first, n = spans[-1]
                own, used = (each, min(n, todo // each)) if todo >= each else (todo, 1)
                for k in range(own):
                    runs.append((length, rank, used, first, max_tokens - state[0] + k * length))
                    rank += used
                todo -= own * used
                add((state[0] - own * length, state[1] - own, state[2] - own * length * length), first, used)
                if used == n:
                    spans.pop()
                else:
                    spans[-1] = [first + used, n - used]
                if not len(fits):
                    bins = first + used
            if len(fits) and not spans:
                at = row.pop(state)
                del states[state]
                keys[at] = None
                left[at] = -1
                empty.append(at)
    return np.array(runs, np.int64).reshape(-1, 5)


def _ranked(rows: DataFrame) -> DataFrame:
    """The pieces with their rank within their length: by hash bucket, then within it, so that no length is one task's."""
    buckets = partitions_of(rows.sparkSession)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = TOKENS_FIRST, score: str = "norm", end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Left out, max_docs and max_cost are as much as max_tokens allows, so tokens alone bind. Null and empty texts are
    pieces of the end id alone. Repeated rows are packed each for itself; a null id keeps its row. An empty table gives
    no rows; other columns are not read.
    """
    cut = materialise(pieces(docs, id_col, text_col, max_tokens, end_id, ranks_path), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_tokens rows at most
    runs = best_fit(counts, max_tokens, max_docs or max_tokens, max_cost or max_tokens**2, weights, score)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    place = runs[:, 0] << 48 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(place, length << 48 | rank, "right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = _ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return chosen.mapInArrow(run, f"{_PIECE}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, n_docs, attention_cost of each sequence of packed pieces: what the three capacities bound."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("length") * F.col("length")).alias("attention_cost")
    )
