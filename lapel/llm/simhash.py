"""Near-duplicates by SimHash fingerprints and a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d < 8 bits agree in at least 8 - d of their 8 positional bytes. The
index lists the distinct fingerprints under combinations of positional bytes; the combinations are chosen so that any
8 - d positions hold one of them. Within a list the shared bytes of each pair are tallied, pairs below the guaranteed
minimum go, and the rest are verified by their differing bits. A list hands on links that join something new only,
never all of its pairs. Lists longer than a bound are cut in chunks, and each pair of chunks is a task's group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapel.llm.common import by_position, materialise, named_as, partitions_of, slices
from lapel.llm.components import components
from lapel.llm.exact_dedup import first_of_each, row_key

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """64 bits; one is set if it is set in over half of the shingles' XXH64. Few words: one shingle; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    xxh64 = xxhash.xxh64_intdigest
    hashes = [xxh64(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""
    return _with_prints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), shingle, seed)


def _with_prints(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """fp in the place of the text, the last column, beside the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(np.array(found, np.uint64).view(np.int64)))

    return rows.mapInArrow(run, StructType([*(f for f in rows.schema if f.name != "text"), StructField("fp", LongType())]))


def covering(shared: int) -> list[tuple[int, ...]]:
    """Combinations of the 8 positions such that any `shared` positions hold at least one of them.

    For 4 or more: triples. With the positions in three cyclic parts, those inside a part and those with two in a part
    and one in the next: any four positions hold one of these twenty.
    """
    if shared < 4:
        return list(combinations(range(8), shared))
    part = (0, 0, 0, 1, 1, 1, 2, 2)

    def chosen(t: tuple[int, ...]) -> bool:
        kinds = sorted(part[i] for i in t)
        counts = [kinds.count(p) for p in range(3)]
        return 3 in counts or any(counts[p] == 2 and counts[(p + 1) % 3] == 1 for p in range(3))

    return [t for t in combinations(range(8), 3) if chosen(t)]


def _key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def links(nodes: DataFrame, bits: int = 4, block: int = 16_384) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` at most `bits` apart: enough of them to connect all that are linked."""
    if not 0 <= bits < 8:
        raise ValueError("bits must be 0 to 7: beyond that, no positional byte need be shared")
    cover = covering(8 - bits)
    listed = nodes.select("fp", F.explode(F.array(*(_key(F.col("fp"), i, t) for i, t in enumerate(cover)))).alias("key"))
    long = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    chunks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    cut = listed.join(long, "key", "left").select("key", "fp", chunks.alias("c"))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    paired = cut.select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    grouped = paired.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    dealt = grouped.repartition(partitions_of(nodes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_link_task(8 - bits, bits), "u long, v long")


def _linked(x: np.ndarray, shared: int, bits: int) -> np.ndarray:
    """Of XORs of pairs: the byte tally reaches the guaranteed minimum, and the bits confirm it."""
    tally = np.zeros(x.shape, np.uint8)
    for p in range(8):
        tally += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    return (tally >= shared) & (np.bitwise_count(x) <= bits)


class _Forest:
    """Union-find; `join` says if two nodes were apart. Forgets all beyond a bound, which only repeats some edges."""

    def __init__(self, most: int = 500_000) -> None:
        self.parent: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        if len(self.parent) > self.most:
            self.parent = {}
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
        return ra != rb


def _group_links(fps: np.ndarray, chunk: np.ndarray, shared: int, bits: int) -> Iterator[tuple[int, int]]:
    """Links of one long list; the members' labels tell which add a connection."""
    two = chunk[0] != chunk[-1] or bool((chunk != chunk[0]).any())
    label = np.arange(len(fps))
    left = np.flatnonzero(chunk == chunk.min()) if two else np.arange(len(fps))
    right = np.flatnonzero(chunk != chunk.min()) if two else left
    for i in left.tolist():
        others = right if two else right[i + 1 :]
        near = others[_linked(fps[others] ^ fps[i], shared, bits)]
        apart, first = np.unique(label[near], return_index=True)
        for k in np.flatnonzero(apart != label[i]).tolist():
            yield int(fps[i]), int(fps[near[first[k]]])
            label[label == apart[k]] = label[i]


def _link_task(shared: int, bits: int, small: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(groups: np.ndarray, chunk: np.ndarray, fps: np.ndarray, forest: _Forest) -> Iterator[tuple[int, int]]:
        """Links of whole groups, sorted by group."""
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(groups)])
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            yield from _group_links(fps[s : s + n], chunk[s : s + n], shared, bits)
        left = np.repeat(sizes, sizes) - (np.arange(len(groups)) - np.repeat(starts, sizes))  # members from here on
        left[np.repeat(sizes, sizes) > small] = 0
        for step in range(1, small):
            at = np.flatnonzero(left > step)
            if not len(at):
                break
            at = at[_linked(fps[at] ^ fps[at + step], shared, bits)]
            for a, b in zip(fps[at].tolist(), fps[at + step].tolist(), strict=True):
                if forest.join(a, b):
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = _Forest(), None
        for batch in batches:
            part = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "chunk", "fp")}
            if kept is not None:
                part = {c: np.concatenate([kept[c], part[c]]) for c in part}
            if not len(part["key"]):
                continue
            changed = np.flatnonzero((part["key"][1:] != part["key"][:-1]) | (part["i"][1:] != part["i"][:-1]) | (part["j"][1:] != part["j"][:-1]))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            kept = {c: v[cut:] for c, v in part.items()}
            yield from _edges(found(*_numbered({c: v[:cut] for c, v in part.items()}), forest)) if cut else ()
        if kept is not None and len(kept["key"]):
            yield from _edges(found(*_numbered(kept), forest))

    return run


def _numbered(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    changed = (part["key"][1:] != part["key"][:-1]) | (part["i"][1:] != part["i"][:-1]) | (part["j"][1:] != part["j"][:-1])
    return np.cumsum(np.r_[False, changed]), part["chunk"], part["fp"].view(np.uint64)


def _edges(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    found = np.array(list(pairs), np.uint64).reshape(-1, 2).view(np.int64)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_EDGE)


def _labels(prints: DataFrame, bits: int, block: int) -> DataFrame:
    """fp, root (the same for all fingerprints of a component), component_id, from rows of doc_id and fp."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), bits, block))
    tied = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    labels = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return materialise(labels, "labels")  # a side with a shuffle of its own lets Spark split the rows of a hot fingerprint


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42, block: int = 16_384) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the least id linked, directly or not).

    Null text counts as empty; a null id keeps its row and never names a component unless all its ids are null. Rows
    with equal fingerprints are one node, so repeated rows and copies cost nothing beyond their fingerprint. Other
    columns are not read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_labels(prints, bits, block), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42, block: int = 16_384) -> DataFrame:
    """One document of each component, all columns whatever their names: the one that names it.

    Of several texts under that id, the first by digest stays; of rows that repeat id and text, one; where all ids of a
    component are null, one of its rows. Rows that share an id and are of different components are judged each for
    itself. Null text counts as empty and stays null. An empty table gives no rows.
    """
    rows, (own, text) = by_position(docs, id_col, text_col)
    key = row_key(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")), 256), own)
    known = rows.select(F.col(own).cast("long").alias("doc_id"), key.alias("key"), F.col(text).cast("binary").alias("text"))
    prints = materialise(_with_prints(known, shingle, seed), "fingerprints")
    named = prints.join(_labels(prints, bits, block), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = named.groupBy("root").agg(F.min("key").alias("key")).select("key")
    return named_as(first_of_each(rows.withColumn("key", key), kept), docs)
