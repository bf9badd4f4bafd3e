"""Benchmark decontamination by a distributed positional inverted index of the training texts.

The index is a table of segments, each over a few megabytes of whole documents: the segment's terms, and for each the
ascending places where it stands. Documents follow each other with one place left free between them, so nothing that
matches reaches across two. A frequent term has a list in every segment, and none that grows with the corpus.

Test items come in blocks of bounded size, one at a time; every segment answers a block by itself. A window of test words
starts from the segment's list of its rarest word, each place moved back by the word's offset, and is intersected with the
other lists, moved likewise, rarest first. What is left are exact phrases; proximity asks for the same words in any order
within a stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapel.llm.common import flat, materialise, ranges, scratch_path, slices, word_bounds

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: What parts words once A-Z are lower case: all of ASCII but digits and letters.
_OUTSIDE = np.array([c < 0x80 and not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A) for c in range(256)])

_SEGMENT = "row_ids array<long>, doc_ids array<long>, n_words array<int>, terms binary, term_ends binary, list_ends binary, places binary"
_BLOCK = "block long, items array<string>, firsts array<long>, terms binary, term_ends binary, codes binary, ends binary"
_HIT = "row long, spans array<struct<lo: int, hi: int>>, items array<string>"
_MATCH = "row long, doc_id long, start long, length long, item_id string, item_start long"



def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("lo: int, hi: int", "").split(", ")]


#: Places tried at a time.
_AT_ONCE = 1 << 21


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts as numbers, the term of each number, and the n + 1 offsets of the texts in the words."""
    data, offsets = flat(column)
    data = _LOWER[data]
    starts, ends, upto = word_bounds(data, offsets, _OUTSIDE)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = np.ascontiguousarray(data[~_OUTSIDE[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, upto


def _pack(terms: pa.Array) -> list[bytes]:
    data, offsets = flat(terms)
    return [data.tobytes(), offsets.astype(np.int64).tobytes()]


def _unpack(data: bytes, offsets: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) // 8 - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# ---- the index ----


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20, path: str | None = None) -> DataFrame:
    """The index, written to `path` (or the shared folder) and read again; a row per segment.

    Every word of every text is listed. Null text has no words; rows that repeat an id, null ids too, are documents of
    their own. An empty table gives an empty index; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", segment_bytes):
            codes, terms, upto = _coded(batch.column("text"))
            sizes = np.diff(upto)
            place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
            order = codes.astype(np.int64) << 32 | place
            order.sort()
            list_ends = np.cumsum(np.bincount(codes, minlength=len(terms)))
            blobs = [*_pack(terms), list_ends.astype(np.int64).tobytes(), (order & 0xFFFFFFFF).astype(np.int32).tobytes()]
            lists = [batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), sizes.tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], _names(_SEGMENT))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    where = path or scratch_path(docs.sparkSession, "index")
    rows.mapInArrow(run, _SEGMENT).write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(_SEGMENT).parquet(where)


def indexed_documents(index: DataFrame) -> DataFrame:
    """row, doc_id, n_words of every document of the index."""
    each = index.select(F.inline(F.arrays_zip("row_ids", "doc_ids", "n_words")))
    return each.select(F.col("row_ids").alias("row"), F.col("doc_ids").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"))


class Segment:
    """The lists of one segment that a block of test items asks for."""

    def __init__(self, row: dict, asked: pa.Array) -> None:
        self.rows = np.asarray(row["row_ids"], np.int64)
        self.ids = row["doc_ids"]
        sizes = np.asarray(row["n_words"], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.size = int(sizes.sum()) + len(sizes)
        found = pc.index_in(asked, value_set=_unpack(row["terms"], row["term_ends"])).fill_null(-1).to_numpy()
        ends = np.frombuffer(row["list_ends"], np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        there = found >= 0
        #: occurrences of each asked term, and where its list starts in `places`
        self.counts = np.zeros(len(asked), np.int64)
        self.counts[there] = ends[found[there]] - begins[found[there]]
        self.begins = np.cumsum(self.counts) - self.counts
        self.places = np.frombuffer(row["places"], np.int32)[ranges(begins[found[there]], self.counts[there])].astype(np.int64)
        #: (term, place) in order
        self.keys = np.repeat(np.arange(len(asked)), self.counts) * (1 << 32) + self.places

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.begins[term] : self.begins[term] + self.counts[term]]

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * (1 << 32) + places
        at = np.searchsorted(self.keys, wanted)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which window (a row of term numbers) starts at which place, by intersecting lists from the rarest term on."""
        counts = self.counts[windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0) if len(windows) else np.zeros(0, np.int64)
        if not len(alive):
            return
        order = np.argsort(counts[alive], axis=1, kind="stable")
        least = counts[alive, order[:, 0]]
        upto = np.cumsum(least)
        done = 0
        while done < len(alive):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + _AT_ONCE, "right")))
            which = np.repeat(np.arange(done, end), least[done:end])
            shift = order[:, 0]
            start = self.places[ranges(self.begins[windows[alive[done:end], shift[done:end]]], least[done:end])] - shift[which]
            for k in range(1, windows.shape[1]):
                shift = order[which, k]
                same = self.has(windows[alive[which], shift], start + shift)
                which, start = which[same], start[same]
            yield alive[which], start
            done = end

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """First and last place of the least stretches of at most `within` places that hold all the terms (all distinct)."""
        none = np.zeros((0, 2), np.int64)
        lists = sorted((self.list_of(t) for t in terms.tolist()), key=len)
        if not len(lists[0]):
            return none
        rare = lists[0]
        firsts = []
        for places in lists:
            at = np.searchsorted(rare, places)
            firsts.append(places[(at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] - places < within)])
        first = np.sort(np.concatenate(firsts))
        last = first
        for places in lists:
            at = np.searchsorted(places, first)
            last = np.maximum(last, np.where(at < len(places), places[np.minimum(at, len(places) - 1)], self.size + within))
        good = (last - first < within) & (self.document(first) == self.document(last))
        first, last = first[good], last[good]
        tight = np.append(last[1:] != last[:-1], True) if len(last) else np.zeros(0, bool)
        return np.column_stack([first[tight], last[tight]])


# ---- test items ----


@dataclass
class Block:
    """Test items, or parts of long ones: names, the first word's number, the terms in them, the words as numbers of terms."""

    items: list[str]
    firsts: np.ndarray
    terms: pa.Array
    codes: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        ends = np.frombuffer(row["ends"], np.int64)
        return Block(row["items"], np.array(row["firsts"], np.int64), _unpack(row["terms"], row["term_ends"]), np.frombuffer(row["codes"], np.int32), ends)

    def windows(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct windows of equal length: rows of term numbers; and who has them: upto n + 1 offsets, items, starts."""
        begins = np.concatenate([[0], self.ends[:-1]])
        sizes = self.ends - begins
        for length in np.unique(np.minimum(sizes[sizes > 0], width)).tolist():
            own = np.flatnonzero(sizes == length) if length < width else np.flatnonzero(sizes >= width)
            each = sizes[own] - length + 1
            item, start = np.repeat(own, each), ranges(np.zeros(len(own), np.int64), each)
            rows = np.ascontiguousarray(self.codes[(begins[item] + start)[:, None] + np.arange(length)])
            _, first, same = np.unique(rows.view(f"V{4 * length}").ravel(), return_index=True, return_inverse=True)
            order = np.argsort(same, kind="stable")
            upto = np.concatenate([[0], np.cumsum(np.bincount(same, minlength=len(first)))])
            yield rows[first].astype(np.int64), upto, item[order], (start + self.firsts[item])[order]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10, most_words: int = 1 << 20) -> DataFrame:
    """Items with their words in blocks of at most `most_words` words, written once.

    An item beyond a block's size goes in parts that share width - 1 words. Items without words are in no block; a null
    id counts as ''.
    """
    if not 1 <= width <= most_words:
        raise ValueError("a window has one word at least and no more than a block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", 2 * most_words):
            codes, terms, upto = _coded(batch.column("text"))
            names = batch.column("item").to_pylist()
            step = most_words - width + 1
            parts = [(names[i], a, min(a + most_words, e), a - s) for i, (s, e) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)) for a in range(s, max(s + 1, e - width + 1), step) if s < e]
            while parts:
                room, taken = most_words, 0
                while taken < len(parts) and (room := room - parts[taken][2] + parts[taken][1]) >= 0:
                    taken += 1
                now, parts = parts[:taken], parts[taken:]
                words = np.concatenate([codes[a:b] for _, a, b, _ in now])
                used, local = np.unique(words, return_inverse=True)
                blobs = [*_pack(terms.take(pa.array(used))), local.astype(np.int32).tobytes(), np.cumsum([b - a for _, a, b, _ in now]).astype(np.int64).tobytes()]
                columns = [pa.array([number], pa.int64()), pa.array([[x[0] for x in now]], pa.list_(pa.string())), pa.array([[x[3] for x in now]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], _names(_BLOCK))
                number += 1

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return materialise(rows.repartition(max(1, size // (4 * most_words))).mapInArrow(run, _BLOCK), "items")


def _asked(index: DataFrame, blocks: DataFrame, answer: Callable[[Segment, Block, list], Iterator[pa.RecordBatch]], prepare: Callable[[Block], list], schema: str) -> DataFrame:
    """What all segments answer to each block; a block is on the driver and in the tasks at a time, and its answers are written."""
    spark: SparkSession = index.sparkSession
    parts = []
    for number in [r["block"] for r in blocks.select("block").collect()]:  # one number per block
        row = blocks.filter(F.col("block") == number).first().asDict()
        sent = spark.sparkContext.broadcast({k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block.of(sent.value)
            ready = prepare(block)
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from answer(Segment(batch.slice(k, 1).to_pylist()[0], block.terms), block, ready)

        parts.append(materialise(index.mapInArrow(run, schema), "answers"))
        sent.unpersist()
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionAll(part)
    return out


# ---- answers ----


def _hits(segment: Segment, block: Block, ready: list) -> Iterator[pa.RecordBatch]:
    """Per document with matches: the stretches of words inside them, and the items they are of."""
    edge = np.zeros(segment.size + 1, np.int32)
    owners = []
    for windows, upto, item, _ in ready:
        for which, start in segment.phrases(windows):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + windows.shape[1], -1)
            pairs = np.unique(segment.document(start) << 32 | which)
            doc, which = pairs >> 32, pairs & 0xFFFFFFFF
            each = upto[which + 1] - upto[which]
            owners.append(np.unique(np.repeat(doc, each) << 32 | item[ranges(upto[which], each)]))
    if not owners:
        return
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    doc = segment.document(turn[:, 0])
    docs, first = np.unique(doc, return_index=True)
    turn = turn - segment.starts[doc][:, None]
    spans = pa.StructArray.from_arrays([pa.array(turn[:, k].astype(np.int32)) for k in (0, 1)], ["lo", "hi"])
    pairs = np.unique(np.concatenate(owners))
    names = pa.array(block.items, pa.string()).take(pa.array(pairs & 0xFFFFFFFF))
    ends = [np.append(first, len(doc)), np.append(np.searchsorted(pairs >> 32, docs), len(pairs))]
    lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), v) for e, v in zip(ends, (spans, names), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(segment.rows[docs]), *lists], _names(_HIT))


def _matches(segment: Segment, start: np.ndarray, length: np.ndarray, names: pa.Array, item_start: np.ndarray) -> pa.RecordBatch:
    doc = segment.document(start)
    ids = pa.array(segment.ids, pa.int64()).take(pa.array(doc))
    return pa.RecordBatch.from_arrays([pa.array(segment.rows[doc]), ids, pa.array(start - segment.starts[doc]), pa.array(length), names, pa.array(item_start)], _names(_MATCH))


def phrase_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, most_words: int = 1 << 20) -> DataFrame:
    """row, doc_id, start, length, item_id, item_start: where `length` words of a document equal a window of an item.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Equal windows
    of several items match for each of them.
    """

    def answer(segment: Segment, block: Block, ready: list) -> Iterator[pa.RecordBatch]:
        names = pa.array(block.items, pa.string())
        for windows, upto, item, first in ready:
            for which, start in segment.phrases(windows):
                each = upto[which + 1] - upto[which]
                at, start = ranges(upto[which], each), np.repeat(start, each)
                yield _matches(segment, start, np.full(len(start), windows.shape[1]), names.take(pa.array(item[at])), first[at])

    return _asked(index, item_blocks(items, id_col, text_col, window, most_words), answer, lambda b: list(b.windows(window)), _MATCH)


def proximity_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, within: int = 20, most_words: int = 1 << 20) -> DataFrame:
    """As `phrase_matches`, for the words of a window in any order, each once, within `within` places of a document.

    A match is a least stretch: none that holds all the words ends at the same place and starts later. start and length
    are the stretch's, item_start the window's.
    """

    def answer(segment: Segment, block: Block, ready: list) -> Iterator[pa.RecordBatch]:
        names = pa.array(block.items, pa.string())
        for windows, upto, item, first in ready:
            for which in np.flatnonzero(segment.counts[windows].min(axis=1) > 0).tolist():
                found = segment.near(np.unique(windows[which]), within)
                if len(found):
                    at = np.arange(upto[which], upto[which + 1])
                    start, length = (np.repeat(x, len(at)) for x in (found[:, 0], found[:, 1] - found[:, 0] + 1))
                    at = np.tile(at, len(found))
                    yield _matches(segment, start, length, names.take(pa.array(item[at])), first[at])

    return _asked(index, item_blocks(items, id_col, text_col, window, most_words), answer, lambda b: list(b.windows(window)), _MATCH)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_bytes: int = 4 << 20, most_words: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of some item, and n_items are the items with such windows,
    counted by id. items_sha256 is of their ids, sorted as strings, joined by commas ('' for none). Null text has no
    words; items without words have no windows; a null item id counts as ''. Rows that repeat an id, null ids too, are
    each judged for themselves. An empty table of documents gives no rows, one of items leaves all documents clean.
    Other columns are not read.
    """
    index = build_index(docs, id_col, text_col, segment_bytes)
    hits = _asked(index, item_blocks(items, item_col, item_text_col, window, most_words), _hits, lambda b: list(b.windows(window)), _HIT)
    spans, names = (F.flatten(F.collect_list(c)) for c in ("spans", "items"))
    found = hits.groupBy("row").agg(F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(names)).alias("items"))
    # stretches of several blocks may overlap: each adds what lies beyond those before it
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    n_hit = F.aggregate("spans", start, lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.hi - F.greatest(s.lo, a.upto))).alias("n"), F.greatest(a.upto, s.hi).alias("upto")), lambda a: a.n)
    out = indexed_documents(index).join(found.select("row", n_hit.alias("n_hit"), "items"), "row", "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle() -> str:
    return r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (SELECT item, w, least(10, len(w)) AS l, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
        q AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM p),
        x AS (SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM q) WHERE len(w) >= l),
        y AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM x),
        m AS (SELECT r, l, i, item FROM y JOIN q USING (l, s)),
        c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS j FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
               sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
    """
