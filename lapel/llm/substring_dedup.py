"""Substring deduplication over words by super-k-mers.

Consecutive windows of k words that share a minimiser (the least hash of their m-word tokens) travel as one packed
string to the minimiser's bucket. There words become exact numbers, windows are sorted by a hash of these, and equal
neighbours are confirmed number by number, so every window is counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapel.llm import stretches as S
from lapel.llm.common import flat, partitions_of, ranges, sample_texts, slices, sliding_min, take_bytes, word_bounds

#: Buckets per shuffle partition, and text bytes that a task turns into stretches at once.
PER_PARTITION, CHUNK = 16, 512 << 10
#: Bits of a hot token's slot (others in it count as hot too), and tokens that may be hot.
_SLOTS, _HOT = 18, 1 << 15

_BLANK_TO_SPACE = np.arange(256, dtype=np.uint8)
_BLANK_TO_SPACE[9:14] = 32


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return S.hash_runs(take_bytes(data, starts, ends - starts), ends - starts)


def _ranks(words: np.ndarray, m: int, hot: np.ndarray) -> np.ndarray:
    """The rank of the m-word token at each word: a hash of it, with hot tokens after all others."""
    every = np.arange(max(0, len(words) - m + 1))
    token = S.Rolling(words).of(every, every + m)
    return (token >> np.uint64(1)) | (hot[token >> np.uint64(64 - _SLOTS)].astype(np.uint64) << np.uint64(63))


def hot_tokens(rows: DataFrame, k: int, m: int, buckets: int) -> np.ndarray:
    """Slots of tokens that are frequent in a sample of texts: windows around one would fill a quarter of a bucket.

    All windows of a minimiser meet in one bucket, so frequent ones come last. This balances buckets and does no more.
    """
    texts = sample_texts(rows)
    hot = np.zeros(1 << _SLOTS, bool)
    data, offsets = flat(pa.array(texts, pa.string()))
    starts, ends, _ = word_bounds(data, offsets)
    if len(starts) >= m:
        rank, counts = np.unique(_ranks(_word_hashes(data, starts, ends), m, hot), return_counts=True)
        often = counts > max(2.0, len(starts) / (4 * buckets * (k - m + 1) / 2))
        most = np.argsort(-counts[often], kind="stable")[:_HOT]
        hot[rank[often][most] >> np.uint64(63 - _SLOTS)] = True
    return hot


def _stretches(batch: pa.RecordBatch, k: int, m: int, hot: np.ndarray) -> tuple[S.Stretches, np.ndarray]:
    """The super-k-mers of a batch and their minimisers."""
    data, offsets = flat(batch.column("text"))
    data = _BLANK_TO_SPACE[data]
    starts, ends, first = word_bounds(data, offsets)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    valid = ranges(first[:-1], counts)
    if not len(valid):
        empty = np.zeros(0, np.int64)
        return S.Stretches(empty, empty, empty, empty, empty, data[:0]), empty.astype(np.uint64)
    words = _word_hashes(data, starts, ends)
    least = sliding_min(_ranks(words, m, hot), k - m + 1)[valid]
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    windows = np.diff(np.r_[begin, len(valid)])
    a = valid[begin]
    sizes = ends[a + windows + k - 2] - starts[a]
    of = doc[begin]
    ids, rows = (batch.column(c).to_numpy()[of] for c in ("id", "row"))
    return S.Stretches(ids, rows, a - first[of], windows, sizes, take_bytes(data, starts[a], sizes)), least[begin]


def _pack_task(k: int, m: int, hot: np.ndarray, buckets: int, partitions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def parts() -> Iterator[tuple[S.Stretches, np.ndarray]]:
            for batch in slices(batches, "text", CHUNK):
                s, least = _stretches(batch, k, m, hot)
                copy, origin = S.copies_of_first(s)
                same = (s.ids[copy] == s.ids[origin]) & (s.starts[copy] == s.starts[origin])
                gone = copy[~same]
                own.extend(S.found_here(s.ids[gone], s.rows[gone], s.starts[gone], s.starts[gone] + s.windows[gone] + k - 1))
                # a repeated row finds what the first finds, as both have one key
                left = np.ones(len(s), bool)
                left[gone] = False
                left[copy[same & (s.rows[copy] == s.rows[origin])]] = False
                kept = np.flatnonzero(left)
                yield s.pick(kept), (S.mixed(least[kept]) % np.uint64(buckets)).astype(np.int64)

        for batch in S.payloads(parts(), partitions, 16 << 20):
            yield batch
            yield from own
            own.clear()
        yield from own

    return run


def _numbers(s: S.Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as exact numbers, the first word of every window, and the words' bounds."""
    offsets = np.concatenate([[0], np.cumsum(s.sizes)])
    starts, ends, first = word_bounds(s.data, offsets)
    bytes_ = take_bytes(s.data, starts, ends - starts)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(bytes_)])
    return words.dictionary_encode().indices.to_numpy(), ranges(first[:-1], s.windows), starts, ends


def _resolve_task(k: int) -> Callable[[S.Stretches], Iterator[pa.RecordBatch]]:
    def resolve(s: S.Stretches) -> Iterator[pa.RecordBatch]:
        if not len(s):
            return
        number, at, _, _ = _numbers(s)
        hashes = S.Rolling(S.mixed(number.astype(np.uint64))).of(at, at + k)
        order = np.argsort(hashes)
        alike = hashes[order][1:] == hashes[order][:-1]
        some = order[np.r_[alike, False] | np.r_[False, alike]]
        stretch = np.repeat(np.arange(len(s)), s.windows)[some]
        ids, start = s.ids[stretch], ranges(s.starts, s.windows)[some]
        content = number[at[some][:, None] + np.arange(k)]
        by = np.lexsort((start, ids, hashes[some]))
        run = hashes[some][by]
        if (clash := (run[1:] == run[:-1]) & (content[by][1:] != content[by][:-1]).any(axis=1)).any():
            # two contents under one hash: number the contents themselves
            group = np.unique(content, axis=0, return_inverse=True)[1].reshape(-1)
            by = np.lexsort((start, ids, group))
            run = group[by]
        del clash
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1] if len(run) else np.zeros(0, np.int64)
        later = (ids[by] != ids[by][first]) | (start[by] != start[by][first])
        hit = np.zeros(len(at), bool)
        hit[some[by[later]]] = True
        yield from S.merged_runs(s, hit, k)

    return resolve


def _thin_task(k: int) -> Callable[[S.Stretches, int, int], S.Stretches]:
    def thin(s: S.Stretches, part: int, parts: int) -> S.Stretches:
        """One of `parts` shares of the windows, by a hash of their words; each window as a stretch of its own."""
        _, at, starts, ends = _numbers(s)
        hashes = S.Rolling(_word_hashes(s.data, starts, ends)).of(at, at + k)
        chosen = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(parts) == part)
        stretch = np.repeat(np.arange(len(s)), s.windows)[chosen]
        a = at[chosen]
        sizes = ends[a + k - 1] - starts[a]
        return S.Stretches(s.ids[stretch], s.rows[stretch], ranges(s.starts, s.windows)[chosen], np.ones(len(chosen), np.int64), sizes, take_bytes(s.data, starts[a], sizes))

    return thin


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 3, most_windows: int = 1_000_000, keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space).

    A word goes if a window of k words that holds it also starts earlier: in a document with a smaller id, or earlier
    in the same one. Windows are judged on the input. Null text counts as empty; texts of under k words stay whole; a
    null id stands after all others. Without keep_text, kept is null. Rows that repeat an id are judged each on its own text, against all other ids and
    against earlier starts under the same id. Other columns are not read. An empty table gives no rows.
    """
    if not 1 <= m <= k:
        raise ValueError("a token has 1 to k words")
    n = partitions_of(docs.sparkSession)
    rows = S.keyed(docs, id_col, text_col)
    hot = hot_tokens(rows, k, m, PER_PARTITION * n)
    packs = rows.select("id", "row", "text").mapInArrow(_pack_task(k, m, hot, PER_PARTITION * n, n), S.PAYLOAD)
    gone = S.removed(packs, n, S.bucket_task(_resolve_task(k), _thin_task(k), most_windows, max(1, k // 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for text, lo, hi in S.expanded(batch):
                words = text.split()
                kept, upto, lost = [], 0, 0
                for a, b in S.union_of(lo, hi):
                    kept += words[upto:a]
                    upto, lost = b, lost + b - a
                joined = b" ".join(kept + words[upto:])
                out.append((len(words), lost, hashlib.sha256(joined).hexdigest(), joined.decode() if keep_text else None))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    texts = S.with_removed(S.compressed(rows), gone)
    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def oracle() -> str:
    return r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
        k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
        c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r WHERE n > 1),
        g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
        f AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
        l AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
        t AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.i) AS kept FROM l ANTI JOIN c USING (doc_id, i) GROUP BY l.doc_id)
        SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM f LEFT JOIN t USING (doc_id)
    """
