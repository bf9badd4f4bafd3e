"""Passage deduplication over bytes by a range-partitioned sparse suffix array.

Suffixes are ordered by their leading tokens of 8 bytes. Shipping every suffix with the bytes it is compared by would
multiply the text fifty-fold, so suffixes that share a lowest-ranked token within reach travel as one stretch with it,
and splitters sampled from such tokens cut the token order into ranges: one bucket each. A bucket first drops stretches
that repeat another one, then sorts the suffixes that may repeat by multikey quicksort, 8 bytes a level, each level
refining only the runs that are still equal. Equal strings have equal tokens, so the only range boundary that they
could straddle is one inside a token; buckets hold whole tokens, and where one token outgrows memory, its bucket is split
by the other tokens of its strings, which keeps equal strings together as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapel.llm import stretches as S
from lapel.llm.common import _BLANK, flat, partitions_of, ranges, sample_texts, slices, sliding_min, take_bytes

TOKEN = 8
#: Buckets per shuffle partition.
PER_PARTITION = 32
#: Bits of a hot token's slot (others in it count as hot too), and tokens that may be hot.
_SLOTS, _HOT = 18, 1 << 15
_RANK = np.uint64(0xD6E8FEB86659FD93)
_UNRANK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def leading_tokens(data: np.ndarray) -> np.ndarray:
    """At every byte that 7 more follow, the 8 bytes from there as a number that orders as they do."""
    x = data.astype(np.uint64)
    for reach in (1, 2, 4):
        if len(x) <= reach:
            return x[:0]
        ahead = x[reach:]
        x = x[:-reach] << np.uint64(8 * reach)
        x |= ahead
    return x


def _levels(width: int) -> list[int]:
    """Where the 8-byte characters of a string of `width` bytes start; the last may overlap the one before."""
    return [*range(0, width - TOKEN, TOKEN), width - TOKEN]


def _hashes(tokens: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of `width` bytes, from its characters."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k, level in enumerate(_levels(width)):
            out += tokens[at + level] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64))
    return S.mixed(out)


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """For the string of `width` bytes at every byte: 32 bits that are equal for equal strings, and seldom otherwise."""
    out, reach = data.astype(np.uint32), 1
    while reach < width and len(out):
        step = min(reach, width - reach)
        ahead = out[step:]
        out = out[:-step] * np.uint32(pow(0x9E3779B1, reach + 2, 2**32))
        out += ahead
        reach += step
    return out


def _whole(hashes: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each stretch, from its first and its last window."""
    with np.errstate(over="ignore"):
        return S.mixed((hashes[at].astype(np.uint64) << np.uint64(32) | hashes[at + windows - 1]) + windows.astype(np.uint64))


def _least_ranks(data: np.ndarray, width: int, hot: np.ndarray, spent: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For the string of `width` bytes at every byte: the least rank of its tokens.

    Tokens at a word's beginning (a blank and something else) come before others: they lie more evenly, which makes
    stretches longer. Hot tokens come last: all strings of a token meet in one bucket. Spent ones, which the strings at
    hand were told apart by before, come after these. All of that follows from the token alone.
    """
    tokens = leading_tokens(data)
    with np.errstate(over="ignore"):
        rank = tokens * _RANK
    none = np.uint64(2**64 - 1)
    cold = ~hot[rank >> np.uint64(64 - _SLOTS)]
    fresh = None if spent is None else ~spent(tokens)
    if fresh is not None:
        cold &= fresh
    first, second = (tokens >> np.uint64(56)).astype(np.uint8), (tokens >> np.uint64(48)).astype(np.uint8)
    reach = width - TOKEN + 1
    least = sliding_min(np.where(_BLANK[first] & ~_BLANK[second] & cold, rank, none), reach)
    for some in (cold, None) if fresh is None else (cold, fresh, None):
        if not (least == none).any():
            break
        least = np.where(least == none, sliding_min(rank if some is None else np.where(some, rank, none), reach), least)
    return least


def _stretches(ids: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, width: int, hot: np.ndarray, spent: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[S.Stretches, np.ndarray, np.ndarray]:
    """The stretches of some texts (of parts that start at the given byte), their tokens and hashes."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    valid = ranges(offsets[:-1], counts)
    if not len(valid):
        empty = np.zeros(0, np.int64)
        return S.Stretches(empty, empty, empty, empty, empty, data[:0], empty), empty.astype(np.uint64), empty.astype(np.uint64)
    least = _least_ranks(data, width, hot, spent)[valid]
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    windows = np.diff(np.r_[begin, len(valid)])
    a, of = valid[begin], doc[begin]
    sizes = windows + width - 1
    with np.errstate(over="ignore"):
        token = least[begin] * _UNRANK
    return S.Stretches(ids[of], rows[of], a - offsets[of] + starts[of], windows, sizes, data, a), token, _whole(_window_hashes(data, width), a, windows)


def _parts(batches: Iterator[pa.RecordBatch], width: int, hot: np.ndarray, most: int) -> Iterator[tuple[S.Stretches, np.ndarray, np.ndarray]]:
    """Stretches of the texts, their tokens and hashes, a few at a time; a long text comes in overlapping parts, so that each window is in one."""
    for batch in slices(batches, "text", most):
        data, offsets = flat(batch.column("text"))
        ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
        if len(data) <= most + width:
            yield _stretches(ids, rows, data, offsets, np.zeros(len(ids), np.int64), width, hot)
            continue
        for a in range(0, len(data) - width + 1, most):  # one text
            part = data[a : a + most + width - 1]
            yield _stretches(ids, rows, part, np.array([0, len(part)]), np.array([a]), width, hot)


def _copies(s: S.Stretches, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that repeat one of a document with a smaller id, which go whole; and the others."""
    copy, origin = S.copies_of_first(s, whole)
    gone = copy[s.ids[copy] > s.ids[origin]]
    left = np.ones(len(s), bool)
    left[gone] = False
    return gone, np.flatnonzero(left)


def _pack_task(width: int, hot: np.ndarray, splitters: np.ndarray, partitions: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def parts() -> Iterator[tuple[S.Stretches, np.ndarray]]:
            for s, token, whole in _parts(batches, width, hot, most):
                gone, kept = _copies(s, whole)
                if len(gone):
                    own.extend(S.found_here(s.ids[gone], s.rows[gone], s.starts[gone], s.starts[gone] + s.sizes[gone]))
                    s, token = s.pick(kept), token[kept]
                yield s, np.searchsorted(splitters, token, "right")

        for batch in S.payloads(parts(), partitions, 48 << 20):
            yield batch
            yield from own
            own.clear()
        yield from own

    return run


def multikey_sort(tokens: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the given bytes, ordered by their first `width` bytes: the order, and the number of each one's run of equals.

    Three-way radix quicksort with 8 bytes as one character: all runs take a level together, and only runs that differ
    there are sorted. The last level may overlap the one before, which costs nothing as those bytes are equal by then.
    """
    levels = _levels(width)
    order = np.argsort(tokens[at])
    key = tokens[at[order]]
    run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    for level in levels[1:]:
        alike = run[1:] == run[:-1]
        more = np.flatnonzero(np.r_[alike, False] | np.r_[False, alike])
        if not len(more):
            break
        key, old = tokens[at[order[more]] + level], run[more]
        begin = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        sizes = np.diff(np.r_[begin, len(old)])
        differ = np.repeat(np.logical_or.reduceat(key != np.repeat(key[begin], sizes), begin), sizes)
        if not differ.any():
            continue
        more, key, old = more[differ], key[differ], old[differ]
        by = np.lexsort((key, old))
        order[more] = order[more[by]]
        key = key[by]
        split = np.zeros(len(run), bool)
        split[more[1:]] = (key[1:] != key[:-1]) & (old[1:] == old[:-1])
        run = run + np.cumsum(split)
    return order, run


def _may_repeat(hashes: np.ndarray) -> np.ndarray:
    """Windows whose hash another one has: all that repeat, and a few more."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    mark = np.zeros(1 << 20, bool)
    mark[twice >> np.uint32(12)] = True
    return np.flatnonzero(mark[hashes >> np.uint32(12)])


def _resolve_task(width: int) -> Callable[[S.Stretches], Iterator[pa.RecordBatch]]:
    def resolve(s: S.Stretches) -> Iterator[pa.RecordBatch]:
        if not len(s):
            return
        begin, hashes = np.cumsum(s.sizes) - s.sizes, _window_hashes(s.data, width)
        gone, left = _copies(s, _whole(hashes, begin, s.windows))
        yield from S.intervals(s.ids[gone], s.rows[gone], s.starts[gone], s.starts[gone] + s.sizes[gone])
        data, begin = s.data, begin[left]
        s = S.Stretches(*(x[left] for x in (s.ids, s.rows, s.starts, s.windows, s.sizes)), data[:0])  # bytes stay where they are
        at = ranges(begin, s.windows)
        some = _may_repeat(hashes[at])
        hit = np.zeros(len(at), bool)
        if len(some):
            order, run = multikey_sort(leading_tokens(data), at[some], width)
            ids = np.repeat(s.ids, s.windows)[some[order]]
            least = np.minimum.reduceat(ids, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
            hit[some[order[ids > least[run]]]] = True
        yield from S.merged_runs(s, hit, width)

    return resolve


def _thin_task(width: int) -> Callable[[S.Stretches, int, int], S.Stretches]:
    def thin(s: S.Stretches, part: int, parts: int) -> S.Stretches:
        """One of `parts` shares of the windows, by a hash of their bytes; each window as a stretch of its own."""
        at = ranges(np.cumsum(s.sizes) - s.sizes, s.windows)
        hashes = _hashes(leading_tokens(s.data), at, width)
        chosen = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(parts) == part)
        of = np.repeat(np.arange(len(s)), s.windows)[chosen]
        sizes = np.full(len(chosen), width, np.int64)
        return S.Stretches(s.ids[of], s.rows[of], ranges(s.starts, s.windows)[chosen], np.ones(len(chosen), np.int64), sizes, take_bytes(s.data, at[chosen], sizes))

    return thin


def _split_task(width: int, hot: np.ndarray, splitters: np.ndarray) -> S.Split:
    def split(s: S.Stretches, path: tuple[tuple[int, int], ...], parts: int) -> tuple[S.Stretches, np.ndarray, Iterator[pa.RecordBatch]]:
        """The windows by their least-ranked token that no bucket on the path stands for, dealt to `parts` by its hash.

        Copies go at once, as intervals: a passage that is in very many documents is one stretch in each, and few are left.
        The first bucket of the path is a range between splitters, those after it are shares of the tokens by hash.
        """
        bucket = path[0][0]

        def spent(tokens: np.ndarray) -> np.ndarray:
            out = np.full(len(tokens), len(splitters) > 0)
            if bucket > 0:
                out &= tokens >= splitters[bucket - 1]
            if bucket < len(splitters):
                out &= tokens < splitters[bucket]
            for share, of in path[1:]:
                out |= S.mixed(tokens) % np.uint64(of) == np.uint64(share)
            return out

        finer, token, whole = _stretches(s.ids, s.rows, s.data, np.r_[0, np.cumsum(s.sizes)], s.starts, width, hot, spent)
        gone, kept = _copies(finer, whole)
        found = S.intervals(finer.ids[gone], finer.rows[gone], finer.starts[gone], finer.starts[gone] + finer.sizes[gone])
        return finer.pick(kept), (S.mixed(token[kept]) % np.uint64(parts)).astype(np.int64), found

    return split


def sampled_order(rows: DataFrame, width: int, buckets: int, documents: int = 2_000, characters: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """Slots of hot tokens, and tokens that cut the others into ranges of equal weight, from a sample of texts.

    The sample has `documents` texts at most, of each the first `characters`. It balances the buckets and does no more:
    results are the same for any sample. A token is hot if the strings around it would fill a quarter of a bucket.
    """
    texts = [t.encode() for t in sample_texts(rows, documents, characters)]
    hot = np.zeros(1 << _SLOTS, bool)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if len(data) < width:
        return hot, np.zeros(0, np.uint64)
    tokens, counts = np.unique(leading_tokens(data), return_counts=True)
    often = counts > max(2.0, len(data) / (4 * buckets * (width - TOKEN) / 2))
    tokens = tokens[often][np.argsort(-counts[often], kind="stable")[:_HOT]]
    with np.errstate(over="ignore"):
        hot[(tokens * _RANK) >> np.uint64(64 - _SLOTS)] = True
        least = _least_ranks(data, width, hot)[ranges(offsets[:-1], np.maximum(np.diff(offsets) - width + 1, 0))[::8]] * _UNRANK
    return hot, np.sort(least)[np.arange(1, buckets) * len(least) // buckets] if len(least) else np.zeros(0, np.uint64)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, most_windows: int = 1_500_000, chunk_bytes: int = 512 << 10, keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if a string of `width` bytes that holds it also starts in a document with a smaller id. Strings are
    judged on the input and never cross documents. Null text counts as empty; texts under `width` bytes stay whole; a
    null id stands after all others. Without keep_text, kept is null. Rows that repeat an id are judged each on its own text, against smaller ids. Other
    columns are not read. An empty table gives no rows.
    """
    if width < TOKEN:
        raise ValueError(f"the width is {TOKEN} bytes at least")
    n = partitions_of(docs.sparkSession)
    rows = S.keyed(docs, id_col, text_col)
    hot, splitters = sampled_order(rows, width, PER_PARTITION * n)
    packs = rows.select("id", "row", "text").mapInArrow(_pack_task(width, hot, splitters, n, chunk_bytes), S.PAYLOAD)
    gone = S.removed(packs, n, S.bucket_task(_resolve_task(width), _thin_task(width), most_windows, width // 3, _split_task(width, hot, splitters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for text, lo, hi in S.expanded(batch):
                spans = S.union_of(lo, hi)
                cuts = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if spans else text
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = S.with_removed(S.compressed(rows), gone)
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def oracle() -> str:
    return r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, unnest(generate_series(1, length(x) // 2 - 49)) AS i, x FROM d WHERE length(x) >= 100),
        k AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS h FROM s),
        r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM k),
        g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE first_id < doc_id),
        m AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
        n AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS b FROM m GROUP BY doc_id, span),
        p AS (SELECT doc_id, x, a, b, coalesce(lag(b) OVER w, 0) AS upto, lead(a) OVER w AS next_a
              FROM n JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
        t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed,
                     string_agg(substr(x, 2 * upto + 1, 2 * (a - upto - 1)) || CASE WHEN next_a IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
              FROM p GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)
    """
