"""Windows that repeat, found through packed stretches of text; shared by the two passage deduplications.

Consecutive windows with the same least token form a stretch. A stretch is packed once, with the bytes that its windows
cover, and goes to the bucket of its token: equal windows have equal tokens, so they meet there. A map task packs all
stretches of a shuffle partition into one compressed payload and leaves out stretches that it has itself seen before.
Buckets are many per partition; a task spools its payloads by bucket and takes one after the other. One that outgrows
memory is split by finer tokens or worked in slices of its windows by their hash.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.llm.common import flat, ranges, release_memory, slices, take_bytes

#: A null id stands after all others.
LAST = np.int64(2**63 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}

PAYLOAD = "part int, windows long, payload binary"
#: How often a bucket that is too large is split, and split again.
SPLITS = 3
#: Bytes of stretches that are split or thinned at once.
PIECE = 1 << 20
INTERVAL = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 12) + (n >> 3), base, np.uint64)])
        _powers[int(base)] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, from sums of powers; to be confirmed by what was hashed."""

    def __init__(self, values: np.ndarray) -> None:
        self.sums = np.zeros(len(values) + 1, np.uint64)
        body = self.sums[1:]
        with np.errstate(over="ignore"):
            np.add(values, 1, out=body, casting="unsafe")
            body *= _power(_BASE, len(values))
            np.cumsum(body, out=body)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * _power(_BACK, len(self.sums))[starts])


def hash_runs(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; the runs, none of them empty, lie one after the other. To be confirmed as well."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(begin.astype(np.int32), sizes)
    with np.errstate(over="ignore"):
        value = _power(_BASE, int(sizes.max()))[place]
        del place
        value *= data.astype(np.uint16) + np.uint16(1)
        return mixed(np.add.reduceat(value, begin) + sizes.astype(np.uint64))


@dataclass
class Stretches:
    """Stretches by document row, first unit in it, and number of windows; their bytes lie one after the other, or `at`."""

    ids: np.ndarray  # per stretch: the document's id,
    rows: np.ndarray  # a number that tells rows with one id apart,
    starts: np.ndarray  # the first unit (word or byte) in the document,
    windows: np.ndarray  # windows from there on,
    sizes: np.ndarray  # and bytes
    data: np.ndarray
    at: np.ndarray | None = None  # where the bytes of each begin, if they overlap

    def places(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes if self.at is None else self.at

    def pick(self, chosen: np.ndarray) -> Stretches:
        kept = [x[chosen] for x in (self.ids, self.rows, self.starts, self.windows, self.sizes)]
        if self.at is not None:
            return Stretches(*kept, self.data, self.at[chosen])
        return Stretches(*kept, take_bytes(self.data, self.places()[chosen], self.sizes[chosen]))

    def cut(self, most: int) -> Iterator[Stretches]:
        """The stretches, whose bytes lie one after the other, in runs that begin within `most` bytes."""
        ends = np.cumsum(self.sizes)
        begins = ends - self.sizes
        at = [*_run_starts(begins // most).tolist(), len(self)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = (x[a:b] for x in (self.ids, self.rows, self.starts, self.windows, self.sizes))
            yield Stretches(*own, self.data[begins[a] : ends[b - 1]])

    def __len__(self) -> int:
        return len(self.ids)


def joined(parts: list[Stretches]) -> Stretches:
    whole = [np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "rows", "starts", "windows", "sizes", "data")]
    if all(p.at is None for p in parts):
        return Stretches(*whole)
    before = np.cumsum([0, *(len(p.data) for p in parts[:-1])])
    return Stretches(*whole, np.concatenate([p.places() + n for p, n in zip(parts, before.tolist(), strict=True)]))


def packed(s: Stretches, level: int = 6) -> bytes:
    """The stretches, one at least, as one payload."""
    none = np.zeros(len(s), np.int64)
    return next(packed_by(s, none, none, level))[2]


def packed_by(s: Stretches, key: np.ndarray, bucket: np.ndarray, level: int) -> Iterator[tuple[int, int, bytes]]:
    """Key, number of windows and payload of the stretches of each key, by bucket.

    Documents once, as differences; small numbers for the rest; numbers and text compressed each for itself. What can be
    done for all payloads at once is, as they may be many and small.
    """
    if not len(s):
        return
    order = np.lexsort((bucket, key))
    at = s.places()
    raw, first, last = memoryview(np.ascontiguousarray(s.data)), at[order].tolist(), (at + s.sizes)[order].tolist()
    key, bucket, ids, rows, windows = (x[order] for x in (key, bucket, s.ids, s.rows, s.windows))
    begin = _run_starts(key)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]
    turn = np.r_[True, bucket[1:] != bucket[:-1]]
    new[begin] = turn[begin] = True
    documents = np.flatnonzero(new)
    ids, rows = (np.diff(x[documents], prepend=0) for x in (ids, rows))  # each payload's first is replaced below
    document_at = np.searchsorted(documents, np.r_[begin, len(key)]).tolist()
    ids[document_at[:-1]], rows[document_at[:-1]] = s.ids[order[begin]], s.rows[order[begin]]
    turns = np.flatnonzero(turn)
    buckets, lengths = bucket[turns].astype(np.int32), np.diff(np.r_[turns, len(key)]).astype(np.int32)
    turn_at = np.searchsorted(turns, np.r_[begin, len(key)]).tolist()
    columns = [_slim(x) for x in (s.starts[order], windows, (s.sizes - s.windows)[order])]
    kinds = [x.dtype.str for x in columns]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    total = np.add.reduceat(windows, begin).tolist()
    for k, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True)):
        d, u = slice(document_at[k], document_at[k + 1]), slice(turn_at[k], turn_at[k + 1])
        numbers = (b - a, ids[d].tobytes(), rows[d].tobytes(), np.packbits(new[a:b]).tobytes(), kinds, [x[a:b].tobytes() for x in columns], buckets[u].tobytes(), lengths[u].tobytes())
        text = b"".join([raw[x:y] for x, y in zip(first[a:b], last[a:b], strict=True)])
        yield int(key[a]), total[k], pickle.dumps((squeeze(pickle.dumps(numbers, protocol=5)), squeeze(text)), protocol=5)


def unpacked(payload: bytes) -> Stretches:
    return unpacked_by(payload)[0]


def unpacked_by(payload: bytes) -> tuple[Stretches, np.ndarray]:
    """The stretches of a payload and their buckets."""
    expand = zstandard.ZstdDecompressor().decompress
    numbers, data = map(expand, pickle.loads(payload))  # written by packed_by() in this job
    n, ids, rows, new, kinds, columns, buckets, lengths = pickle.loads(numbers)
    which = np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=n), dtype=np.int64) - 1
    ids, rows = (np.cumsum(np.frombuffer(x, np.int64))[which] for x in (ids, rows))
    starts, windows, more = (np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(columns, kinds, strict=True))
    bucket = np.repeat(np.frombuffer(buckets, np.int32), np.frombuffer(lengths, np.int32))
    return Stretches(ids, rows, starts, windows, windows + more, np.frombuffer(data, np.uint8)), bucket.astype(np.int64)


def _run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _slim(x: np.ndarray) -> np.ndarray:
    """The numbers in the narrowest type that holds them all."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(t for t in ("u1", "u2", "u4", "i8") if t == "i8" or 0 <= low and high <= np.iinfo(t).max))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches of the data at a and at b, of equal sizes, hold the same bytes."""
    differ = take_bytes(data, a, sizes) != take_bytes(data, b, sizes)
    before = np.concatenate([[0], np.cumsum(differ, dtype=np.int32)])
    ends = np.cumsum(sizes)
    return before[ends] == before[ends - sizes]


def copies_of_first(s: Stretches, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For stretches that repeat an earlier one (least id, then start) byte for byte: their numbers, and its number.

    `whole` is a hash of each stretch, if there is one already; without it their bytes lie one after the other.
    """
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = s.places()
    whole = hash_runs(s.data, s.sizes) if whole is None else whole
    order = np.argsort(whole)
    alike = whole[order][1:] == whole[order][:-1]
    order = order[np.r_[alike, False] | np.r_[False, alike]]
    order = order[np.lexsort((s.starts[order], s.ids[order], whole[order]))]
    new = np.ones(len(order), bool)
    new[1:] = whole[order][1:] != whole[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    alike = ~new & (s.sizes[order] == s.sizes[first])
    copy, origin = order[alike], first[alike]
    true = same_bytes(s.data, at[copy], at[origin], s.sizes[copy])
    return copy[true], origin[true]


def intervals(ids: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (ids, rows, lo, hi)], schema=INTERVAL)


def merged_runs(s: Stretches, hit: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Intervals of units for the hit windows (one flag per window, stretch after stretch); neighbours make one interval."""
    if not hit.any():
        return
    stretch = np.repeat(np.arange(len(s)), s.windows)
    place = ranges(s.starts, s.windows)[hit]
    stretch = stretch[hit]
    new = np.r_[True, (stretch[1:] != stretch[:-1]) | (place[1:] != place[:-1] + 1)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(place)] - 1
    yield from intervals(s.ids[stretch[begin]], s.rows[stretch[begin]], place[begin], place[end] + width)


# ---- map side ----


def payloads(parts: Iterator[tuple[Stretches, np.ndarray]], partitions: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Stretches and their buckets as one payload per shuffle partition, for every `flush` bytes or so.

    Columns as in PAYLOAD. Buckets are dealt to partitions in turn. They are many more than partitions: a payload each
    would be so small with many buckets that packing it costs more than its bytes do.
    """
    held: list[tuple[Stretches, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += int(part[0].sizes.sum())
        if size >= flush:
            yield from _payload_batch(held, partitions)
            held, size = [], 0
            release_memory()
    if held:
        yield from _payload_batch(held, partitions)


def _payload_batch(held: list[tuple[Stretches, np.ndarray]], partitions: int) -> Iterator[pa.RecordBatch]:
    s, bucket = joined([p for p, _ in held]), np.concatenate([b for _, b in held])
    held.clear()
    for some in batched(packed_by(s, bucket % partitions, bucket, 3), 256):
        part, windows, out = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(windows, pa.int64()), pa.array(out, pa.binary())], ["part", "windows", "payload"])


def found_here(ids: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Intervals found on the map side, passed on as a payload without windows."""
    if len(ids):
        blob = zstandard.compress(pickle.dumps(tuple(x.astype(np.int64).tobytes() for x in (ids, rows, lo, hi)), protocol=5))
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[0] & 0xFFFF)], pa.int32()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], ["part", "windows", "payload"])


# ---- reduce side ----


class Spool:
    """Stretches by bucket: in memory, and beyond `memory` bytes in a local file, compressed either way."""

    def __init__(self, memory: int) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=memory)
        self.memory, self.end, self.size = memory, 0, 0
        self.held: list[tuple[Stretches, np.ndarray]] = []
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        self.windows: dict[int, int] = {}

    def put(self, s: Stretches, bucket: np.ndarray) -> None:
        self.held.append((s, bucket))
        self.size += int(s.sizes.sum())
        if self.size >= self.memory:
            self.sort()

    def sort(self) -> None:
        """Writes what is held, a block for each bucket."""
        if self.held:
            s, bucket = joined([p for p, _ in self.held]), np.concatenate([b for _, b in self.held])
            self.held, self.size = [], 0
            for key, windows, block in packed_by(s, bucket, bucket, 1):
                self.file.seek(self.end)
                self.file.write(block)
                self.blocks.setdefault(key, []).append((self.end, len(block)))
                self.windows[key] = self.windows.get(key, 0) + windows
                self.end += len(block)

    def buckets(self) -> list[int]:
        self.sort()
        return sorted(self.blocks)

    def parts(self, bucket: int) -> Iterator[Stretches]:
        for at, length in self.blocks[bucket]:
            self.file.seek(at)
            yield unpacked(self.file.read(length))


#: Stretches of a bucket, the buckets passed so far (number, of how many) and how many to make, to finer stretches, their
#: buckets, and intervals found on the way.
Split = Callable[[Stretches, tuple[tuple[int, int], ...], int], tuple[Stretches, np.ndarray, Iterator[pa.RecordBatch]]]


def bucket_task(resolve: Callable[[Stretches], Iterator[pa.RecordBatch]], thin: Callable[[Stretches, int, int], Stretches], most: int, alone: int, split: Split | None = None, memory: int = 16 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over payloads; `most` bounds the windows taken at once.

    A bucket of more is read once and split into finer ones, if that can be done, at most SPLITS times. What is still
    too large then is worked in slices of its windows, each of which reads it all. A window taken out of its stretch has
    its bytes to itself: about `alone` times its share before.
    """

    def work(spool: Spool, bucket: int, path: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
        windows = spool.windows[bucket]
        if windows <= most:
            yield from resolve(joined(list(spool.parts(bucket))))
        elif split and len(path) <= SPLITS:
            parts = -(-4 * windows // most)
            finer = Spool(memory)
            for s in spool.parts(bucket):
                for some in s.cut(PIECE):
                    *more, found = split(some, path, parts)
                    finer.put(*more)
                    yield from found
            yield from all_of(finer, path, parts)
        else:
            slices = -(-windows * alone // most)
            for k in range(slices):
                yield from resolve(joined([thin(some, k, slices) for s in spool.parts(bucket) for some in s.cut(PIECE)]))

    def all_of(spool: Spool, path: tuple[tuple[int, int], ...], parts: int) -> Iterator[pa.RecordBatch]:
        since = 0
        for bucket in spool.buckets():
            yield from work(spool, bucket, (*path, (bucket, parts)))
            since += spool.windows[bucket]
            if since > 4 * most:
                release_memory()
                since = 0
        spool.file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool(memory)
        for batch in batches:
            for windows, held in zip(batch.column("windows").to_pylist(), batch.column("payload"), strict=True):
                payload = held.as_py()
                if windows:
                    spool.put(*unpacked_by(payload))
                else:
                    yield from intervals(*(np.frombuffer(x, np.int64) for x in pickle.loads(zstandard.decompress(payload))))
        yield from all_of(spool, (), 0)

    return run


def removed(packs: DataFrame, partitions: int, task: Callable) -> DataFrame:
    """Payloads dealt to their partitions and resolved: id, row, and the intervals to remove as two lists."""
    found = packs.repartitionById(partitions, "part").mapInArrow(task, "id long, row long, lo long, hi long")
    return found.groupBy("id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))


def with_removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, id, row, text) with the lists of what goes; both sides are dealt by document, texts compressed."""
    return docs.join(gone, ["id", "row"], "left").select("doc_id", "text", F.col("gone.lo").alias("lo"), F.col("gone.hi").alias("hi"))


def compressed(docs: DataFrame) -> DataFrame:
    """The same rows, each text as zstandard bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", 8 << 20):
            data, offsets = flat(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            texts = pa.array([squeeze(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("row"), texts], ["doc_id", "id", "row", "text"])

    return docs.mapInArrow(run, "doc_id long, id long, row long, text binary")


def expanded(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[int] | None, list[int] | None]]:
    """Text and intervals of each row of a batch as joined."""
    expand = zstandard.ZstdDecompressor().decompress
    for k in range(batch.num_rows):
        yield expand(batch.column("text")[k].as_py()), batch.column("lo")[k].as_py(), batch.column("hi")[k].as_py()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id as it was, the id to order by, a number that tells rows with one id apart, and the text; null is empty.

    That number is a hash of the text, and 0 throughout if no id repeats, as it should be (it travels with every stretch).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    single = docs.groupBy(own.alias("id")).count().filter("count > 1").isEmpty()
    row = F.lit(0).cast("long") if single else F.xxhash64(text)
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(int(LAST))).alias("id"), row.alias("row"), text.alias("text"))


def union_of(lo: list[int] | None, hi: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo or (), hi or (), strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
