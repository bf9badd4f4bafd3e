"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

Encoding starts from characters and repeats: of the adjacent pairs whose joined text is a piece, take the one with the
best score (the leftmost of equals) and merge it. A candidate enters the agenda when its two parts come to stand side by
side; a keyed hash of seed, document and the candidate's place decides then, with the dropout probability, that it is
skipped. Equal seeds give equal segmentations on any cluster; dropout 0 is the model's own encoding. No piece reaches
across a word's end, so words have agendas of their own. Those of a slice of texts run in lockstep in numpy, one merge per
word and round; long runs without a blank use a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.llm.common import flat, ranges, slices, take_bytes
from lapel.llm.stretches import mixed

_SPACE = "▁"
_LONG = 256
#: Bytes of text at a time: what a slice takes stays in a core's cache.
_SLICE = 1 << 17


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Tables of a merge-type model whose normaliser changes nothing but blanks."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        if (self.byte_ids == sp.unk_id()).any():
            raise ValueError("the model has no byte pieces, so it cannot decode every text")
        known = {pieces[i]: i for i in plain}
        #: symbol of each code point: its piece's id, or a number beyond all ids; the blank mark itself never stands for text
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.size, self.blank = n, int(self.symbol[ord(_SPACE)])

        def of(text: str) -> int | None:
            return known.get(text, int(self.symbol[ord(text)]) if len(text) == 1 else None)

        by_score = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        pairs = [(of(p[:k]), of(p[k:]), rank, i) for rank, i in enumerate(by_score) for p in [pieces[i]] for k in range(1, len(p))]
        pairs = [x for x in pairs if x[0] is not None and x[1] is not None]
        #: symbols of characters that are in longer pieces without being pieces themselves
        self.odd = np.array(sorted({x for a, b, _, _ in pairs for x in (a, b) if x >= n}), np.int64)
        self._table(np.array(pairs, np.int64).reshape(-1, 4))
        self.merges = {(a, b): (rank, i) for a, b, rank, i in pairs}
        texts = [b""] * n
        for i in plain:
            texts[i] = pieces[i].replace(_SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([b])
        self.text_sizes = np.fromiter(map(len, texts), np.int64, n)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.texts = np.frombuffer(b"".join(texts), np.uint8)

    def _table(self, pairs: np.ndarray) -> None:
        """Pairs in an open-addressing table of numpy arrays."""
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.merged = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, np.int32)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            placed, first = np.unique(slot[todo][free], return_index=True)
            winner = todo[free][first]
            self.keys[placed], self.ranks[placed], self.merged[placed] = key[winner], pairs[winner, 2], pairs[winner, 3]
            todo = np.setdiff1d(todo, winner)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank -1 where the pair makes no piece."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        todo = np.flatnonzero((there >= 0) & (there != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            todo = todo[(there >= 0) & (there != key[todo])]
        return self.ranks[slot], self.merged[slot]  # an empty slot has rank -1


@lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


class Dropout:
    """Says which candidates are skipped: a hash of the key, the document and where the two parts begin and end."""

    def __init__(self, seed: int, share: float) -> None:
        self.seed = mixed(np.array([seed & (2**64 - 1)], np.uint64))[0]
        self.below = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def keyed(self, document: np.ndarray) -> np.ndarray:
        return mixed(document.astype(np.uint64) ^ self.seed)

    def skips(self, keyed: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not self.below:
            return np.zeros(len(start), bool)
        x = keyed
        for part in (start, middle, end):
            x = mixed(x ^ part.astype(np.uint64))
        return x < self.below


def _lockstep(model: Model, drop: Dropout, sym: np.ndarray, words: np.ndarray, document: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Merges the words that start at `words` (positions in sym, with an end after the last), all at once; -1 for symbols
    that went into the one before.

    document and offset are the words': the place of a word's first symbol in its document. Symbols stay where they are
    and know their neighbours. The agenda is a key per symbol, for the pair that begins there: the pair's rank, then its
    distance from the word's start, so that the least key of a word is the leftmost of its best pairs. A round looks for
    those, which is the one pass over all symbols, and does the rest for a merge per word. Keys of finished words go.
    """
    n = len(sym)
    if not n:
        return sym
    low = _LONG.bit_length()
    kind = np.int32 if len(model.merges) < 1 << (30 - low) else np.int64
    none = np.iinfo(kind).max
    starts, sizes = words[:-1], np.diff(words)
    begin, keyed = offset - starts, drop.keyed(document)
    after = np.arange(1, n + 2, dtype=np.int32)
    after[words[1:] - 1] = n  # no neighbour: a place beyond all symbols
    before = np.arange(-1, n, dtype=np.int32)
    before[starts] = n
    stop = np.arange(1, n + 2, dtype=np.int32)
    alive = np.ones(n, bool)
    into = np.zeros(n, np.int32)

    def scored(at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The keys of the pairs that begin at the given symbols; own is their word."""
        right = after[at]
        rank, merged = model.find(sym[at], sym[right])
        into[at] = merged
        out = np.where(rank >= 0, rank.astype(kind) << low | (at - starts[own]).astype(kind), none)
        known = np.flatnonzero(rank >= 0)
        at, right, own = at[known], right[known], own[known]
        shift = begin[own]
        out[known[drop.skips(keyed[own], at + shift, right + shift, stop[right] + shift)]] = none
        return out

    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(after[:n] < n)
    keys = np.full(n, none, kind)
    keys[inner] = scored(inner, owner[inner])
    active, heads = np.arange(len(sizes)), starts  # words with keys, and where those begin
    while len(active):
        best = np.minimum.reduceat(keys, heads)
        more = best < none
        left = int(more.sum())
        if left < 0.75 * len(active):
            keys = keys[np.repeat(more, sizes[active])]
            active, best = active[more], best[more]
            heads = np.cumsum(sizes[active]) - sizes[active]
            now = np.arange(left)
        else:
            now = np.flatnonzero(more)
        own = active[now]
        to_key = heads[now] - starts[own]
        at = starts[own] + (best[now] & ((1 << low) - 1))
        gone = after[at]
        sym[at], alive[gone] = into[at], False
        stop[at], after[at] = stop[gone], after[gone]
        before[after[at]] = at
        keys[to_key + at] = none
        keys[to_key + gone] = none
        first = before[at]
        sides = np.concatenate([np.flatnonzero(after[at] < n), np.flatnonzero(first < n)])
        split = int((after[at] < n).sum())
        pair = np.concatenate([at[sides[:split]], first[sides[split:]]])
        keys[to_key[sides] + pair] = scored(pair, own[sides])
    return np.where(alive, sym, -1)


def _agenda(model: Model, drop: Dropout, sym: list[int], document: int, first: int) -> list[int]:
    """One word by a heap; the same rule as in lockstep."""
    n = len(sym)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []
    alive = [True] * n
    key = drop.keyed(np.array([document], np.int64))

    def push(i: int) -> None:
        j = after[i]
        if j < n and (found := model.merges.get((sym[i], sym[j]))):
            places = (np.array([x + first]) for x in (i, j, end[j]))
            if not drop.skips(key, *places)[0]:
                heapq.heappush(heap, (found[0], i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] == stop):
            continue
        found = model.merges.get((sym[i], sym[j]))
        if found is None:
            continue
        sym[i], end[i], alive[j] = found[1], stop, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [s if a else -1 for s, a in zip(sym, alive, strict=True)]


def encode(column: pa.Array, keys: np.ndarray, path: str, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the n + 1 offsets of the texts in them; null counts as empty.

    keys tell documents apart in the hash. A text's own blank mark (U+2581) goes by its bytes, as it would decode to a
    space.
    """
    model, drop = model_at(path), Dropout(seed, dropout)
    data, offsets = flat(column)
    # the texts as code points, each that is not empty after a blank
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = data & 0xC0 != 0x80
    ends = np.concatenate([[0], np.cumsum(lead)])[offsets]
    sizes = np.diff(ends)
    marked = sizes + (sizes > 0)
    begins = np.cumsum(marked) - marked
    sym = np.full(int(marked.sum()), model.blank, np.int64)
    sym[ranges(begins + 1, sizes)] = np.where(points == 32, model.blank, np.where(points == ord(_SPACE), model.size + 0x110000, model.symbol[points]))
    document = np.repeat(keys, marked)
    offset = -np.repeat(begins, marked)
    # words: a blank after something else starts one; what is in no piece stands alone
    lone = sym >= model.size
    cut = np.zeros(len(sym), bool)
    cut[1:] = ((sym[1:] == model.blank) & (sym[:-1] != model.blank)) | ((lone[1:] | lone[:-1]) & ~model_joins(model, sym))
    cut[begins[marked > 0]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(sym)))
    out = np.full(len(sym), -1, np.int64)
    short = lengths <= _LONG
    place = ranges(starts[short], lengths[short])
    first = starts[short]
    words = np.concatenate([[0], np.cumsum(lengths[short])])
    out[place] = _lockstep(model, drop, sym[place].astype(np.int32), words, document[first], first + offset[first])
    for a, n in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
        out[a : a + n] = _agenda(model, drop, sym[a : a + n].tolist(), int(document[a]), a + int(offset[a]))
    return _with_bytes(model, out, begins, marked)


def model_joins(model: Model, sym: np.ndarray) -> np.ndarray:
    """Whether a pair of neighbours with a character that is no piece by itself can still merge."""
    odd = np.flatnonzero((sym[1:] >= model.size) | (sym[:-1] >= model.size))
    found = np.zeros(len(sym) - 1, bool) if len(sym) else np.zeros(0, bool)
    if len(odd):
        found[odd] = np.isin(sym[odd], model.odd) | np.isin(sym[odd + 1], model.odd) if len(model.odd) else False
    return found


def _with_bytes(model: Model, out: np.ndarray, begins: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in order, characters without a piece as the ids of their bytes."""
    doc = np.repeat(np.arange(len(marked)), marked)[out >= 0]
    ids = out[out >= 0]
    odd = np.flatnonzero(ids >= model.size)
    counts = np.ones(len(ids), np.int64)
    points = ids[odd] - model.size
    points = np.where(points == 0x110000, ord(_SPACE), points)
    raw = [chr(p).encode() for p in points.tolist()]
    counts[odd] = np.fromiter(map(len, raw), np.int64, len(raw))
    final = np.repeat(ids, counts)
    if len(odd):
        at = ranges((np.cumsum(counts) - counts)[odd], counts[odd])
        final[at] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    per_doc = np.bincount(doc, counts, len(marked)).astype(np.int64)
    return final, np.concatenate([[0], np.cumsum(per_doc)])


def decode(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """The texts' bytes: pieces one after the other without the first blank."""
    model = model_at(path)
    sizes = model.text_sizes[ids]
    raw = take_bytes(model.texts, model.text_starts[ids], sizes).tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
    return [raw[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(-1).to_numpy()


_IDS = "doc_id long, ids array<int>"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1, model_path: str | None = None) -> DataFrame:
    """doc_id and ids per input row. Null and empty texts have no ids; rows that repeat id and text get equal ids.

    Any text has ids, with characters that no piece holds as bytes. Other columns are not read.
    """
    if not 0 <= dropout <= 1:
        raise ValueError("dropout is a probability")
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            ids, at = encode(batch.column("text"), _keys(batch), path, seed, dropout)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _IDS)


def decoded(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give an empty text."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            at = lists.offsets.to_numpy().astype(np.int64)
            texts = decode(lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0], path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, lossless per input row.

    Null and empty texts have no tokens and decode to an empty text; a null id hashes as -1. Repeated rows get equal
    results. An empty table gives no rows; other columns are not read.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            ids, at = encode(batch.column("text"), _keys(batch), path, seed, dropout)
            raw, ends = ids.astype("<u4").tobytes(), (4 * at).tolist()
            data, offsets = flat(batch.column("text"))
            whole, bounds = data.tobytes(), offsets.tolist()
            back = decode(ids, at, path)
            columns = [
                pa.array(np.diff(at)),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                pa.array([t == whole[a:b] for t, a, b in zip(back, bounds[:-1], bounds[1:], strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
