"""Token ids of a whole Arrow column under a public byte-level BPE vocabulary.

A text falls into segments that the vocabulary's split pattern never crosses: before a space that something visible
follows, and before a run of white space that ASCII precedes. Segments repeat, so each distinct one of a batch is
encoded once and the ids are gathered by numpy. (tiktoken encodes them from the rank file, which is faster than
tokenizers on the JSON file; the ids are the same.) Texts are cut at the vocabulary's added tokens first, such as
<|endoftext|>, which tokenizers looks for in every text, also with add_special_tokens=False.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken

from lapel.llm.common import flat, ranges


def default_ranks() -> str:
    """The file of the vocabulary that byte_bpe_50k.json holds too; both give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizers file and their ids."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in or ask for what is beside them are not supported")
    return {t["content"]: t["id"] for t in added}


def vocabulary(ranks_path: str | None = None) -> tuple[str, dict[str, int]]:
    """The rank file and the added tokens: the default vocabulary's, or none beside a file of one's own."""
    return (ranks_path, {}) if ranks_path else (default_ranks(), added_tokens())


@lru_cache(maxsize=4)
def _encoding(ranks_path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Lead bytes under which Unicode keeps white space beyond ASCII.
_SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the segments; each text that is not empty starts one."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    visible = np.ones(256, bool)
    visible[:33] = False
    visible[list(_SPACE_LEADS)] = False
    ascii_visible = np.zeros(256, bool)
    ascii_visible[33:127] = True
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 32) & visible[data[1:]]
    cut[1:] |= blank[data[1:]] & ascii_visible[data[:-1]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    before_end = ends[data[ends] == 32]
    cut[before_end] = False  # the byte after it belongs to the next text
    inner = before_end[(before_end > 0)]
    inner = inner[ascii_visible[data[inner - 1]]]
    cut[inner] = True
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(cut)


def encode(column: pa.Array, ranks_path: str, added: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the n + 1 offsets of the texts in them; null counts as empty.

    With added tokens (by content), those get their ids and part what is on either side.
    """
    data, offsets = flat(column)
    known = {t.encode(): n for t, n in (added or {}).items()}
    found = list(_found(data.tobytes(), offsets, known)) if known else []
    if not found:
        return _plain(data, offsets, ranks_path)
    edges = np.array([m.span() for m in found], np.int64)
    cuts = np.union1d(offsets, edges)
    lengths = np.diff(cuts)
    special = np.zeros(len(lengths), bool)
    special[np.searchsorted(cuts, edges[:, 0])] = True
    rest = data[~np.repeat(special, lengths)]
    bounds = np.concatenate([[0], np.cumsum(np.where(special, 0, lengths))])
    ids, at = _plain(rest, bounds, ranks_path)
    places = at[np.flatnonzero(special)]
    ids = np.insert(ids, places, np.array([known[m[0]] for m in found], np.uint32))
    at = at + np.concatenate([[0], np.cumsum(special)])
    return ids, at[np.searchsorted(cuts, offsets)]


def _found(raw: bytes, offsets: np.ndarray, known: dict[bytes, int]) -> Iterator[re.Match[bytes]]:
    """Leftmost matches, the longest at a place, of those that lie in one text."""
    wanted = re.compile(b"|".join(map(re.escape, sorted(known, key=len, reverse=True))))
    m = wanted.search(raw)
    while m:
        inside = m.end() <= offsets[np.searchsorted(offsets, m.start(), "right")]
        if inside:
            yield m
        m = wanted.search(raw, m.end() if inside else m.start() + 1)


def _plain(data: np.ndarray, offsets: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    starts = _segments(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    one = _encoding(ranks_path).encode_ordinary
    ids = [one(s.decode()) for s in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    known = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
    codes = coded.indices.to_numpy()
    counts = lengths[codes]
    out = known[ranges((np.cumsum(lengths) - lengths)[codes], counts)]
    before = np.concatenate([[0], np.cumsum(counts)])
    return out, before[np.searchsorted(starts, offsets)]
