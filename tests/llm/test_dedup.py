"""The four deduplications against brute force on awkward rows, and their ways out of memory and skew."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lapel.llm import exact_dedup as E
from lapel.llm import simhash as H
from lapel.llm import stretches as S
from lapel.llm import suffix_dedup as B
from lapel.llm import substring_dedup as W
from lapel.llm.components import components
from tests.llm.data import awkward, documents, words

LAST = 2**63 - 1


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- exact ----


def exact_by_hand(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        spare = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and spare, sha(norm.encode())))
            spare = spare and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("memory", [64 << 20, 2_000])
def test_exact(spark, memory):
    docs = awkward()
    found = E.exact_dedup(documents(spark, docs), memory_bytes=memory)
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_by_hand(docs)
    assert E.exact_dedup(documents(spark, [])).count() == 0


def test_exact_keeps_one_of_each(spark):
    docs = documents(spark, awkward())
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    expected = sorted((i, s) for i, _, _, k, s in exact_by_hand(awkward()) if k and i is not None)
    found = [(r["doc_id"], sha(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode())) for r in kept.collect()]
    assert sorted((i, s) for i, s in found if i is not None) == expected
    assert sum(i is None for i, _ in found) == 1  # only a text that no named row holds is kept under a null id


def test_grace_spills_and_compares_content():
    texts = [words(k % 700, 12).encode() for k in range(2_000)]
    records = [(sha(t), t, k, 1) for k, t in enumerate(texts)]
    found = {t: (least, n) for _, t, least, n in E.grace(iter(records), memory=4_000)}
    expected = {t: (texts.index(t), texts.count(t)) for t in set(texts)}
    assert found == expected
    with pytest.raises(ValueError, match="share"):
        list(E.grace(iter([("0" * 64, b"a", 1, 1), ("0" * 64, b"b", 2, 1)]), memory=10_000))


# ---- simhash ----


def print_by_hand(text, shingle=4, seed=42):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(docs, bits=4):
    """Fingerprint and component of each row."""
    prints = [print_by_hand(t) for _, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    return prints, label


def near_by_hand(docs, bits=4):
    prints, label = components_by_hand(docs, bits)
    least = {x: min((i for (i, _), y in zip(docs, label, strict=True) if x == y and i is not None), default=None) for x in label}
    return sorted(((i, f"{p:016x}", least[x]) for (i, _), p, x in zip(docs, prints, label, strict=True)), key=repr)


def kept_by_hand(docs):
    """Of each component the least id, of its texts the first by digest."""
    groups = {}
    for (i, t), x in zip(docs, components_by_hand(docs)[1], strict=True):
        groups.setdefault(x, []).append((i is None, i or 0, sha((t or "").encode())))
    return [(None if none else i, digest) for none, i, digest in map(min, groups.values())]


def near_copies(n):
    """Copies of one text with a word changed here and there: a chain of links rather than a star."""
    base = words(11, 400).split()
    out = []
    for k in range(n):
        own = list(base)
        for j in range(k % 7):
            own[(37 * k + 53 * j) % 400] = f"x{k}{j}"
        out.append((1000 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("block", [16_384, 5])
def test_simhash(spark, block):
    docs = awkward() + near_copies(40)
    found = H.simhash_components(documents(spark, docs), block=block)
    assert rows(found, "doc_id", "fingerprint", "component_id") == near_by_hand(docs)


def test_simhash_empty(spark):
    assert H.simhash_components(documents(spark, [])).count() == 0


def kept_rows(df):
    return sorted(((r["doc_id"], sha((r["text"] or "").encode())) for r in df.collect()), key=repr)


def test_simhash_keeps_the_least(spark):
    docs = awkward() + near_copies(20)
    df = documents(spark, docs)
    kept = H.drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept_rows(kept) == sorted(kept_by_hand(docs), key=repr)
    assert H.drop_near_copies(documents(spark, [])).collect() == []


def test_rows_that_share_an_id_are_judged_each_for_itself(spark):
    a, b = words(31, 200), words(32, 200)
    near = a.replace(a.split()[9], "other", 1)
    docs = [(5, a), (9, a), (9, b), (9, b), (11, b), (None, a), (None, words(33, 90)), (12, near), (5, near)]
    got = kept_rows(H.drop_near_copies(documents(spark, docs)))
    assert got == sorted(kept_by_hand(docs), key=repr) and [i for i, _ in got] == [5, 9, None]


def test_links_by_index_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(12):
            fps.add(int(s) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 6), replace=False)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (16_384, 7):
        found = {r["node"]: r["root"] for r in components(H.links(nodes, 4, block)).collect()}
        group = {f: found.get(f, f) for f in signed}
        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    assert group[a] == group[b]
        by_hand = near_fps(signed)
        assert len(set(group.values())) == len(set(by_hand.values()))


def near_fps(fps):
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {f: new if x == old else x for f, x in label.items()}
    return label


def test_every_set_of_shared_positions_is_covered():
    from itertools import combinations

    for shared in range(1, 9):
        cover = [set(c) for c in H.covering(shared)]
        assert all(any(c <= set(s) for c in cover) for s in combinations(range(8), shared))
    assert len(H.covering(4)) == 20


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- repeated passages ----


def substring_by_hand(docs, k=20):
    seen = defaultdict(list)
    split = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - k + 1):
            seen[tuple(w[p : p + k])].append((i, p))
    first = {g: min(v) for g, v in seen.items()}
    out = []
    for (i, _), (key, w) in zip(docs, split, strict=True):
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (key, p):
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), sha(kept.encode()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1_000_000, 300])
def test_substring(spark, most):
    docs = awkward()
    found = W.substring_dedup(documents(spark, docs), most_windows=most)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == substring_by_hand(docs)


def test_substring_short_windows(spark):
    docs = [(i, t) for i, t in awkward() if t is None or len(t) < 5_000]
    found = W.substring_dedup(documents(spark, docs), k=3, m=1)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == substring_by_hand(docs, 3)
    assert W.substring_dedup(documents(spark, [])).count() == 0


def suffix_by_hand(docs, width=50):
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in raw:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, _), (key, b) in zip(docs, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < key:
                gone[p : p + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0]))
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, sha(kept), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "chunk"), [(2_000_000, 2 << 20), (700, 512)])
def test_suffix(spark, most, chunk):
    docs = [(i, t and t[:30_000]) for i, t in awkward()]
    found = B.suffix_dedup(documents(spark, docs), most_windows=most, chunk_bytes=chunk)
    got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.collect()), key=repr)
    assert got == suffix_by_hand(docs)


def test_suffix_payloads_follow_the_partitions(spark, monkeypatch):
    packs, removed = [], S.removed
    monkeypatch.setattr(S, "removed", lambda df, *rest: packs.append(df) or removed(df, *rest))
    docs = documents(spark, [(i, words(i, 300)) for i in range(60)])
    found = B.suffix_dedup(docs)
    payloads = packs[0].filter("windows > 0").count()
    assert 0 < payloads <= docs.rdd.getNumPartitions() * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 60


def covered(batches):
    out = set()
    for b in batches:
        for i, row, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out.update((i, row, p) for p in range(lo, hi))
    return out


@pytest.mark.parametrize("cuts", [0, 1])
def test_a_suffix_bucket_beyond_memory_is_split_by_other_tokens(cuts):
    width, none = 50, np.zeros(1 << B._SLOTS, bool)
    common = min((f"c{k:06d}" for k in range(2_000)), key=lambda w: int.from_bytes(f" {w}".encode()) * int(B._RANK) % 2**64)
    texts = [" ".join(f"{w} {common}" for w in words(k, 100).split()) for k in range(40)]
    texts += [f"{words(100 + k, 20)} {texts[k][200:700]}" for k in range(20)]
    offsets = np.cumsum([0, *map(len, texts)])
    ids, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    s, token, _ = B._stretches(ids, zero, np.frombuffer("".join(texts).encode(), np.uint8), offsets, zero, width, none)
    values, counts = np.unique(token, return_counts=True)
    heavy = values[counts.argmax()]
    splitters = np.array([heavy, heavy + np.uint64(1)], np.uint64)[: 2 * cuts]
    bucket = np.searchsorted(splitters, token, "right")
    split, handed = B._split_task(width, none, splitters), []

    def thin(s, part, parts):
        raise AssertionError("a slice reads all of the bucket again")

    def counted(s, path, parts):
        handed.append(int(s.windows.sum()))
        return split(s, path, parts)

    batches = list(S.payloads(iter([(s, bucket)]), 1, 1 << 20))
    most = int(s.windows.sum()) // 8
    found = covered(S.bucket_task(B._resolve_task(width), thin, most, width // 3, counted)(iter(batches)))
    whole = covered(S.bucket_task(B._resolve_task(width), thin, 1 << 30, width // 3)(iter(batches)))
    assert found == whole and len(whole) >= 20 * 500
    assert most < sum(handed) <= 4 * s.windows.sum()


def test_a_passage_in_very_many_documents_is_folded_while_it_is_split():
    width, passage = 50, words(1, 30)
    texts = [f"{words(2 * k, 3)} {passage} {words(2 * k + 1, 3)}" for k in range(2_000)]
    offsets = np.cumsum([0, *map(len, texts)])
    ids, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    s, _, _ = B._stretches(ids, zero, np.frombuffer("".join(texts).encode(), np.uint8), offsets, zero, width, np.zeros(1 << B._SLOTS, bool))
    most = int(s.windows.sum()) // 3
    resolved = []

    def resolve(s):
        resolved.append(int(s.windows.sum()))
        return B._resolve_task(width)(s)

    batches = list(S.payloads(iter([(s, np.zeros(len(s), np.int64))]), 1, 1 << 20))
    task = S.bucket_task(resolve, None, most, width // 3, B._split_task(width, np.zeros(1 << B._SLOTS, bool), np.zeros(0, np.uint64)))
    found = covered(task(iter(batches)))
    first = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    by_hand = {(i, 0, q) for i, t in enumerate(texts) for p in range(len(t) - width + 1) if first[t[p : p + width]] < i for q in range(p, p + width)}
    assert found == by_hand
    assert sum(resolved) < s.windows.sum() // 2


def test_suffix_empty(spark):
    assert B.suffix_dedup(documents(spark, [])).count() == 0


def test_multikey_sort_orders_suffixes():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 99, 3_000).astype(np.uint8)
    data[1000:1200] = data[200:400]
    at = np.arange(len(data) - 50)
    order, run = B.multikey_sort(B.leading_tokens(data), at, 50)
    strings = [data[i : i + 50].tobytes() for i in at[order].tolist()]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def test_stretches_survive_packing():
    s = S.Stretches(*(np.array(x, np.int64) for x in ([5, 5, 9], [1, 1, 2], [0, 70_000, 3], [1, 300, 2], [2, 3, 0])), np.frombuffer(b"abcde", np.uint8))
    back = S.unpacked(S.packed(s))
    for field in ("ids", "rows", "starts", "windows", "sizes", "data"):
        assert getattr(back, field).tolist() == getattr(s, field).tolist()
