"""Merge-dropout against a version of its own: plain strings, a loop over all pairs, and the hash in whole numbers."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lapel.llm import sentencepiece_dropout as D
from tests.llm.data import words

ALL = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


@pytest.fixture(scope="module")
def model():
    sp = sentencepiece.SentencePieceProcessor(model_file=D.default_model())
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    return {sp.id_to_piece(i): (-sp.get_score(i), i) for i in plain}, by_bytes


def by_hand(model, text, document, seed, dropout):
    """The whole text as one agenda; a part is its piece's text, where it begins and where it ends."""
    pieces, by_bytes = model
    if not text:
        return []
    parts = [("▁", 0, 1), *(("▁" if c == " " else "\U0010ffff▁" if c == "▁" else c, k + 1, k + 2) for k, c in enumerate(text))]

    def skipped(start, middle, end):
        x = mixed((document & ALL) ^ mixed(seed & ALL))
        for place in (start, middle, end):
            x = mixed(x ^ place)
        return x < min(int(dropout * 2**64), ALL)

    while True:
        best = None
        for k, ((a, start, middle), (b, _, end)) in enumerate(zip(parts[:-1], parts[1:], strict=True)):
            if a + b in pieces and not skipped(start, middle, end) and (best is None or pieces[a + b] < best[0]):
                best = (pieces[a + b], k)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1], parts[k + 1][2])]
    ids = []
    for p, _, _ in parts:
        ids += [pieces[p][1]] if p in pieces else [by_bytes[x] for x in p.replace("\U0010ffff", "").encode()]
    return ids


TEXTS = [
    "", " ", "   ", "a", "The quick brown fox jumps over the lazy dog.", "  two  blanks and\ta tab\nand lines\n\n", "ññ áé über straße naïve",
    "日本語のテキスト 中文 русский текст", "\U0001f600\U0001f600 x ͸ \x00\x7f", "▁own ▁ marks▁▁", "x" * 300, "ab" * 140 + " end", "=" * 64 + " ----" * 9,
    "1234567890 3.14159 2024-01-01", words(3, 60), "internationalization " * 6, "http://www.example.com/a?b=c&d=e", "é à",
]


@pytest.mark.parametrize(("seed", "dropout"), [(0, 0.0), (20, 0.1), (-7, 0.5), (3, 0.97), (1, 1.0)])
def test_segmentations(model, seed, dropout):
    pick = random.Random(seed)
    letters = "".join(pick.choice("aeinrst ldou") for _ in range(400))
    texts = [*TEXTS, letters, *("".join(pick.choice("ab é中 the.\n▁") for _ in range(40)) for _ in range(30))]
    keys = np.array([pick.randrange(-(2**40), 2**40) for _ in texts])
    ids, at = D.encode(pa.array(texts, pa.string()), keys, D.default_model(), seed, dropout)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == by_hand(model, text, int(keys[k]), seed, dropout), (text, dropout)
    assert D.decode(ids, at, D.default_model()) == [t.encode() for t in texts]


def test_slices_do_not_matter(spark, model):
    """A document's segmentation depends on its id and text alone, not on what it is worked on with."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, words(k, 3_000 if k % 50 == 0 else 30)) for k in range(120)], "doc_id long, text string")
    ids = {r["doc_id"]: r["ids"] for r in D.encoded(docs.repartition(3), seed=20).collect()}
    for r in docs.filter(F.col("doc_id") % 17 == 3).collect():
        assert ids[r["doc_id"]] == by_hand(model, r["text"], r["doc_id"], 20, 0.1)
    assert ids == {r["doc_id"]: r["ids"] for r in D.encoded(docs.coalesce(1), seed=20).collect()}
