"""Decontamination, the source audit and fill-in-middle against versions by hand."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapel.llm import decontamination, fill_in_middle, source_audit
from tests.llm.data import CLASHES, awkward, documents, words



@pytest.fixture(autouse=True)
def hand_made(spark, quick):
    """Few rows: not worth compiling code for."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


# ---- decontamination ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def item_windows(text, width):
    w = item_words(text)
    size = min(width, len(w))
    return [(i, tuple(w[i : i + size])) for i in range(len(w) - size + 1)] if w else []


def hits_by_hand(docs, items, width):
    owners = defaultdict(set)
    for item, text in items:
        for _, w in item_windows(text, width):
            owners[w].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for size in {len(x) for x in owners}:
            for a in range(len(w) - size + 1):
                if own := owners.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def benchmark_of(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASHES if c != "text"})


ITEMS = [
    (1, " ".join(words(1, 45).split()[5:30])), (2, words(1, 45)), (10, "One, two!"), (11, "two"), (12, None), (13, " .,- "),
    (14, words(100, 30)), (None, words(9, 80)), (15, words(2, 300).upper()), (1, "la la la"), (16, "É" * 40), (17, "same LINE same line"), (18, "é" * 40),
]
PAGES = [*awkward(), (20, "ONE\ttwo. three"), (21, "one"), (22, "two " * 3), (23, words(2, 300)[:900].replace(" ", "-")), (24, words(1, 9)), (24, words(1, 12))]


@pytest.mark.parametrize(("width", "segment", "most"), [(10, 4 << 20, 1 << 20), (10, 1 << 10, 64), (3, 1 << 14, 17), (1, 4 << 20, 1 << 20)])
def test_contamination(spark, width, segment, most):
    found = decontamination.contamination(documents(spark, PAGES), benchmark_of(spark, ITEMS), window=width, segment_bytes=segment, most_words=most)
    expected = hits_by_hand(PAGES, ITEMS, width)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert 5 < sum(r[5] for r in expected) < len(PAGES)


def test_contamination_of_nothing(spark):
    none = decontamination.contamination(documents(spark, []), benchmark_of(spark, ITEMS))
    assert none.collect() == []
    clean = decontamination.contamination(documents(spark, PAGES), benchmark_of(spark, [])).collect()
    assert len(clean) == len(PAGES) and not any(r["contaminated"] for r in clean)
    with pytest.raises(ValueError, match="window"):
        decontamination.contamination(documents(spark, PAGES), benchmark_of(spark, ITEMS), window=0)


def test_a_hot_window_held_by_many_items_and_documents(spark):
    """A third of all documents and of all items hold one passage, and some words stand everywhere."""
    passage = "the of and to in a is that it was he for"
    docs = [(i, f"{words(i, 20, 50)} {passage if i % 3 == 0 else 'the of and'} {words(i + 900, 20, 50)}") for i in range(300)]
    items = [(i, f"{passage} {words(i + 2000, 15, 50)}" if i % 3 == 0 else words(i + 3000, 20, 50)) for i in range(90)]
    found = decontamination.contamination(documents(spark, docs), benchmark_of(spark, items), segment_bytes=1 << 12, most_words=300)
    assert sorted(map(tuple, found.collect())) == sorted(hits_by_hand(docs, items, 10))


def test_exact_phrases(spark):
    index = decontamination.build_index(documents(spark, PAGES), segment_bytes=1 << 12)
    got = decontamination.phrase_matches(index, benchmark_of(spark, ITEMS), window=5, most_words=20).collect()
    expected = Counter()
    for i, text in PAGES:
        w = item_words(text)
        for item, test in ITEMS:
            for at, window in item_windows(test, 5):
                for a in range(len(w) - len(window) + 1):
                    if tuple(w[a : a + len(window)]) == window:
                        expected[(i, a, len(window), "" if item is None else str(item), at)] += 1
    # a split item shares windows with no other part, so each is found once
    assert Counter((r["doc_id"], r["start"], r["length"], r["item_id"], r["item_start"]) for r in got) == expected
    rows = decontamination.indexed_documents(index)
    assert Counter((r["doc_id"], r["n_words"]) for r in rows.collect()) == Counter((i, len(item_words(t))) for i, t in PAGES)
    assert rows.select("row").distinct().count() == len(PAGES)


def near_by_hand(text, window, within):
    """Least stretches: from each place, the first end by which every word has stood; of equal ends the latest start."""
    w, wanted = item_words(text), set(window)
    ends = {}
    for a in range(len(w)):
        if w[a] in wanted:
            for b in range(a, min(a + within, len(w))):
                if wanted <= set(w[a : b + 1]):
                    ends[b] = a
                    break
    return {(a, b - a + 1) for b, a in ends.items()}


def test_proximity(spark):
    docs = [(i, words(i, 120, 12)) for i in range(40)] + [(None, None), (50, "")]
    items = [(1, "w1 w2 w3"), (2, "w4 w4 w5"), (3, "w9"), (4, "w1 nowhere"), (5, words(77, 8, 12)), (6, "w3 w2 w1")]
    index = decontamination.build_index(documents(spark, docs), segment_bytes=1 << 10)
    for width, within in ((3, 5), (3, 3), (4, 30)):
        got = decontamination.proximity_matches(index, benchmark_of(spark, items), window=width, within=within).collect()
        expected = Counter(
            (i, a, n, str(item), at) for i, text in docs for item, test in items for at, window in item_windows(test, width) for a, n in near_by_hand(text, window, within)
        )
        assert Counter((r["doc_id"], r["start"], r["length"], r["item_id"], r["item_start"]) for r in got) == expected
        assert len(expected) > 40


# ---- source audit ----


def audit_by_hand(rows, least, top):
    """Everything filled in, in whole numbers."""
    groups, total, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(terms)
        total[lang].update(terms)
        held[lang].update(set(terms))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        mine, all_of = p(own), p(total[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                q = p(counts)
                pairs.append((other, sum(f(mine[t], q[t]) for t in kept)))
        terms = [(t, f(mine[t], all_of[t])) for t in kept if own[t] > 0 and mine[t] > all_of[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return out


def audited(seed=0):
    rows = [(words(k, 40, 60), ("en", "de", None)[k % 3], None if k % 11 == 0 else f"s{k % 5}") for k in range(seed, seed + 150)]
    rows += [("The ÉTÉ été x1y2z Ünï \U0001f600a" * 3, "en", f"s{k % 3}") for k in range(15)]
    return [*rows, (None, "fr", "s1"), ("", "fr", "s2"), ("rare words only", "it", "s1"), ("1 2 3", "it", None), ("hot " * 50_000, "en", "s0"), ("w1 " * 9, "en", "s0")]


@pytest.mark.parametrize("options", [{}, {"block_sources": 2, "block_cells": 16}, {"block_sources": 1, "block_cells": 1}, {"least_docs": 1, "top": 3}])
def test_divergence(spark, options):
    from pyspark.sql import functions as F

    rows = audited()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ["term", "docs", "n", "p", "q", "total", "terms", "item", "rank", "a.b"]})
    found = source_audit.divergence(docs, **options)
    expected = audit_by_hand(rows, options.get("least_docs", 10), options.get("top", 10))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_divergence_of_nothing_and_of_counts_handed_on_early(spark):
    schema = "text string, lang string, source string"
    assert source_audit.divergence(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame(audited(7), schema).coalesce(1)

    def sums(most):
        rows = source_audit.term_counts(docs, most=most).groupBy("lang", "source", "term").sum("docs", "n")
        return sorted(map(tuple, rows.collect()), key=repr)

    assert sums(10) == sums(300_000)


def test_numbers_beyond_a_long_stay_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7 * 10**12, 10**13 + 1, 10**6), (0, 0, 0)], "n long, total long, terms long")
    got = [r[0] for r in df.select(source_audit._probability(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (7 * 10**12 + 2) // (10**13 + 1 + 2 * 10**6), None]


# ---- fill in middle ----


def middle_by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, a, b - a, out


MARKED = [(60, "a <P> b"), (61, "<S>"), (62, "ends in <"), (63, "S> <P"), (64, "x<M"), (65, "<M>" * 50), (66, "é<é\U0001f600>" * 30), (67, "ࠀ\U0010ffff\x00"), (68, "<" * 40), (69, "M><S")]


def test_fill_in_middle(spark):
    docs = [*awkward(), *MARKED, *[(i, "aé中\U0001f600" * (i % 9) + "z" * (i % 7)) for i in range(100, 400)]]
    out = fill_in_middle.fill_in_middle(documents(spark, docs))
    expected = [middle_by_hand(i, t) for i, t in docs]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in expected}
    back = fill_in_middle.restored(out)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in docs)
    hashes = fill_in_middle.digest(documents(spark, docs)).select("doc_id", "output_sha256", "restored_sha256").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, hashes)) == Counter((e[0], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, docs, strict=True))
    assert fill_in_middle.fill_in_middle(documents(spark, [])).collect() == []


def test_shares(spark):
    docs = [(i, "some text") for i in range(2000)]
    count = Counter(r["form"] for r in fill_in_middle.fill_in_middle(documents(spark, docs), seed=5, plain=30, spm=50).collect())
    assert abs(count["plain"] - 600) < 90 and abs(count["spm"] - 700) < 90
    assert {r["form"] for r in fill_in_middle.fill_in_middle(documents(spark, docs), plain=0, spm=100).collect()} == {"spm"}
    with pytest.raises(ValueError, match="per cents"):
        fill_in_middle.fill_in_middle(documents(spark, docs), plain=101)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.text(st.sampled_from("<>PSMaé中\U0001f600\n"), max_size=30)), min_size=1, max_size=8))
def test_cuts_and_marks(rows):
    import pyarrow as pa

    ids, texts = zip(*rows, strict=True)
    n, forms, places, at = fill_in_middle.cuts(list(ids), pa.array(texts, pa.string()), 1, 10, 20)
    for k, text in enumerate(texts):
        raw = text.encode()
        a, b = at[k].tolist()
        assert n[k] == len(text) and raw[:a].decode() == text[: places[k, 0]] and raw[:b].decode() == text[: places[k, 1]]
        for form in {forms[k], *(() if re.search("<[PSM]>", text) else ("psm", "spm"))}:
            assert fill_in_middle.rebuilt(fill_in_middle.arranged(raw, form, a, b), form) == raw
