"""Fill-in-middle: a document cut in prefix, middle and suffix at two places drawn from its id, and put back together.

Places are code points, texts are UTF-8. The batch keeps a sparse index of exceptions only: where characters of more
than one byte lie, and the bytes they take beyond one. A cut is turned from code points into bytes by a searchsorted in
that index; between exceptions one is the other plus a constant, so plain ASCII costs arithmetic alone. No text is
decoded or scanned per character, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.llm.common import flat, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


class Exceptions:
    """Code points and bytes of a batch of texts, one after the other, by the characters that take more than one byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lead = np.flatnonzero(data >= 0xC0)
        excess = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        #: bytes beyond one of all exceptions before each, and of all
        self.before = np.concatenate([[0], np.cumsum(excess)])
        #: the code point that each exception is, counted over the whole batch
        self.point = lead - self.before[:-1]
        self.lead = lead
        self.offsets = offsets
        self.points = self.to_points(offsets)

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte places that lie between characters."""
        return at - self.before[np.searchsorted(self.lead, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Byte places of code points, both counted over the whole batch."""
        return at + self.before[np.searchsorted(self.point, at)]


@dataclass(frozen=True)
class Draw:
    """The document's four numbers, below 2**32 each: two for the cuts, one for the form, one for the order."""

    seed: int

    def of(self, ids: list[int | None]) -> np.ndarray:
        keys = (hashlib.sha256(f"{self.seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
        return np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4).astype(np.int64)


def cuts(ids: list[int | None], column: pa.Array, seed: int, plain: int, spm: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For each text its code points, its form, and the cuts in code points and in bytes of the text (two columns)."""
    data, offsets = flat(column)
    index, h = Exceptions(data, offsets), Draw(seed).of(ids)
    n = np.diff(index.points)
    places = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    bytes_at = index.to_bytes(index.points[:-1, None] + places) - offsets[:-1, None]
    whole, bounds = data.tobytes(), offsets.tolist()
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = whole.find(mark)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(mark) <= bounds[k + 1]
            marked[k] |= inside
            at = whole.find(mark, bounds[k + 1] if inside else at + 1)  # one is enough; one across two texts is none
    kept = (n == 0) | marked | (h[:, 2] % 100 >= 100 - plain)
    forms = np.where(kept, PLAIN, np.where(h[:, 3] % 100 < spm, SPM, PSM)).tolist()
    return n, forms, places, bytes_at


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text in its form; a and b are the byte places of the cuts."""
    if form == PLAIN:
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (SUFFIX, suffix, PREFIX, prefix) if form == SPM else (PREFIX, prefix, SUFFIX, suffix)
    return b"".join((*parts, MIDDLE, middle))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text from its output and form alone. A text that is cut holds no mark, and no two marks' ends look like a third."""
    if form == PLAIN:
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    at, end = output.index(second, len(first)), output.index(MIDDLE, len(first))
    one, other = output[len(first) : at], output[at + len(second) : end]
    prefix, suffix = (other, one) if form == SPM else (one, other)
    return prefix + output[end + len(MIDDLE) :] + suffix


Shown = Callable[[bytes, str], list]


def _run(docs: DataFrame, id_col: str, text_col: str, seed: int, plain: int, spm: int, shown: Shown, columns: list[tuple[str, pa.DataType]], more: str) -> DataFrame:
    if not (0 <= plain <= 100 and 0 <= spm <= 100):
        raise ValueError("plain and spm are per cents")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *[c for c, _ in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            n, forms, places, at = cuts(batch.column("doc_id").to_pylist(), batch.column("text"), seed, plain, spm)
            data, offsets = flat(batch.column("text"))
            whole, bounds = data.tobytes(), offsets.tolist()
            texts = zip(bounds[:-1], bounds[1:], forms, at.tolist(), strict=True)
            out = [shown(arranged(whole[a:b], form, *cut), form) for a, b, form, cut in texts]
            uncut = pa.array([f == PLAIN for f in forms])
            lengths = [pc.if_else(uncut, pa.scalar(None, pa.int64()), pa.array(x)) for x in (places[:, 0], places[:, 1] - places[:, 0])]
            rest = [pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), *lengths, *rest], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_OUT}, {more}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per input row: doc_id, n (code points), form, prefix_chars, middle_chars, output (the text in its form).

    The form is plain for `plain` per cent of documents, for empty texts and for texts that hold a mark themselves; of the
    others `spm` per cent have their suffix first. Cuts may lie at either end, so parts can be empty. Equal ids and texts
    have equal rows. Null text counts as empty; a null id draws as an empty one. Plain rows have null lengths. An empty
    table gives no rows; other columns are not read.
    """
    return _run(docs, id_col, text_col, seed, plain, spm, lambda out, form: [out.decode()], [("output", pa.string())], "output string")


def restored(rows: DataFrame) -> DataFrame:
    """doc_id and text for rows with doc_id, form and output, as `fill_in_middle` gives them; null output gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output", 8 << 20):
            pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
            texts = [None if o is None else rebuilt(o.encode(), f).decode() for o, f in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """As `fill_in_middle`, with output_sha256 and restored_sha256 (of the text rebuilt from output and form) for output."""

    def shown(out: bytes, form: str) -> list:
        return [hashlib.sha256(out).hexdigest(), hashlib.sha256(rebuilt(out, form)).hexdigest()]

    columns = [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    return _run(docs, id_col, text_col, seed, plain, spm, shown, columns, "output_sha256 string, restored_sha256 string")


def oracle() -> str:
    return """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
                     CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                                ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """
