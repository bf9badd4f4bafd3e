"""Secret scans: base patterns, and weak parts that count only together.

A weak part (a name used to log in, a random-looking string, an endpoint) says little alone. A random-looking string is
a whole run of 16 characters or more, quoted or not, also right after the = of name=value or a dot; a login name may have
a prefix, as in DB_USER. Parts are intervals in their text; within a scope a part is joined with the complementary parts
of that scope, however far apart, and is reported only where an identifier and a secret, or an endpoint and a secret,
meet. A scope is a paragraph; a fenced or bracketed block, and neighbouring paragraphs of settings (name=value), are one
scope whatever blank lines they hold. The join is a sweep over the sorted intervals of one text, so no rows move.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapel.llm.common import by_position, named_as, slices

Span = tuple[str, int, int]

BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("linked_identifier", "linked_secret", "linked_endpoint")
_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *LINKED_KINDS))}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")

_LOGIN_NAMES = "|".join(map(_either_case, ("client_id", "access_key_id", "account_id", "username", "user", "login")))
#: Keys that are built like a name's: AccountName, db_login, clientId.
_NAMED = "(?:[A-Za-z0-9]+(?:Name|User|Login|Email|Id)|[A-Za-z0-9_]+_(?:name|user|login|email|id)|[A-Z0-9_]+_(?:NAME|USER|LOGIN|EMAIL|ID)|[Ee]-?[Mm]ail|EMAIL)"
_LOGIN = re.compile(rf"""(?<![A-Za-z0-9])(?:{_LOGIN_NAMES}|{_NAMED})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{{3,}}""")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])(?:/[^\s\"'<>]*)?")
_PLAIN = re.compile(r"(?<![A-Za-z0-9@._/+-])(?:[a-z0-9-]+\.)+[a-z]{2,6}(?::[0-9]{2,5})?/[^\s\"'<>]*")
_PASSWORD = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s/?#@:]*:(?![0-9]{1,5}[/?#])([^\s?#@]+)@")
_VALUE = re.compile(r"[?&;#][^\s=&;#?]+=([^\s&;#]+)")
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
_FENCE = re.compile(r"^[\x20\t]*(?:```|~~~)", re.MULTILINE)
_BRACKET = re.compile(r"[{}\[\]]")
_SETTING = re.compile(r"""[\x20\t]*(?:export\x20+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?\x20*[:=](?!//)""")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind that do not overlap; those too short are dropped after matching. (A run of 24 hex digits
    or more starts where the run starts, so asking for the length at once finds the same.)"""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def random_looking(s: str) -> bool:
    """Letters and digits spread about as a key's would be; of one case only they must be more, and more mixed."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    both = any(c.islower() for c in s) and any(c.isupper() for c in s)
    if not digits or not letters or not both and (len(s) < 24 or min(digits, letters) < 5):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= (3.0 if both else 3.6)


def _blocks(text: str) -> list[tuple[int, int]]:
    """Fenced blocks, and outermost pairs of brackets that match, sorted."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    found = list(zip(fences[::2], fences[1::2], strict=False))
    stack: list[tuple[str, int]] = []
    for m in _BRACKET.finditer(text):
        if m[0] in "{[":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] + m[0] in ("{}", "[]"):
            found.append((stack.pop()[1], m.end()))
    return [(a, b) for _, a, b in _merged([("", a, b) for a, b in found])]


def scope_starts(text: str) -> list[int]:
    """Where scopes begin, and a last place beyond the text. A blank line ends a scope, but for one inside a block and one
    between two lines of settings."""
    inside = _Near(_blocks(text)) if _SCOPE_END.search(text) else _Near([])
    cuts = [0]
    for m in _SCOPE_END.finditer(text):
        before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        settings = _SETTING.match(before) and _SETTING.match(text, m.end())
        if not settings and not inside.around(m.start()):
            cuts.append(m.end())
    return [*cuts, len(text) + 1]


class _Near:
    """Disjoint intervals, sorted, to ask whether one lies in a stretch of the text."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]

    def within(self, low: int, high: int) -> bool:
        k = bisect_left(self.starts, high)
        return k > 0 and self.spans[k - 1][1] > low

    def meets(self, start: int, end: int, scope: tuple[int, int]) -> bool:
        """Whether one overlaps the given interval or lies in its scope, but for what only touches both scopes' edges."""
        return self.within(*scope) or self.within(start, end)

    def beside(self, start: int, end: int, scope: tuple[int, int]) -> bool:
        """The same, of intervals that reach out of the given one."""
        return self.within(scope[0], start) or self.within(end, scope[1])

    def around(self, at: int) -> tuple[int, int] | None:
        """The interval that holds the place."""
        k = bisect_left(self.starts, at + 1)
        return self.spans[k - 1] if k and self.spans[k - 1][1] > at else None


def _without(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of sorted, disjoint spans; those taken are sorted and disjoint too."""
    out, ends = [], [b for _, b in taken]
    for a, b in spans:
        k = bisect_right(ends, a)
        while k < len(taken) and taken[k][0] < b:
            if taken[k][0] > a:
                out.append((a, taken[k][0]))
            a = taken[k][1]
            k += 1
        if a < b:
            out.append((a, b))
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with a complementary part in their scope: identifiers and endpoints with a secret, secrets with either.

    A character belongs to one part, so nothing is its own partner: what a login name or an endpoint holds is no random
    string. Of a URL, the password before @ and the values of its parameters are not the endpoint's. The password goes
    with its URL; a value, which may be no more than the name of a page, wants a partner besides that.
    """
    taken = _Near([(a, b) for _, a, b in _merged(base)])
    named = [(a, b) for k, a, b in base if k == "access"]
    hidden = [(a, b) for _, a, b in _merged([s for s in base if s[0] != "access"])]
    free = [(m.start(), m.end()) for m in _RANDOM.finditer(text) if random_looking(m[0])]
    free = [s for s in free if not taken.within(*s)]
    if not (free or hidden):
        return []
    logins = [s for s in ((m.start(), m.end()) for m in _LOGIN.finditer(text)) if not taken.within(*s)]
    endpoints = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    passwords = [m.span(1) for m in (_PASSWORD.match(text, a, b) for a, b in endpoints) if m]

    def values(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [m.span(1) for a, b in spans for m in _VALUE.finditer(text, a, b)]

    def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(a, b) for _, a, b in _merged([("", a, b) for a, b in spans])]

    plain = [(m.start(), m.end()) for m in _PLAIN.finditer(text)] if free else []
    addresses = _without(endpoints, joined([*passwords, *values(endpoints)])) + _without(plain, values(plain))
    secrets = [(a, b) for a, b in _without(free, joined([*_without(logins, passwords), *addresses])) if b - a >= 16 and random_looking(text[a:b])]
    if not (secrets or hidden):
        return []
    cuts = scope_starts(text)

    def scope(at: int) -> tuple[int, int]:
        k = bisect_left(cuts, at + 1)
        return cuts[k - 1], cuts[k]

    urls, keys, whose = _Near(endpoints), _Near(passwords), _Near(joined([*logins, *named]))
    any_secret, sure = _Near([*secrets, *hidden]), _Near([*hidden, *(s for s in secrets if keys.around(s[0]))])

    def addressed(a: int, b: int) -> bool:
        """Whether an endpoint that the secret is no value of lies in its scope."""
        low, high = scope(a)
        own = None if keys.around(a) else urls.around(a)
        return urls.within(low, own[0]) or urls.within(own[1], high) if own else urls.within(low, high)

    found = [("linked_identifier", a, b) for a, b in logins if any_secret.meets(a, b, scope(a))]
    found += [("linked_endpoint", a, b) for a, b in endpoints if sure.within(a, b) or any_secret.beside(a, b, scope(a))]
    return found + [("linked_secret", a, b) for a, b in secrets if whose.meets(a, b, scope(a)) or addressed(a, b)]


def _merged(spans: list[Span]) -> list[Span]:
    """Overlapping spans as one."""
    out: list[Span] = []
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def secret_spans(text: str) -> list[Span]:
    """All spans of a text, in code points, by start and then kind."""
    base = base_spans(text)
    return sorted([*base, *linked_spans(text, base)], key=lambda s: (s[1], _ORDER[s[0]]))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each (merged) span replaced; endpoints stay, as they hide nothing by themselves."""
    out, upto = [], 0
    for _, a, b in _merged([s for s in spans if s[0] != "linked_endpoint"]):
        out += [text[upto:a], mark]
        upto = b
    return "".join(out) + text[upto:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end) with ends exclusive.

    Null and empty texts have no spans. Repeated rows get equal results. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in secret_spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with secrets in the text replaced; null texts stay null, empty ones empty. Repeated
    rows stay repeated; an empty table gives no rows."""

    rows, (text,) = by_position(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            column = batch.column(text)
            texts = [t and redacted(t, secret_spans(t)) for t in column.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(texts, column.type))

    return named_as(rows.mapInArrow(run, rows.schema), docs)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per base kind, the base spans' hash and all spans as text, per input row: as `scan`."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan(docs, id_col, text_col).select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
