"""Secret scans with multipart credential linking.

Base parts are found everywhere: assigned secrets, access identifiers, long hex runs. Weak
candidates are things that are harmless alone: short access identifiers, user names, long
mixed tokens and service endpoints. Parts of one text are sorted by place and joined by interval: a
weak candidate is reported only if a complementary part lies within the scope, a stretch of
``SCOPE`` code points inside the same text. The complement is another part: what overlaps the
candidate is none.

Linked kinds, each with what it needs in scope:

    endpoint   a URL or host:port         an assigned secret or access identifier
    user       an assigned user name      an assigned secret
    part       a short access identifier  an assigned secret or hex run
    key        a mixed 20+ letter token   an access identifier (of any length) or a user name

Scopes never cross texts, so the join is a sorted sweep beside the text itself and nothing is
shuffled. Edge cases: a null text is empty and has no spans; a text of any length is scanned
whole; repeated rows each get their spans; overlapping spans are all reported, but a weak span
never repeats the span of a base part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, field, picked, texts

# The three base patterns, a value's least length, and the order of kinds at one place (fixed values).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "endpoint", "user", "part", "key")

SCOPE = 200
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII | re.IGNORECASE)
_HOST = re.compile(r"\b[a-z0-9-]++(?:(?:\.[a-z0-9-]++)++(:[0-9]{2,5}\b)?)?", re.ASCII | re.IGNORECASE)
_PORT = re.compile(r":[0-9]{2}")
_USER = re.compile(r"\b(?:user(?:name)?|login|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{2,})", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")
NEEDS = {
    "endpoint": ("assign", "access"),
    "user": ("assign",),
    "part": ("assign", "hex"),
    "key": ("access", "part", "user"),
}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates of the whole text. A kind none of whose complements occurs in the text is not looked for."""
    have = {kind for kind, _, _ in base}
    found: list[Span] = []
    # user names and short identifiers are complements of keys
    for kind, places in (("user", _users), ("part", _parts), ("key", _keys), ("endpoint", _endpoints)):
        if kind in NEEDS["key"] or have.intersection(NEEDS[kind]):
            spotted = [(kind, *place) for place in places(text)]
            found += spotted
            have.update([kind] if spotted else [])
    taken = {(s, e) for _, s, e in base}
    inside = sorted(taken)
    return [w for w in found if (w[1], w[2]) not in taken and not _covered(w, inside)]


def _users(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _USER.finditer(text)]


def _parts(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text)]


def _keys(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _endpoints(text: str) -> list[tuple[int, int]]:
    """URLs and host:port, leftmost first and without overlaps; linear in the text, as a run of labels is read once."""
    found = [(*m.span(), 0) for m in _URL.finditer(text)] if "://" in text else []
    if _PORT.search(text):
        found += [(*m.span(), 1) for m in _HOST.finditer(text) if m[1]]
    kept, until = [], 0
    for start, end, _ in sorted(found, key=lambda f: (f[0], f[2])):
        if start >= until:
            kept.append((start, end))
            until = end
    return kept


def _covered(weak: Span, spans: list[tuple[int, int]]) -> bool:
    """Whether a base span that starts no later reaches the end of a weak one (base spans of a kind do not overlap)."""
    at = bisect_left(spans, (weak[1] + 1,))
    return any(e >= weak[2] for _, e in spans[max(0, at - len(BASE)) : at])


def linked(parts: list[Span], scope: int) -> list[Span]:
    """Weak parts with another part of a needed kind at most ``scope`` code points before or after: an interval join per kind.

    Spans of a kind do not overlap, so the nearest on either side are found by their starts and ends.
    """
    places: dict[str, tuple[list[int], list[int]]] = {}
    for kind, start, end in sorted(parts, key=lambda p: p[1]):
        starts, ends = places.setdefault(kind, ([], []))
        starts.append(start)
        ends.append(end)
    kept = []
    for kind, start, end in parts:
        for other in NEEDS.get(kind, ()):
            starts, ends = places.get(other, ([], []))
            after, before = bisect_left(starts, end), bisect_right(ends, start) - 1
            if after < len(starts) and starts[after] - end <= scope or before >= 0 and start - ends[before] <= scope:
                kept.append((kind, start, end))
                break
    return kept


def scan(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """(base spans, linked weak spans), each by start and kind; code points, end exclusive."""
    rank = KINDS.index
    base = sorted(base_spans(text), key=lambda s: (s[1], rank(s[0])))
    weak = linked(base + weak_spans(text, base), scope)
    return base, sorted(weak, key=lambda s: (s[1], rank(s[0]), s[2]))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(id, found)`` for every row; ``found`` is an array of (kind, start, end, linked) by start, then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())])

    def kernel(batches):
        for batch in batches:
            out = []
            for raw in texts(batch, "text"):
                base, weak = scan(raw.decode(), scope)
                rows = [(*s, False) for s in base] + [(*s, True) for s in weak]
                rows.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                out.append([dict(zip(("kind", "start", "end", "linked"), r)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["id", "found"])

    rows = picked(df, id=id_col, text=text_col)
    kind = T.ArrayType(T.StructType.fromDDL("kind string, start bigint, end bigint, linked boolean"))
    return arrow_map(rows, kernel, [field(rows, "id"), T.StructField("found", kind)])


def listed(found) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, found: list[Span], mark: str) -> str:
    """``text`` with every stretch covered by spans replaced by ``mark``."""
    out, at, until = [], 0, -1
    for _, start, end in sorted(found, key=lambda s: s[1]):
        if start > until:
            out += [text[at:start], mark]
        until = max(until, end)
        at = until
    return "".join(out) + text[at:]


def redacted(
    df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", scope: int = SCOPE, mark: str = "[SECRET]"
) -> DataFrame:
    """``df`` with found spans masked in its texts, every row and column kept; ``chars_col`` follows changed texts."""
    at = df.columns.index(text_col)
    names = [f"_{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)

    def kernel(batches):
        for batch in batches:
            out = []
            for value in batch.column(at).to_pylist():
                base, weak = scan(value or "", scope)
                out.append(masked(value, base + weak, mark) if base or weak else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "_new"])

    done = arrow_map(rows, kernel, [*rows.schema.fields, T.StructField("_new", T.StringType(), True)])
    columns = []
    for i, name in enumerate(df.columns):
        value = F.col(names[i])
        if i == at:
            value = F.coalesce("_new", value)
        elif name == chars_col:
            value = F.when(F.col("_new").isNull(), value).otherwise(F.length("_new").cast(df.schema[name].dataType))
        columns.append(value.alias(name))
    return done.select(*columns)

