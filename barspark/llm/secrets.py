"""Operator 6: secret scans.

Base kinds are exact patterns.  The method adds ``entropy`` spans: over long runs of token characters, a window slides
with incrementally kept counts; where the Shannon entropy of its characters reaches the limit of its character class, and
the window touches nothing that the allow-list explains, it is flagged; the flagged windows' union is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barspark.llm import textarrays as ta

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(rb"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Parts of a run that look random but are not secrets: fixed values.
ALLOWED = (
    re.compile(rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),  # UUID
    re.compile(rb"(?i)example|sample|placeholder|changeme|dummy|your[_-]|xxxx|lorem|abcdef|012345|123456"),
    re.compile(rb"(?<![0-9A-Za-z])(?:19|20)[0-9]{2}(-?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z])"),  # dates, never inside a key
)
#: What stands just before a run, and the part at the run's start that it explains: host names, digests, data URLs.
ALLOWED_BEFORE = (
    (re.compile(rb"(?i)www\.$"), re.compile(rb"[A-Za-z0-9-]+")),
    (re.compile(rb"(?i)(?:sha\d*|md5)[: ]$"), re.compile(rb"[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])|[A-Za-z0-9+/]{22,86}={0,2}(?![A-Za-z0-9+/])")),
    (re.compile(rb"(?i)base64,$"), re.compile(rb"[A-Za-z0-9+/=]+")),
)


@dataclass(frozen=True)
class CharacterClass:
    """Windows of ``window`` characters of this class with ``least_bits`` of entropy are flagged if all of ``needs`` occur in them."""

    name: str
    members: re.Pattern
    window: int
    least_bits: float
    needs: tuple[frozenset[int], ...]


_DIGITS, _UPPER, _LOWER, _HEX_LETTERS = (frozenset(x) for x in (b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"abcdefABCDEF"))
CLASSES = (
    CharacterClass("hex", re.compile(rb"[0-9A-Fa-f]{20,}"), 20, 3.0, (_DIGITS, _HEX_LETTERS)),
    CharacterClass("base36", re.compile(rb"[0-9a-z]{20,}"), 20, 3.4, (_DIGITS, _LOWER)),
    CharacterClass("base32", re.compile(rb"[0-9A-Z]{20,}"), 20, 3.4, (_DIGITS, _UPPER)),
    CharacterClass("base64", re.compile(rb"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7, (_DIGITS, _UPPER, _LOWER)),
)
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_SHORTEST = min(c.window for c in CLASSES)


@dataclass
class _Window:
    """Counts of a sliding window, and the sum of n * log2 n over them, changed by one character at a time."""

    size: int
    counts: dict[int, int] = field(default_factory=dict)
    weight: float = 0.0

    def change(self, character: int, by: int) -> None:
        n = self.counts.get(character, 0)
        self.counts[character] = n + by
        self.weight += _NLOG[n + by] - _NLOG[n]

    def bits(self) -> float:
        return math.log2(self.size) - self.weight / self.size


_NLOG = [0.0] + [n * math.log2(n) for n in range(1, 257)]


def allowed_spans(text: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a run that the allow-list explains, by places in the run."""
    own, before = text[start:end], text[max(0, start - 12) : start]
    found = [m.span() for a in ALLOWED for m in a.finditer(own)]
    return found + [m.span() for b, a in ALLOWED_BEFORE if b.search(before) and (m := a.match(own))]


def entropy_spans(text: bytes, classes: tuple[CharacterClass, ...] = CLASSES, allowed: list[tuple[int, int]] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Unions of the flagged windows of a candidate string, all classes together; a window that touches an allowed span is not flagged."""
    flagged: list[tuple[int, int]] = []
    for c in classes:
        for run in c.members.finditer(text):
            window, own = _Window(c.window), text[run.start() : run.end()]
            missing = [sum(x in need for x in own[: c.window]) for need in c.needs]
            for x in own[: c.window]:
                window.change(x, 1)
            for i in range(len(own) - c.window + 1):
                if i:
                    old, new = own[i - 1], own[i + c.window - 1]
                    window.change(old, -1)
                    window.change(new, 1)
                    missing = [n - (old in need) + (new in need) for n, need in zip(missing, c.needs, strict=True)]
                if window.bits() >= c.least_bits and all(missing):
                    flagged.append((run.start() + i, run.start() + i + c.window))
    if flagged and allowed:
        step = np.zeros(len(text) + 1, np.int64)
        for s, e in allowed:
            step[s] += 1
            step[e] -= 1
        inside = np.append(0, np.cumsum(np.cumsum(step) > 0))
        flagged = [(s, e) for s, e in flagged if inside[s] == inside[e]]
    out: list[tuple[int, int]] = []
    for s, e in sorted(flagged):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that lie in none of the others, which are sorted."""
    for s, e in spans:
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def spans_of(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans of one UTF-8 text, by start and then kind, in bytes.  runs: its maximal runs of token characters of 20 or more."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for start, end in runs:
        found += [("hex", start + m.start(), start + m.end()) for m in HEX.finditer(text[start:end]) if m.end() - m.start() >= LEAST_HEX]
    base = sorted((x, y) for _, x, y in found)
    for start, end in runs:
        for s, e in entropy_spans(text[start:end], allowed=allowed_spans(text, start, end)):
            found += [("entropy", x, y) for x, y in outside(s + start, e + start, base) if text[x:y].strip(b"+/_=-")]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _found(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, list[tuple[str, int, int]]]]:
    start, end, at = ta.words(data, offsets, ~_TOKEN)
    long = np.flatnonzero(end - start >= _SHORTEST)
    own = np.searchsorted(long, at)
    raw, cuts, start, end = data.tobytes(), offsets.tolist(), start[long], end[long]
    for d in range(len(cuts) - 1):
        runs = [(int(start[i]) - cuts[d], int(end[i]) - cuts[d]) for i in range(own[d], own[d + 1])]
        text = raw[cuts[d] : cuts[d + 1]]
        yield text, spans_of(text, runs)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: ``id_col, spans array<struct<kind, start, end>>`` in code points, the end exclusive.

    Base spans of different kinds may overlap; an ``entropy`` span overlaps no base span.  A null or empty text has none;
    repeated rows are scanned once each; other columns are left out.  A narrow pass over the scan's partitions, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ta.text_blocks(batches):
            points = np.append(0, np.cumsum(ta.NOT_CONTINUATION[data]))
            out = []
            for d, (_, spans) in enumerate(_found(data, offsets)):
                first = offsets[d]
                out.append([{"kind": k, "start": int(points[first + s] - points[first]), "end": int(points[first + e] - points[first])} for k, s, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, kind)], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, spans {_SPANS}", id_col, text_col).withColumnRenamed("id", id_col)


def redact(df: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with each secret's span in the text replaced by ``mark``; overlapping spans become one.

    A text without secrets, and a null one, stays as it is.
    """
    place = df.columns.index(text_col)
    written = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ta.text_blocks(batches, place):
            texts, changed = [], False
            for text, spans in _found(data, offsets):
                parts, at = [], 0
                for _, s, e in sorted(spans, key=lambda x: x[1]):
                    if s >= at:
                        parts += [text[at:s], written]
                    at = max(at, e)
                changed = changed or bool(spans)
                texts.append((b"".join(parts) + text[at:]).decode("utf-8", "surrogatepass"))
            if changed:
                null = rows.column(place).is_null().to_pylist()
                column = pa.array([None if n else t for n, t in zip(null, texts, strict=True)], pa.string())
                arrays = [column if i == place else rows.column(i) for i in range(rows.num_columns)]
                rows = pa.RecordBatch.from_arrays(arrays, names=rows.schema.names)
            yield rows

    return df.mapInArrow(run, df.schema)
