"""Vectorised pre-tokenisation and a cache of distinct pre-tokens, for the two BPE operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from barspark.llm import textarrays as ta

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Characters with the Unicode property White_Space: fixed values.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Class and random code of each code point; made once in a worker."""
    if not _tables:
        kind = np.frombuffer(bytes({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8).copy()
        kind[list(WHITE_SPACE)] = BLANK
        code = np.random.default_rng(7).integers(1, 2**63, 0x110000, dtype=np.uint64)
        _tables[:] = [kind, code]
    return _tables


def starts(points: np.ndarray, offsets: np.ndarray, absorb: bool) -> np.ndarray:
    """Mask of the characters that begin a pre-token; with the class of each character.

    absorb: a single space goes with the run that follows it and digits stay together (byte-level rank files);
    otherwise blanks stand alone, to be dropped, and each number character is its own pre-token.
    """
    kind = tables()[0][points]
    n = len(points)
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin |= edge[:-1]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    of = kind[run]
    joined = np.append(~edge[run[1:]], False) if len(run) else np.zeros(0, bool)  # the next run is in the same document
    nxt = np.append(of[1:], BLANK) if len(run) else of
    taken = np.zeros(len(run), bool)  # the run begins with the blank before it
    if absorb:
        led = np.flatnonzero((of == BLANK) & joined)
        last = end[led] - 1
        begin[last] = True
        single = points[last] == 0x20
        begin[end[led][single]] = False
        taken[led[single] + 1] = True
    elif n:
        begin |= kind == NUMBER
    quote = np.flatnonzero((of == OTHER) & (end - run == 1) & joined & (nxt == LETTER) & ~taken)
    quote = quote[points[run[quote]] == 0x27]
    if len(quote):
        first, long = end[quote], end[quote + 1] - end[quote] > 1
        a, b = points[first], np.where(long, points[np.minimum(first + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = long & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for chosen, width in ((one, 1), (two, 2)):
            at = first[chosen]
            begin[at] = False
            rest = at + width
            begin[rest[rest < end[quote[chosen] + 1]]] = True
    return begin, kind


def decode_block(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The block as a string, its code points, and the documents' offsets in code points."""
    text = data.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(data):
        return text, points, offsets
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ta.NOT_CONTINUATION[data], out=counts[1:])
    return text, points, counts[offsets]


class Known:
    """Distinct pre-tokens seen by this worker, found by hash and compared in full.

    At ``most`` of them, or at ``most_points`` characters in all, it starts anew, so memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int, most_points: int = 1 << 24):
        self.learn, self.forget, self.most, self.most_points = learn, forget, most, most_points
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places, self.points = np.zeros(0, np.uint64), np.zeros(0, np.int64), Ragged()
        self.forget()

    def _add(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Learns pre-tokens in sorted order; their places."""
        fresh = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        order = np.array(sorted(range(len(fresh)), key=fresh.__getitem__), np.int64)
        self.learn([fresh[i] for i in order])
        places = np.empty(len(fresh), np.int64)
        places[order] = self.points.n + np.arange(len(fresh))
        self.points.extend(points[ta.ragged(start[order], (end - start)[order])], (end - start)[order])
        return places

    def index(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each pre-token among those learned."""
        if not len(start):
            return np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(self.hash(points, start, end), return_index=True, return_inverse=True)
        if self.points.n > self.most or self.points.used > self.most_points:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        places = np.empty(len(distinct), np.int64)
        places[found] = self.places[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            places[new] = self._add(text, points, start[first[new]], end[first[new]])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.places = np.insert(self.places, at[new], places[new])
        places = places[inverse]
        other = self.differ(places, points, start, end)
        if len(other):  # equal hashes, unequal characters: these are learned for this block only
            own = {text[a:b]: i for i, a, b in zip(other.tolist(), start[other].tolist(), end[other].tolist(), strict=True)}
            chosen = np.array(list(own.values()), np.int64)
            place_of = dict(zip(own, self._add(text, points, start[chosen], end[chosen]).tolist(), strict=True))
            places[other] = [place_of[text[a:b]] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)]
        return places

    def hash(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return ta.span_hashes(tables()[1], points, start, end)

    def differ(self, places: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pre-tokens are not, character by character, those at their places."""
        length = end - start
        wrong = self.points.length[places] != length
        for a, b in ta.slices(length):
            own = np.where(wrong[a:b], 0, length[a:b])
            unlike = points[ta.ragged(start[a:b], own)] != self.points.flat[ta.ragged(self.points.start[places[a:b]], own)]
            if unlike.any():
                wrong[a + np.repeat(np.arange(b - a), own)[unlike]] = True
        return np.flatnonzero(wrong)


class Ragged:
    """A growing list of integer sequences."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + len(lengths) > len(self.start):
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        self.flat[self.used : self.used + len(values)] = values
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(values), self.n + len(lengths)
