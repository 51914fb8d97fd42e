"""Operator 4: license scans by fuzzy short-notice search.

A notice of m characters with up to k edits still holds one of its k + 1 pieces unchanged.  One automaton finds all pieces
in the normalised text; from each word that may begin the notice around a hit, the regex library's bounded-error matching decides, and
gives the span and the edits.  Spans begin and end with whole words of the text.  Of overlapping spans of one notice the one with the
fewest edits stays, of equal ones the first.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barspark.llm import textarrays as ta

#: Base phrases and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices in normalised form (lower case, words with one space between) and the labels that they show.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
    "without warranty of any kind": "no-warranty",
}
#: Edits allowed: one for so many characters of a notice, at most so many.
CHARACTERS_PER_EDIT, MOST_EDITS = 9, 4

_WORD_GAP = np.ones(256, bool)
_WORD_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def edits_allowed(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARACTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than the edits allowed, with their places."""
    n = edits_allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    def __init__(self, notices: dict[str, str]):
        import ahocorasick
        import regex

        self.notices, self.automaton = list(notices.items()), ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _) in enumerate(self.notices):
            for at, piece in pieces(notice):
                by_piece.setdefault(piece, []).append((i, at))
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        # the words' end stands outside the fuzzy group, so edits do not reach into another word
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_allowed(n)}}}(?![^ ])") for n, _ in self.notices]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in one normalised text."""
        found: list[tuple[int, int, int, int]] = []
        tried: set[tuple[int, int]] = set()
        for last, (length, places) in self.automaton.iter(text):
            for i, at in places:
                size, room = len(self.notices[i][0]), edits_allowed(self.notices[i][0])
                place = last + 1 - length - at
                # the notice begins with a word, at most ``room`` characters from where it would without edits
                begin = 0 if place <= room else text.find(" ", place - room - 1) + 1
                while (begin or place <= room) and begin <= place + room:
                    if (i, begin) not in tried:
                        tried.add((i, begin))
                        # one character more than a match can take: so the border is seen in the text, not at the window's end
                        m = self.patterns[i].match(text, begin, min(len(text), begin + size + room + 1))
                        if m:
                            found.append((sum(m.fuzzy_counts), begin, m.end(), i))
                    begin = text.find(" ", begin) + 1
                    if not begin:
                        break
        kept: list[list[tuple[int, int, int]]] = [[] for _ in self.notices]
        for edits, start, end, i in sorted(found):
            at = bisect.bisect(kept[i], (start,))
            if (not at or kept[i][at - 1][1] <= start) and (at == len(kept[i]) or end <= kept[i][at][0]):
                kept[i].insert(at, (start, end, edits))
        return [(i, *x) for i, own in enumerate(kept) for x in own]


_searches: dict[tuple, Search] = {}
_FOUND = "array<struct<label: string, first_word: bigint, last_word: bigint, edits: bigint, exact: boolean>>"


def scan_licenses(df: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and fuzzy notices of every whole text, in words.

    Returns ``id_col, n_words, base`` (places of the exact phrases: label and first and last word) and ``fuzzy`` (notices found within
    their edits, with the edits).  Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
    A null or empty text has no words and no places; repeated rows are scanned once each; other columns are left out.
    A narrow pass over the scan's partitions, no shuffle.
    """
    notices, phrases = notices or NOTICES, phrases or PHRASES
    rarest = {p: max(p.split(), key=len).encode() for p in phrases}
    exact = {p: re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])") for p in phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(notices.items())
        search = _searches.get(key) or _searches.setdefault(key, Search(notices))
        shape = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("exact", pa.bool_())]))
        for rows, data, offsets in ta.text_blocks(batches):
            data = ta.LOWER[data]
            start, _, at = ta.words(data, offsets, _WORD_GAP)
            # normalised: the words' bytes, each word followed by one blank
            word = ~_WORD_GAP[data]
            gap = np.zeros(len(data) + 1, bool)  # the blank stands where the word ended
            gap[1:] = word
            edge = np.zeros(len(data) + 1, bool)
            edge[start] = True
            size = np.append(word, False) + (gap & (~np.append(word, False) | edge)).astype(np.int64)
            to = np.append(0, np.cumsum(size))
            clean = np.full(to[-1], 0x20, np.uint8)
            inside = np.flatnonzero(word)
            clean[to[inside + 1] - 1] = data[inside]
            begin = to[start] + (size[start] - 1)
            clean_at = np.append(begin, len(clean))[at] if len(start) else np.zeros(rows.num_rows + 1, np.int64)
            flat, cuts = clean.tobytes(), clean_at.tolist()
            base, fuzzy = [], []
            for d in range(rows.num_rows):
                text = flat[cuts[d] : cuts[d + 1]].rstrip(b" ")
                index = lambda place, d=d: int(np.searchsorted(begin, cuts[d] + place, "right")) - 1 - int(at[d])
                own = []
                for phrase, label in phrases.items():
                    if rarest[phrase] in text:
                        for m in exact[phrase].finditer(text):
                            own.append({"label": label, "first_word": index(m.start()), "last_word": index(m.end() - 1), "edits": 0, "exact": True})
                base.append(own)
                found = search.find(text.decode("latin-1"))
                fuzzy.append([{"label": search.notices[i][1], "first_word": index(s), "last_word": index(e - 1), "edits": n, "exact": n == 0} for i, s, e, n in found])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(base, shape), pa.array(fuzzy, shape)], ["id", "n_words", "base", "fuzzy"])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, n_words long, base {_FOUND}, fuzzy {_FOUND}", id_col, text_col).withColumnRenamed("id", id_col)
