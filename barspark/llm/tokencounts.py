"""Operator 10: token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a block lie one after another in one symbol array.  A round looks up the rank of every adjacent
pair, takes the lowest in each sequence, and joins all its places at once; sequences without a known pair leave.
What is left in a sequence at the end is its count.  In a long sequence, a round joins every pair that is the lowest within the reach of a
token on either side: nothing farther away can change what stands beside it before it is joined.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barspark.llm import pretokens, textarrays as ta

_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBPE:
    """A BPE vocabulary with word ends over byte symbols, as the tokenizers library stores it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model, symbols = stored["model"], byte_symbols()
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + suffix] for s in symbols], np.int64)
        self.size = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys, rank = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, rank, made[rank]
        special = [x["content"] for x in stored["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.specials = special
        #: The longest token in bytes, rounded up to a power of two: as far as one merge can reach.
        self.reach = 1 << (max(len(x.removesuffix(suffix)) for x in vocabulary) - 1).bit_length()
        self.known = pretokens.Known(self.learn, self.forget, 1_000_000)

    def forget(self) -> None:
        self.counts = pretokens.Ragged()

    def learn(self, pieces: list[str]) -> None:
        raw = [x.encode() for x in pieces]
        lengths = np.array([len(x) for x in raw], np.int64)
        counts, long = np.zeros(len(raw), np.int32), lengths > 4 * self.reach
        for chosen in (np.flatnonzero(~long), np.flatnonzero(long)):
            for a, b in ta.slices(lengths[chosen]):
                own = chosen[a:b]
                counts[own] = self.count([raw[i] for i in own], self.reach if long[own[0]] else None)
        self.counts.extend(np.zeros(0, np.int32), counts)

    def count(self, pieces: list[bytes], reach: int | None = None) -> np.ndarray:
        """Symbols that survive in each piece (none is empty); with ``reach``, all the lowest pairs within it are joined in a round."""
        lengths = np.array([len(x) for x in pieces], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = self.first[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out = lengths.copy()
        while len(symbol) > 1:
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.rank[at], _NONE), _NONE)
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(head, len(owner)))
            lowest = np.minimum.reduceat(rank, head)
            level = np.repeat(lowest, sizes) if reach is None else _least_around(rank, reach)
            chosen = (rank == level) & (rank != _NONE)
            place = np.flatnonzero(chosen)
            if not len(place):
                break
            run = np.flatnonzero(np.append(True, np.diff(place) != 1))  # in "aaa" every second place of a run is joined
            place = place[(np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % 2 == 0]
            symbol[place] = self.made[at[place]]
            out -= np.bincount(owner[place], minlength=len(out))
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            keep &= np.repeat(lowest != _NONE, sizes)  # the others have ended
            symbol, owner = symbol[keep], owner[keep]
        return out.astype(np.int32)


def _least_around(values: np.ndarray, reach: int) -> np.ndarray:
    """The least value at most ``reach`` (a power of two) places away, by doubling."""
    behind, ahead, step = values.copy(), values.copy(), 1
    while step <= reach:
        behind[step:] = np.minimum(behind[step:], behind[:-step].copy())
        ahead[:-step] = np.minimum(ahead[:-step], ahead[step:].copy())
        step *= 2
    return np.minimum(behind, ahead)


def normalize(text: str) -> str:
    """NFC, then each letter's own lower case (no rule for a sigma at a word's end)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_workers: dict[str, WordBPE] = {}


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every whole text by the vocabulary file: ``id_col, n_bytes, n_tokens, over_limit``.

    Special strings inside a text count as one token each.  A null or empty text has 0 bytes and tokens; repeated rows
    are counted once each; other columns are left out.  A narrow pass over the scan's partitions, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _workers.get(vocabulary) or _workers.setdefault(vocabulary, WordBPE(vocabulary))
        for rows, data, offsets in ta.text_blocks(batches):
            raw = data.tobytes()
            parts, of_part, special = [], [], np.zeros(rows.num_rows, np.int64)
            cuts = offsets.tolist()
            for d in range(rows.num_rows):
                text = raw[cuts[d] : cuts[d + 1]].decode("utf-8", "surrogatepass")
                if any(x in text for x in own.specials):
                    pieces = own.special.split(text)
                    special[d] = len(pieces) - 1
                else:
                    pieces = [text]
                for piece in pieces:
                    parts.append(piece if piece.isascii() else normalize(piece))
                    of_part.append(d)
            joined = "".join(parts)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            upper = (points >= 65) & (points <= 90)
            if upper.any():
                points = np.where(upper, points + 32, points).astype(np.uint32)
                joined = points.tobytes().decode("utf-32-le", "surrogatepass")
            at = np.append(0, np.cumsum([len(x) for x in parts]))
            begin, kind = pretokens.starts(points, at, absorb=False)
            start = np.flatnonzero(begin)
            end = np.append(start[1:], len(points))[: len(start)]
            real = kind[start] != pretokens.BLANK
            start, end = start[real], end[real]
            place = own.known.index(joined, points, start, end)
            by_part = ta.per_document(own.counts.length[place], np.searchsorted(start, at))
            total = special + np.bincount(of_part, by_part, rows.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col).withColumnRenamed("id", id_col)
