"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a pre-token exactly one last token is valid: the one that, after the last token of the
shorter prefix, leaves a pair that no earlier merge would have joined across their border.  The table of these last
tokens is all the state there is, so appending bytes goes on from the end of the table (:meth:`ByteBPE.extend`)
and an edit redoes the table from the edit on.  Distinct pre-tokens of a block are encoded in sorted order, each
going on from the table of the prefix it shares with the one before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barspark.llm import pretokens, textarrays as ta

_FOREVER = 1 << 60


class ByteBPE:
    """The ranks of a vocabulary file whose ids are its merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for b in ranks:
            lengths.setdefault(b[-3:], set()).add(len(b))
        #: By the last three bytes of a prefix, the lengths of tokens that end so, the longest first; 2 and 1 are always tried.
        self.lengths = {b: tuple(sorted(n - {1, 2}, reverse=True)) + (2, 1) for b, n in lengths.items() if len(b) == 3}
        self._whole: dict[int, tuple[int, int] | None] = {}
        self._borders: dict[int, bool] = {}
        size = max(self.bytes_of) + 1
        self.width = np.zeros(size, np.int64)
        for i, b in self.bytes_of.items():
            self.width[i] = len(b)
        self.begin = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.size = size

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})

    def merge(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Plain merging, lowest rank first, leftmost of equals; and the pair that was joined last."""
        parts, last = [piece[i : i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, _FOREVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _FOREVER:
                break
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [last[0] + last[1]]
        return parts, last

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; (-1, -1) for a single byte, None if merging never yields it."""
        if token not in self._whole:
            piece = self.bytes_of[token]
            parts, last = self.merge(piece)
            self._whole[token] = None if len(parts) > 1 else (self.ranks[last[0]], self.ranks[last[1]]) if last else (-1, -1)
        return self._whole[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        Goes back in time: x and y are the symbols on either side of the border, ``x_until`` and ``y_until`` the ranks of the
        merges that took them up.  The border falls if joining x and y came before both (at equal rank, the left pair goes first).
        """
        x, y, x_until, y_until = left, right, _FOREVER, _FOREVER
        while True:
            joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if joined is not None and joined < x_until and joined <= y_until:
                return False
            a, b = self.halves(x), self.halves(y)
            made_x, made_y = (x if a[0] >= 0 else -1), (y if b[0] >= 0 else -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                x, x_until = a[1], made_x
            else:
                y, y_until = b[0], made_y

    def extend(self, piece: bytes, last: list[int], known: int) -> None:
        """Fills last[known + 1:], where last[p] is the last token of the first p bytes; earlier entries hold for this piece."""
        ranks, borders, size, lengths = self.ranks.get, self._borders, self.size, self.lengths.get
        del last[known + 1 :]
        for p in range(known + 1, len(piece) + 1):
            for length in lengths(piece[p - 3 : p], (2, 1)) if p >= 3 else (2, 1):
                s = p - length
                if s < 0:
                    continue
                token = ranks(piece[s:p])
                if token is None:
                    continue
                key = last[s] * size + token
                fits = borders.get(key)
                if fits is None:
                    if len(borders) > 2_000_000:
                        borders.clear()
                    fits = borders[key] = self.halves(token) is not None and (s == 0 or self.apart(last[s], token))
                if fits:
                    last.append(token)
                    break

    def read(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of the whole piece, read back from its table."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        out, p = [], len(piece)
        while p:
            out.append(last[p])
            p -= len(self.bytes_of[last[p]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(piece, last, 0)
        return self.read(piece, last)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        last, before = [-1], b""
        for piece in pieces:
            shared = 0
            for a, b in zip(piece, before, strict=False):
                if a != b:
                    break
                shared += 1
            self.extend(piece, last, shared)
            yield self.read(piece, last)
            before = piece

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[ta.ragged(self.begin[ids], self.width[ids])]


class Editable:
    """One pre-token that is edited in place: the table up to the edit stays."""

    def __init__(self, bpe: ByteBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", [-1]
        self.replace(0, 0, piece)

    def replace(self, start: int, end: int, new: bytes) -> list[int]:
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.bpe.extend(self.piece, self.last, start)
        return self.bpe.read(self.piece, self.last)

    def append(self, new: bytes) -> list[int]:
        return self.replace(len(self.piece), len(self.piece), new)


class _Worker:
    def __init__(self, path: str):
        self.bpe = ByteBPE.from_file(path)
        self.known = pretokens.Known(self.learn, self.forget, 1_000_000)

    def forget(self) -> None:
        self.ids = pretokens.Ragged()

    def learn(self, pieces: list[str]) -> None:
        coded = list(self.bpe.encode_sorted([x.encode("utf-8", "surrogatepass") for x in pieces]))
        self.ids.extend(np.array([i for x in coded for i in x], np.int32), np.array([len(x) for x in coded], np.int32))


_workers: dict[str, _Worker] = {}


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text by the rank file and decodes the ids again: ``id_col, ids array<int>, decoded binary``.

    A null or empty text has no ids; repeated rows are coded once each; an empty table gives an empty one; other columns
    of ``df`` are left out, whatever they are called.  No shuffle: a narrow pass over the scan's partitions, with a bounded
    cache of distinct pre-tokens in each worker that a lost executor does not need back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _workers.get(vocabulary) or _workers.setdefault(vocabulary, _Worker(vocabulary))
        for rows, data, offsets in ta.text_blocks(batches):
            text, points, at = pretokens.decode_block(data, offsets)
            begin, _ = pretokens.starts(points, at, absorb=True)
            start = np.flatnonzero(begin)
            end = np.append(start[1:], len(points))[: len(start)]
            place = own.known.index(text, points, start, end)
            lengths = own.ids.length[place].astype(np.int64)
            ids = own.ids.flat[ta.ragged(own.ids.start[place], lengths)]
            ids_at = np.append(0, np.cumsum(lengths))[np.searchsorted(start, at)]
            bytes_at = np.append(0, np.cumsum(own.bpe.width[ids]))[ids_at]
            decoded = own.bpe.decode(ids)
            out = [
                rows.column(0),
                pa.ListArray.from_arrays(pa.array(ids_at, pa.int32()), pa.array(ids, pa.int32())),
                pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(decoded)]),
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, ids array<int>, decoded binary", id_col, text_col).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Turns arrays of ids back into text: ``id_col, text``.  A null array gives a null text.

    Bytes that are not UTF-8 (a character cut by the end of the ids) become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _workers.get(vocabulary) or _workers.setdefault(vocabulary, _Worker(vocabulary))
        for rows in batches:
            texts = [None if x is None else own.bpe.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
