"""Operator 5: language identification with a string kernel.

The kernel of two texts is the cosine of their n-gram presence sets, lengths 1 to 3 blended.  A bounded sample of labelled texts
is mapped by Nystroem landmarks, and one-versus-rest kernel ridge regression is solved on it; a text is scored by multiplying
blocks of presence rows with the landmarks' presence matrix and then with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import textarrays as ta
from barspark.llm.buckets import few
from barspark.llm.storage import stored

# letters a to z in one case, one sign each for blanks, digits and other ASCII, and the bytes of other characters
_SIGN = np.full(256, 28, np.int64)
_SIGN[97:123] = _SIGN[65:91] = np.arange(26)
_SIGN[[0x20, *range(9, 14)]] = 26
_SIGN[48:58] = 27
_SIGN[128:] = 29 + np.arange(128)
_SIGNS = 157
CODES = _SIGNS + _SIGNS**2 + _SIGNS**3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
BLOCK = 64


class Presence:
    """Distinct n-grams of one text after another, without sorting: of equal codes only the one written last finds itself."""

    def __init__(self):
        self.stamp = np.zeros(CODES, np.int32)

    def of(self, signs: np.ndarray) -> np.ndarray:
        parts = [signs]
        if len(signs) > 1:
            parts.append(_SIGNS + signs[:-1] * _SIGNS + signs[1:])
        if len(signs) > 2:
            parts.append(_SIGNS + _SIGNS**2 + (signs[:-2] * _SIGNS + signs[1:-1]) * _SIGNS + signs[2:])
        codes = np.concatenate(parts)
        places = np.arange(len(codes), dtype=np.int32)
        self.stamp[codes] = places
        return codes[self.stamp[codes] == places]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    place: np.ndarray  # of each code among the landmarks' codes, or -1
    landmarks: np.ndarray  # presence, codes by landmarks
    norms: np.ndarray  # square roots of the landmarks' set sizes
    weights: np.ndarray  # landmarks by languages
    shift: np.ndarray

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        block = np.zeros((len(rows), self.landmarks.shape[0]), np.float32)
        for i, codes in enumerate(rows):
            own = self.place[codes]
            block[i, own[own >= 0]] = 1
        sizes = np.sqrt([max(1, len(x)) for x in rows])
        return (block @ self.landmarks).astype(np.float64) / self.norms / sizes[:, None]

    def decide(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.kernel(rows) @ self.weights + self.shift


def solve(codes: list[np.ndarray], labels: list[str], n_landmarks: int, ridge: float) -> Model:
    """Fits the model on a sample in which every language's texts come in the order in which they may be landmarks."""
    languages = sorted(set(labels))
    each = max(1, n_landmarks // len(languages))
    own: dict[str, list[int]] = {}
    for j, y in enumerate(labels):
        own.setdefault(y, []).append(j)
    spread = languages if len(languages) <= n_landmarks else [languages[k * len(languages) // n_landmarks] for k in range(n_landmarks)]
    chosen = [i for x in spread for i in own[x][:each]]
    known = np.unique(np.concatenate([codes[i] for i in chosen]))
    place = np.full(CODES, -1, np.int32)
    place[known] = np.arange(len(known))
    landmarks = np.zeros((len(known), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        landmarks[place[codes[i]], j] = 1
    norms = np.sqrt([max(1, len(codes[i])) for i in chosen])
    model = Model(languages, place, landmarks, norms, np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    among = model.kernel([codes[i] for i in chosen])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([model.kernel(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)]) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    share = 1 / np.bincount([languages.index(x) for x in labels])[[languages.index(x) for x in labels]]  # languages weigh the same
    share /= share.sum()
    middle, level = share @ mapped, share @ target
    z, y = mapped - middle, target - level
    inner = np.linalg.solve((z * share[:, None]).T @ z + ridge * np.eye(z.shape[1]), (z * share[:, None]).T @ y)
    return Model(languages, place, landmarks, norms, root @ inner, level - middle @ inner)


def fit(df: DataFrame, per_language: int = 400, n_landmarks: int = 160, ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = 200) -> Model | None:
    """Learns from about ``per_language`` labelled texts of each language, chosen by a hash of the id over the whole table.

    Rows without text or label are left out; None if no row is left.  Only the sample's n-gram sets reach the driver: their
    number is about ``per_language * most_languages`` at most, and each is bounded by the alphabet.  Of more languages than that, each has a
    smaller part of the sample, one text at least, and landmarks come from ``n_landmarks`` of them; all are learned.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    each = per_language if languages <= most_languages else max(1, per_language * most_languages // languages)
    order = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    if languages <= most_languages:
        share = F.create_map(*[F.lit(v) for r in counts.collect() for v in (r["lang"], min(1.0, each / r["n"]))])[F.col("lang")]
        sample = rows.withColumn("order", order).filter(F.pmod("order", F.lit(1_000_003)) < share * 1_000_003)
    else:  # a rare language's first text by hash is always there
        keyed = rows.join(few(counts), "lang").withColumn("order", order)
        firsts = stored(keyed.groupBy("lang").agg(F.min("order").alias("first")), "languages")
        taken = (F.pmod("order", F.lit(1_000_003)) < F.least(F.lit(1.0), each / F.col("n")) * 1_000_003) | (F.col("order") == F.col("first"))
        sample = keyed.join(few(firsts), "lang").filter(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Presence()
        for part, data, offsets in ta.text_blocks(batches, 1):
            signs = _SIGN[data]
            codes = [own.of(signs[a:b]).astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tolist() for x in codes], pa.list_(pa.int32()))], ["order", "lang", "codes"])

    got = sample.select("order", "text", "lang").mapInArrow(run, "order long, lang string, codes array<int>").collect()
    got = sorted((r for r in got if r["codes"]), key=lambda r: (r["order"], r["lang"], len(r["codes"])))
    return solve([np.array(r["codes"], np.int64) for r in got], [r["lang"] for r in got], n_landmarks, ridge) if got else None


_presence: list[Presence] = []


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every whole text; the score (0 to 1) is the winner's share after a softmax of the decisions.

    ``und`` with score 0 for a null text, one without a letter, or without a model.  Ties go to the first language by name.
    Repeated rows are scored once each; other columns are left out, labels among them.  A narrow pass, no shuffle; the model is
    broadcast and its size is bounded by its landmarks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if not _presence:
            _presence.append(Presence())
        for rows, data, offsets in ta.text_blocks(batches):
            letters = ta.per_document(_LETTER[data], offsets)
            n = rows.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            for d in np.flatnonzero(letters == 0):
                letters[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
            real = np.flatnonzero(letters > 0) if own else np.zeros(0, np.int64)
            signs = _SIGN[data]
            for i in range(0, len(real), BLOCK):
                some = real[i : i + BLOCK]
                decisions = own.decide([_presence[0].of(signs[offsets[d] : offsets[d + 1]]) for d in some])
                best = decisions.argmax(axis=1)
                odds = np.exp(4 * (decisions - decisions.max(axis=1, keepdims=True)))
                scores[some] = 1 / odds.sum(axis=1)
                for d, b in zip(some.tolist(), best.tolist(), strict=True):
                    names[d] = own.languages[b]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, lang_pred string, score double", id_col, text_col).withColumnRenamed("id", id_col)
