"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams (1 to ``grams`` letters, words padded by spaces, in
lower case) that both have, over the geometric mean of the numbers that each has: the normalised blended-spectrum
presence kernel.  n-grams are hashed to ``2**BITS`` places.  A bounded, balanced sample of labelled texts gives the
landmarks of a Nyström map and the rows of one-versus-rest kernel ridge regression on it.  A text's values are the
product of its kernel row with the dual weights.  As the kernel row is itself a product of the text's presence row with
the landmarks' presence matrix, the two constant matrices are multiplied once, and whole batches of presence rows are
scored with one matrix product each.  There is no intercept, so the choice does not depend on a text's length.

Bounds: ``per_language`` sampled texts of each language and ``sample_rows`` in all, by a hash of the id; of these
``landmarks`` are landmarks.  What reaches the driver is a bit row of ``2**BITS / 8`` bytes for each sampled text.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if no row is labelled.
Ties between languages go to the smaller.  A null doc_id counts as an empty one in the split.  Repeated rows are judged
alike; an empty table gives an empty result.  Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
#: Long texts are read in pieces of so many characters.
PIECE = 1 << 20
BATCH = 32
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Presence:
    """Which hashed n-grams a text has; one scratch row for all texts of a task."""

    def __init__(self, grams: int) -> None:
        self.grams = grams
        self.row = np.zeros(1 << BITS, bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted places of the n-grams; empty if the text has no letter."""
        any_letter = False
        for at in range(0, len(text), PIECE):
            # A piece starts with the end of the one before, for the n-grams between them.
            piece = text[max(0, at - self.grams + 1) : at + PIECE].lower()
            piece = " " * (at == 0) + piece + " " * (at + PIECE >= len(text))
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            letter = letters()[points]
            any_letter = any_letter or bool(letter.any())
            points[~letter] = 32
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] = True
            points = points[keep]
            hashed = np.zeros(len(points), np.uint32)
            for n in range(1, self.grams + 1):
                # hashed[i]: of the n points from i on.
                hashed = (hashed[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1)
                hashed ^= hashed >> np.uint32(15)
                self.row[(hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
        places = np.flatnonzero(self.row).astype(np.int32)
        self.row[places] = False
        return places if any_letter else places[:0]


@dataclass
class LanguageModel:
    languages: list[str]
    grams: int
    #: Place of an n-gram among those of the landmarks, or -1.
    vocabulary: np.ndarray
    #: n-grams of the landmarks x languages.
    weights: np.ndarray

    def predict(self, texts: list[str | None], presence: Presence) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), BATCH):
            rows = [presence.of(t) if t else np.zeros(0, np.int32) for t in texts[at : at + BATCH]]
            matrix = np.zeros((len(rows), len(self.weights)), np.float32)
            norms = np.sqrt([max(1, len(r)) for r in rows])
            for k, r in enumerate(rows):
                own = self.vocabulary[r]
                matrix[k, own[own >= 0]] = 1
            values = matrix @ self.weights / norms[:, None]
            for k, r in enumerate(rows):
                if len(r) and self.languages:
                    best = int(values[k].argmax())
                    names[at + k] = self.languages[best]
                    scores[at + k] = float(min(1.0, max(0.0, values[k, best] + 1 / len(self.languages))))
        return names, scores


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int, ridge: float, grams: int) -> LanguageModel:
    """Fit from (language, bit row); the rows of a language in the order in which they may become landmarks."""
    languages = sorted({name for name, _ in sample})
    vocabulary = np.full(1 << BITS, -1, np.int32)
    if not languages:
        return LanguageModel([], grams, vocabulary, np.zeros((0, 0), np.float32))
    by = {name: [r for n, r in sample if n == name] for name in languages}
    each = max(1, landmarks // len(languages))
    marks = [r for name in languages for r in by[name][:each]]
    used = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(np.stack(marks))))
    vocabulary[used] = np.arange(len(used), dtype=np.int32)

    def rows(bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        plain = [np.unpackbits(b) for b in bits]
        return np.stack([p[used] for p in plain]).astype(np.float32), np.sqrt([max(1, int(p.sum())) for p in plain])

    base, base_norm = rows(marks)
    base /= base_norm[:, None]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    kept = values > values.max() * 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    gram, cross, n = 0.0, 0.0, 0
    for k, name in enumerate(languages):
        for at in range(0, len(by[name]), 128):
            block, norm = rows(by[name][at : at + 128])
            mapped = (block @ base.T / norm[:, None]) @ root
            target = np.full((len(block), len(languages)), -1 / len(languages))
            target[:, k] += 1
            gram, cross, n = gram + mapped.T @ mapped, cross + mapped.T @ target, n + len(block)
    dual = root @ np.linalg.solve(gram + ridge * n * np.eye(root.shape[1]), cross)
    return LanguageModel(languages, grams, vocabulary, (base.T @ dual).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _bit_rows(grams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(grams)
        for batch in batches:
            bits = []
            for text in batch.column("text"):
                row = np.zeros(1 << BITS, np.uint8)
                row[presence.of(text.as_py())] = 1
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), batch.column("h"), pa.array(bits, pa.binary())], ["lang", "rank", "h", "bits"])

    return run


def train(
    documents: DataFrame, per_language: int = 96, sample_rows: int = 2048, landmarks: int = 128, ridge: float = 1e-4, grams: int = 3
) -> LanguageModel:
    """Fit on labelled rows outside the held-out fold."""
    h = F.xxhash64("doc_id")
    fit_rows = documents.select("doc_id", "lang", "text", h.alias("h"), F.xxhash64("text").alias("t"))
    fit_rows = fit_rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy("h", "doc_id", "t")
    chosen = (
        fit_rows.where(F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "lang", "h", "t")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_language)
        .orderBy("rank", "lang")
        .limit(sample_rows)
    )
    texts = fit_rows.select("doc_id", "lang", "t", "text").join(F.broadcast(chosen), ["doc_id", "lang", "t"]).dropDuplicates(["doc_id", "lang", "t"])
    got = texts.select("lang", "rank", "h", "text").mapInArrow(_bit_rows(grams), "lang string, rank int, h long, bits binary").collect()
    got.sort(key=lambda r: (r["lang"], r["rank"], r.h))
    return fit([(r["lang"], np.frombuffer(r.bits, np.uint8)) for r in got], landmarks, ridge, grams)


def _scorer(model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        presence = Presence(own.grams)
        for batch in batches:
            names, scores = own.predict(batch.column("text").to_pylist(), presence)
            i = batch.schema.get_field_index("text")
            cols = [c for k, c in enumerate(batch.columns) if k != i or with_text]
            fields = [n for k, n in enumerate(batch.schema.names) if k != i or with_text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*fields, "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with ``lang_pred`` and ``score`` (0 to 1) of its whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    # Under names of their own, kept columns cannot clash with the results.
    own = {c: "text" if c == "text" else f"k{i}" for i, c in enumerate(keep)}
    others = {c: k for c, k in own.items() if k != "text"}
    rows = documents.select(*[F.col(c).alias(k) for c, k in others.items()], "text")
    schema = T.StructType([f for f in rows.schema if f.name != "text" or "text" in keep])
    schema = schema.add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(_scorer(shared, "text" in keep), schema)
    return out.select(*[F.col(k).alias(c) for c, k in own.items()], "lang_pred", "score")
