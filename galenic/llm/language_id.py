"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds (multiplies) its letters' vectors, each
permuted by its position; a text's vector bundles (adds) its trigrams' vectors; a language's prototype bundles
its texts. A text's language is the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

DIMENSIONS = 1024
SEED = 7
UNKNOWN = "und"
#: Code points have 21 bits; a trigram is three of them in one number.
BITS = 21
#: Trigram vectors that a worker keeps, a KB each at 1024 dimensions.
KEPT_TRIGRAMS = 40_000


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter (a run of those is a word's edge)."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text's words, each word with an edge on both sides."""
    points = lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not points.any():
        return np.empty(0, np.int64)
    padded = np.concatenate([[0], points, [0]]).astype(np.int64)
    padded = padded[np.append(True, (padded[1:] != 0) | (padded[:-1] != 0))]
    if len(padded) < 3:
        return np.empty(0, np.int64)
    return padded[:-2] << 2 * BITS | padded[1:-1] << BITS | padded[2:]


class Binder:
    """Trigram vectors, made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            rng = np.random.Generator(np.random.Philox(key=[self.seed, point]))
            self.letters[point] = rng.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[point]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Where in `vectors` each of the distinct trigrams stands."""
        if len(self.row) + len(grams) > max(KEPT_TRIGRAMS, len(grams)):
            self.row = {}
        mask = (1 << BITS) - 1
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            k = self.row.get(g)
            if k is None:
                k = self.row[g] = len(self.row)
                if k == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[k] = np.roll(self.letter(g >> 2 * BITS), 2) * np.roll(self.letter(g >> BITS & mask), 1) * self.letter(g & mask)
            out[i] = k
        return out

    def bundle(self, text: str) -> np.ndarray:
        grams, counts = np.unique(trigrams(text), return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(grams), 4096):  # bounds the memory of a very long text
            rows = self.rows(grams[i : i + 4096])
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    binder = Binder()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            v = binder.bundle(text)
            norm = float(np.linalg.norm(v))
            if norm:
                sums.setdefault(lang, np.zeros(len(v)))[:] += v / norm
    yield pa.record_batch({"lang": pa.array(list(sums), pa.string()), "part": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})


#: Distinct labels beyond which learning stops with an error: prototypes are sent to every task.
MOST_LANGUAGES = 2000


def learn_prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Bundles all rows of (text, lang), null in either left out: summed within tasks, then by language and dimension."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = rows.mapInArrow(_partial, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r.lang: np.array(r.v) for r in sorted(found, key=lambda r: r.lang)}


def predicted(prototypes: dict[str, np.ndarray], text: Column) -> Column:
    """A column of (lang, score): the nearest prototype, ties to the smaller name, and the cosine, negative ones as 0.
    A text that is null or has no letter, or any text if nothing was learned, gets `und` and 0."""
    names = list(prototypes)
    matrix = np.array([v / (np.linalg.norm(v) or 1.0) for v in prototypes.values()], np.float32).reshape(len(names), DIMENSIONS)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        binder = Binder()
        for series in texts:
            rows = []
            for text in series.fillna("").tolist():
                v = binder.bundle(text)
                norm = float(np.linalg.norm(v))
                if norm and names:
                    cosines = matrix @ (v / norm)
                    k = int(cosines.argmax())
                    rows.append((names[k], float(min(1.0, max(0.0, cosines[k])))))
                else:
                    rows.append((UNKNOWN, 0.0))
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return predict.asNondeterministic()(text)  # else a filter on the result would make it run again


def identify_languages(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, by prototypes learned from `labelled` (text, lang).

    Null texts and texts without a letter get `und` with score 0. Repeated rows each give a row; an empty table gives
    none. Columns other than id and text are not read. Whole texts count, however long.
    """
    prototypes = learn_prototypes(labelled)
    rows = docs.select(F.col(id_column), predicted(prototypes, F.col(text_column)).alias("found"))
    return rows.select(id_column, F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
