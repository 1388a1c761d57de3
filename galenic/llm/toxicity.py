"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's chance of being toxic is a logistic model of its words' features; a document's is the noisy-or of its
sentences: one minus the chance that none is. Training through the noisy-or needs document labels only, and the
sentence scores then say where the offence stands.

A long text must not become toxic by being long: only sentences with a feature that the labels speak for take part, equal ones
once, and in a document's score a sentence counts by how far its chance exceeds FLOOR.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, text_of, written

FEATURES = 1 << 18
#: Labelled documents to learn from at most, of each label.
SAMPLE_OF_EACH = 4000
#: Leading letters of a word that count as features besides the word, so that inflected forms share what they have in common.
PREFIXES = (4, 5, 6, 7)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
#: Sentences longer than this many words count as several.
MOST_WORDS = 60
#: Chance up to which a sentence adds nothing to its document's score.
FLOOR = 0.1


class WordFeatures:
    """Hashed features of a word, remembered; with `usable` only those for which it holds."""

    def __init__(self, usable: np.ndarray | None = None):
        self.known: dict[str, tuple[int, ...]] = {}
        self.usable = usable

    def __call__(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known = {}
            names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
            found = tuple(zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names)
            found = self.known[word] = found if self.usable is None else tuple(f for f in found if self.usable[f])
        return found

    def sentence(self, words: list[str]) -> list[int]:
        return [f for w in words for f in self(w)]


def sentences(text: str) -> list[str]:
    """A text's sentences, in order; one without words is left out, one of very many words is cut."""
    out = []
    for s in SENTENCE_END.split(text):
        words = list(WORD.finditer(s))
        out += [s[words[i].start() : words[min(i + MOST_WORDS, len(words)) - 1].end()] for i in range(0, len(words), MOST_WORDS)]
    return out


def _bags(text: str, features: WordFeatures) -> list[list[int]]:
    """For each sentence the features of its words."""
    out = []
    for s in SENTENCE_END.split(text.lower()):
        words = WORD.findall(s)
        out += [features.sentence(words[i : i + MOST_WORDS]) for i in range(0, len(words), MOST_WORDS)]
    return out


class Model:
    """weights of features, and the bias of every sentence; empty: the score of a text without sentences."""

    def __init__(self, weights: np.ndarray, bias: float, empty: float):
        self.weights, self.bias, self.empty = weights, bias, empty

    def sentence_scores(self, bags: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        flat = np.fromiter((f for b in bags for f in b), np.int64, int(sizes.sum()))
        z = np.bincount(np.repeat(np.arange(len(bags)), sizes), self.weights[flat], len(bags)) + self.bias
        return 1 / (1 + np.exp(-z))

    def document_score(self, bags: list[list[int]]) -> float:
        """bags: of each sentence the features with a weight."""
        if not bags:
            return self.empty
        some = list({tuple(b) for b in bags if b})
        if not some:
            return 0.0
        beyond = np.maximum(self.sentence_scores(some) - FLOOR, 0.0) / (1 - FLOOR)
        return float(-np.expm1(np.log1p(-np.minimum(beyond, 1 - 1e-12)).sum()))


def evidence(seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature whether it speaks for toxicity beyond chance, and its smoothed log odds, from the documents of
    label 0 and 1 that have it, and all of them. A feature counts if its likelihood ratio over documents is one that
    chance would give to a fiftieth of one feature of all."""
    (n0, n1), (c, a) = n.astype(float), seen.astype(float)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300))

    share = (a + c) / (n0 + n1)
    ratio = 2 * (part(a, n1 * share) + part(c, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - c, n0 * (1 - share)))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
    return (odds > 0) & (ratio > 2 * np.log(50.0 * max(2, np.count_nonzero(a + c >= 2)))), odds


class Bags(NamedTuple):
    """A document's distinct sentences that have usable features: all their features in turn, and how many each sentence has."""

    features: np.ndarray
    sizes: np.ndarray


def bags_of(sentences: list[list[int]]) -> Bags:
    kept = sorted({tuple(s) for s in sentences if s})
    return Bags(np.fromiter((f for s in kept for f in s), np.int32), np.fromiter(map(len, kept), np.int32, len(kept)))


def constant(n: np.ndarray) -> Model:
    """Without both labels the score is their rate throughout."""
    base = float((n[1] + 0.5) / (n.sum() + 1)) if n.sum() else 0.0
    return Model(np.zeros(FEATURES), -40.0, base if n[1] else min(base, 0.49))


def train(docs: list[Bags], labels: list[int], usable: np.ndarray, odds: np.ndarray, epochs: int = 40, rate: float = 0.15, shrink: float = 0.0, seed: int = 1) -> Model:
    """Minimises the documents' log loss through the noisy-or over the features that `evidence` leaves, from their log
    odds on, with Adagrad over batches of documents. Both labels must be there."""
    y = np.array(labels, float)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    flat, sizes = [d.features for d in docs], [d.sizes for d in docs]
    weights, bias = np.where(usable, 0.75 * odds, 0.0), -5.0
    squares, bias_square = np.full(FEATURES, 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    order = np.array([i for i, d in enumerate(docs) if len(d.sizes)], int)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), 128):
            batch = order[k : k + 128]
            f = np.concatenate([flat[i] for i in batch])
            of_sentence = np.concatenate([sizes[i] for i in batch])
            sentence = np.repeat(np.arange(len(of_sentence)), of_sentence)
            doc = np.repeat(np.arange(len(batch)), [len(sizes[i]) for i in batch])
            z = np.bincount(sentence, weights[f], len(of_sentence)) + bias
            p = 1 / (1 + np.exp(-z))
            none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(batch))  # log of the chance that no sentence is toxic
            score = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
            # d loss / d none: for toxic documents (1 - score) / score, for others -1; d none / d z is -p
            g_none = np.where(y[batch] == 1, (1 - score) / score, -1.0) / len(batch)
            g_z = -p * g_none[doc]
            touched, at = np.unique(f, return_inverse=True)
            g = np.bincount(at, g_z[sentence], len(touched)) + shrink * weights[touched] / len(batch)
            squares[touched] += g**2
            weights[touched] -= rate * g / np.sqrt(squares[touched])
            g_bias = g_z.sum()
            bias_square += g_bias**2
            bias = min(-4.0, bias - rate * g_bias / np.sqrt(bias_square))
    return Model(weights, float(bias), min(base, 0.49))


def sampled(docs: DataFrame, labels: DataFrame, rows: Column, id_column: str = "doc_id", of_each: int = SAMPLE_OF_EACH) -> DataFrame:
    """(key, label) of at most of_each labelled documents of either label among those for which `rows` holds: those of the
    smallest hash of id. A document that is labelled more than once counts as toxic if any label says so; labels other
    than 0 and 1 and null ids don't count. Only ids are joined here."""
    marks = labels.select(F.col(id_column).alias("key"), F.col("toxic").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    marks = marks.groupBy("key").agg(F.max("label").cast("int").alias("label"))
    known = docs.where(rows).select(F.col(id_column).alias("key")).distinct().join(marks, "key").withColumn("hash", F.xxhash64(F.lit(11), F.col("key").cast("string")))
    parts = [known.where(F.col("label") == x).orderBy("hash", "key").limit(of_each) for x in (0, 1)]
    return parts[0].unionByName(parts[1]).select("key", "label")


def sampled_texts(docs: DataFrame, labels: DataFrame, rows: Column, id_column: str = "doc_id", text_column: str = "text", of_each: int = SAMPLE_OF_EACH) -> DataFrame:
    """key, label, text of the sampled documents, whole: one text of each, of several that share an id the one of the smallest
    hash. So there are no more rows than sampled ids, however often one occurs, and the same in every run."""
    chosen = sampled(docs, labels, rows, id_column, of_each)  # so few rows that they can be sent to the texts
    texts = docs.where(rows).select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    one = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("key", "label", "least.text")


def learn(docs: DataFrame, labels: DataFrame, rows: Column, id_column: str = "doc_id", text_column: str = "text", of_each: int = SAMPLE_OF_EACH) -> Model:
    """A model from the documents for which `rows` holds and that `labels` (id, toxic 0/1) marks. It is fitted on a bounded sample:
    of_each documents of either label, each with its whole text. Which features count is found from numbers of documents
    that Spark adds up; the driver gets those features of the sampled texts only. Scoring has no bound."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, seen, n = WordFeatures(), np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for rows in batches:
            for label, text in zip(rows["label"], rows["text"], strict=True):
                n[label] += 1
                seen[label, list({f for b in _bags(text, features) for f in b})] += 1
        of, feature = np.nonzero(seen)
        yield pd.DataFrame({"label": np.concatenate([[0, 1], of]), "feature": np.concatenate([[-1, -1], feature]), "n": np.concatenate([n, seen[of, feature]])})

    texts = written(sampled_texts(docs, labels, rows, id_column, text_column, of_each), "toxicity-sample")
    counts = texts.mapInPandas(counted, "label long, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    label, feature, number = (counts[c].to_numpy() for c in ("label", "feature", "n"))
    seen = np.zeros((2, FEATURES + 1), np.int64)
    seen[label, feature] = number  # that of documents has feature -1 and so the last place
    n, seen = seen[:, -1], seen[:, :-1]
    if not n.all():
        return constant(n)
    usable, odds = evidence(seen, n)

    @F.pandas_udf("features binary, sizes binary")
    def bags(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = WordFeatures(usable)
        for series in texts:
            found = [bags_of(_bags(text, features)) for text in series]
            yield pd.DataFrame([(b.features.tobytes(), b.sizes.tobytes()) for b in found], columns=["features", "sizes"])

    fitted = texts.select("label", F.xxhash64("key", "text").alias("order"), bags("text").alias("bags"))
    found = fitted.select("label", "order", "bags.*").toArrow().sort_by([("order", "ascending"), ("label", "ascending")])
    fits = [Bags(np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(k.as_buffer(), np.int32)) for f, k in zip(found["features"], found["sizes"], strict=True)]
    return train(fits, found["label"].to_pylist(), usable, odds)


def toxicity(model: Model, text: Column) -> Column:
    """A column of scores from 0 to 1, null texts as empty."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = WordFeatures(model.weights != 0)
        for series in texts:
            yield pd.Series([model.document_score(_bags(t, features)) for t in series.fillna("").tolist()], dtype=float)

    return score.asNondeterministic()(text)  # else a filter on the result would make it run again


def offending_sentences(model: Model, text: Column, threshold: float = 0.5) -> Column:
    """A column of the sentences that score at least the threshold: array of (number, sentence, score), numbers from 0."""

    @F.pandas_udf("array<struct<number:int,sentence:string,score:double>>")
    def locate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = WordFeatures()
        for series in texts:
            out = []
            for text in series.fillna("").tolist():
                parts = sentences(text)
                scores = model.sentence_scores([features.sentence(WORD.findall(s.lower())) for s in parts]) if parts else []
                out.append([{"number": i, "sentence": s, "score": float(p)} for i, (s, p) in enumerate(zip(parts, scores, strict=True)) if p >= threshold])
            yield pd.Series(out)

    return locate(text)


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, score, predicted (1 if the score is at least the threshold).

    Null texts count as empty; texts without sentences get the model's score for those, which is below one half; texts without
    any feature that speaks for toxicity get 0, however long they are.
    Repeated rows each give a row; an empty table gives none. Columns other than id and text are not read. All
    sentences of a text count, however long it is.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column), toxicity(model, F.col(text_column)).alias("score"))
    return rows.select(id_column, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
