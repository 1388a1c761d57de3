"""Join keys by rare shingles: an exact way to find links among many texts that have much in common.

Of two sets that link, each has few shingles that the other lacks. In any order that all sets share, the first of those
that they have in common is among the first few of either. With the rarest shingles first, texts that have only frequent
passages in common share no key. How few depends on both sizes, so sizes are cut into narrow bands and a key names a pair of bands:
texts of one template that differ a little too much to link don't meet, for their own shingles fill all their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shingles import Shingles, U, mix, shingled

#: Cells in which shingles are counted for the order; the array of counts has this size whatever the data.
RARITY_BITS = 20


def size_bands(num: int, den: int, most: int = 1 << 32) -> np.ndarray:
    """Where bands of sizes begin: some ten bands lie between a set's size and that of the largest it can link with."""
    starts, ratio = [1], 1 + (den - num) / num / 10
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
    return np.array(starts)


def keys_needed(n: int, starts: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
    """(smaller band, larger band, how many of its first shingles) for a set of n and every band that holds a set it can link with."""
    own, out = int(np.searchsorted(starts, n, "right")) - 1, []
    least, most = -(-n * num // den), n * den // num
    for band in range(int(np.searchsorted(starts, least, "right")) - 1, int(np.searchsorted(starts, most, "right"))):
        partner = max(int(starts[band]), least)
        both = -(-num * (n + partner) // (num + den))  # what they have in common at least
        out.append((min(own, band), max(own, band), n - both + 1))
    return out


def _counter(n_words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            h = shingled(batch.column("text"), n_words).hashes
            n += np.bincount((h >> U(64 - RARITY_BITS)).astype(np.int64), minlength=len(n))
        cell = np.flatnonzero(n)
        yield pa.record_batch({"cell": pa.array(cell), "n": pa.array(n[cell])})

    return count


def ordered(h: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Shingles with the rarest first, in an order that all sets share."""
    return h[np.lexsort((h, frequency[(h >> U(64 - RARITY_BITS)).astype(np.int64)]))]


def set_keys(s: Shingles, k: int, frequency: np.ndarray, starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys, and its role in each: 0 where both bands are one, 1 as the smaller of two, 2 as the larger. Sets meet in roles that sum to 0 or 3."""
    h = ordered(s.of(k), frequency)
    each = keys_needed(len(h), starts, num, den) if len(h) else []
    n = [n for *_, n in each]
    own = int(np.searchsorted(starts, len(h), "right")) - 1
    bands = np.repeat(mix(np.array([low << 32 | high for low, high, _ in each], U)), n)
    roles = np.repeat(np.array([0 if low == high else 1 if low == own else 2 for low, high, _ in each], np.int8), n)
    return mix(np.concatenate([np.empty(0, U), *[h[:x] for x in n]]) ^ bands), roles


def _keyer(n_words: int, num: int, den: int, frequency: np.ndarray):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = size_bands(num, den)
        for batch in batches:
            s = shingled(batch.column("text"), n_words)
            each = [set_keys(s, k, frequency, starts, num, den) for k in range(len(s.starts) - 1)]
            of = np.repeat(np.arange(len(each)), [len(k) for k, _ in each])
            keys, roles = np.concatenate([np.empty(0, U), *[k for k, _ in each]]), np.concatenate([np.empty(0, np.int8), *[r for _, r in each]])
            yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "role": pa.array(roles), "node": batch.column("node").take(pa.array(of))})

    return keyed


def rare_keys(texts: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """(key, role, node) for rows (node, text): any two texts that link have a key in common, in roles that sum to 0 or 3. Keys that
    no two such texts have are left out."""
    cells = texts.select("text").mapInArrow(_counter(n_words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << RARITY_BITS, np.uint16)
    frequency[cells["cell"].to_numpy()] = np.minimum(cells["n"].to_numpy(), 65535)
    node = texts.schema["node"].dataType.simpleString()
    keyed = texts.mapInArrow(_keyer(n_words, num, den, frequency), f"key long, role byte, node {node}")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("lo"), F.max("role").alias("hi"))
    met = met.where((F.col("n") > 1) & ((F.col("hi") == 0) | (F.col("lo") < F.col("hi")))).select("key")
    return keyed.join(met, "key", "left_semi").distinct()
