"""Phrase collocations: frequent word sequences per language, scored by how much more often they stand than their parts would by chance.

A phrase is frequent only if its parts are, so phrases are counted by length: one scan of the texts counts the words, the
next the pairs of frequent words, and so on. A task counts in a HAT-trie (`hat_trie`), whose sorted runs are summed by Spark; a key begins with
its prefix, the ids of its first two words, and runs meet by key, so a hot prefix is spread over all partitions. What is frequent goes to
the next scan as a bitmap of fixed size: it may let more pass, never less. Keys are hashes, which can only count too much;
the last scan counts what has passed as strings, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import BITMAP_BITS, Workspace, small_batches, text_of
from .hat_trie import HatTrie
from .shingles import STEPS, U, mix, span_hashes

NO_LANGUAGE = "und"
LONGEST = 5
FILTER_BITS = 26
SLICE_BYTES = 1 << 20
#: Bits of the first and second word's id in a key.
FIRST, SECOND = 16, 12
PIECE_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
BLANK = np.isin(np.arange(256), [0x20, 0x09])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """The words of some texts: the texts' bytes, where words begin and end, whose they are, their piece, and hashes with the language mixed in."""

    raw: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE_BYTES of text, or one longer text: numpy's intermediates are several times as large as the texts."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array, langs: list[str]) -> Words:
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    end = PIECE_END[raw]
    word = ~(end | BLANK[raw])
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, at)))
    own = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(langs)}
    lang = np.array([own[x] for x in langs], U)
    piece = np.cumsum(end, dtype=np.int64)[first] + text  # goes up with each end of a piece or text between two words
    return Words(raw, first, last, text, piece, mix(span_hashes(raw, first, last) ^ lang[text]))


def keys_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place its k-word phrase's key, and whether k words stand there in one piece."""
    n = max(0, len(w.first) - k + 1)
    total = np.full(n, U(k))
    for i in range(k):
        total += w.hashes[i : n + i] * STEPS[i]
    rest = mix(total)
    if k == 1:
        return w.hashes[:n] >> U(64 - FIRST) << U(64 - FIRST) | rest >> U(FIRST), np.ones(n, bool)
    prefix = w.hashes[:n] >> U(64 - FIRST) << U(64 - FIRST) | w.hashes[1 : n + 1] >> U(64 - SECOND) << U(64 - FIRST - SECOND)
    return prefix | rest >> U(FIRST + SECOND), w.piece[:n] == w.piece[k - 1 : n + k - 1]


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U((1 << FILTER_BITS) - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


def frequent_at(w: Words, k: int, bits: np.ndarray) -> np.ndarray:
    """Whether the k-word phrase at each place has passed."""
    keys, whole = keys_of(w, k)
    return whole & passing(bits, keys)


def _counter(k: int, shorter: np.ndarray | None):
    """Sorted runs of a task's k-word phrases whose parts of k - 1 words have passed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie()
        run = lambda keys, counts: pa.record_batch({"key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})
        for batch in (part for whole in batches for part in slices(whole)):
            w = words_of(batch.column("text"), batch.column("lang").to_pylist())
            keys, use = keys_of(w, k)
            if shorter is not None:
                passed = frequent_at(w, k - 1, shorter)
                use = use & passed[:-1][: len(use)] & passed[1:][: len(use)]
            for x in trie.add(keys[use]):
                yield run(*x)
        for x in trie.spill():
            yield run(*x)

    return count


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for the low bits of each key: a fixed number of bits, whatever the data."""
    at = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    blocks = frequent.select(at.alias("at")).groupBy(F.expr(f"at div {BITMAP_BITS}").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for block, bits in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
        out[block * BITMAP_BITS // 8 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return out


class Plain(NamedTuple):
    """Words in lower case with a blank after each, one after the other, and where each begins."""

    data: np.ndarray
    begins: np.ndarray

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k-word phrases that begin with these words."""
        begin, length = self.begins[at], self.begins[at + k] - self.begins[at] - 1
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        out = self.data[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.string())


def plain(w: Words) -> Plain:
    size = w.last - w.first + 1
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    source = np.repeat(w.first - begins[:-1], size) + np.arange(begins[-1])
    data = LOWER[np.append(w.raw, np.uint8(0x20))[source]]  # the byte after a word is a blank or an end
    data[begins[1:] - 1] = 0x20
    return Plain(data, begins)


def _exact_counter(bits: list[np.ndarray]):
    """(lang, k, phrase, n) of the phrases of each batch that have passed, as strings; with k of 0 the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            langs = batch.column("lang")
            w = words_of(batch.column("text"), langs.to_pylist())
            words, passed = plain(w), None
            for k in range(LONGEST + 1):
                if k == 0:
                    texts, n = np.unique(w.text, return_counts=True)
                    phrases = pa.array([""] * len(texts), pa.string())
                else:
                    keys, use = keys_of(w, k)
                    use = frequent_at(w, k, bits[k - 1]) if k <= len(bits) else use & passed[:-1][: len(use)] & passed[1:][: len(use)]
                    passed, places = use, np.flatnonzero(use)
                    # two hashes tell phrases apart
                    keys, other = keys[places], mix(sum((w.hashes[places + i] * STEPS[LONGEST + i] for i in range(k)), np.zeros(len(places), U)))
                    order = np.lexsort((other, keys))
                    keys, other, places = keys[order], other[order], places[order]
                    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (other[1:] != other[:-1]))) if len(keys) else np.empty(0, np.int64)
                    n, texts, phrases = np.diff(np.append(new, len(keys))), w.text[places[new]], words.phrases(places[new], k)
                yield pa.record_batch({"lang": langs.take(pa.array(texts)), "k": pa.array(np.full(len(texts), k, np.int32)), "phrase": phrases, "n": pa.array(n.astype(np.int64))})

    return count


def phrase_counts(docs: DataFrame, least: int, space: Workspace, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, k, phrase, n) of all phrases of k words that stand at least `least` times in a language; k is 0 for a language's number of words."""
    rows = docs.select(text_of(text_column).alias("text"), F.coalesce(F.col(lang_column), F.lit(NO_LANGUAGE)).alias("lang"))
    bits: list[np.ndarray] = []
    for k in range(1, LONGEST):
        counted = rows.mapInArrow(_counter(k, bits[-1] if bits else None), "key long, n long")
        frequent = space.keep(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
        bits.append(_bitmap(frequent))
        space.drop(frequent)
    exact = rows.mapInArrow(_exact_counter(bits), "lang string, k int, phrase string, n long")
    return space.keep(exact.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0)))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Each language's `top` phrases of 2 to 5 words: lang, rank, phrase, a (times it stands), l and r (of its two parts), n (the language's words), score.

    A-Z count as a-z. Words are what stands between blanks and tabs in a piece; pieces end at . , ; : ! ? and line ends. A phrase stands
    within one piece and counts wherever it stands, overlaps included; a candidate stands `least` times or more. Its score is
    floor(1000 a n / (l r)) for the cut that makes it least, of ties the first. A candidate that stands in a longer one of as many times or more is left out. Ranks go by
    score and a, descending, and then the phrase's bytes. A null text has no words, a null language is `und`; repeated rows count each;
    without candidates a language has no rows. Columns other than text and language aren't read. Texts count whole.
    """
    small_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "phrases")
    counts = phrase_counts(docs, least, space, text_column, lang_column)
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("cut"))).alias("left"), F.concat_ws(" ", F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    part = counts.where("k > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(counts.where("k = 0").select("lang", "n"), "lang")
    score = F.expr("(cast(1000 as decimal(19, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))

    inner = candidates.where("k > 2").select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("size"))).alias("phrase"), F.col("a").alias("longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    done = space.keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score"))
    space.drop_all_but(done)
    return done
