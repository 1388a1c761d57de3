"""Alignment of two tokenizers' tokens of the same texts by lockstep merging.

Where tokens of both end, a text is cut into groups; all pairs of a group's tokens are links. One state vector holds both
pointers of all texts under way; a step moves, in each, the pointer whose token ends first, or both where they end together, and
finished texts drop out. A text is dealt to the lanes in segments, cut where neither tokenizer can have a token across
(`segments`), so both end there. Repeated segments are aligned once.

Counting links over all documents is Spark's work: a block of documents sends each of its pairs once with its number of
documents, sums come back to the block, and so no more than a block's own pairs ever meets in one place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .chunks import Cut, groups_of, ids_of, tokenizer_from
from .common import Workspace, small_batches, text_of

MEMO_SEGMENTS = 500_000
LETTERS = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
MARKS = np.isin(np.arange(256), [*b".,;:!?"])
#: Links of a group from which its distinct tokens are paired instead of all.
LARGE_GROUP = 4096


class Tokenizers(NamedTuple):
    """Both tokenizers as strings and bytes that go to the workers."""

    a_json: str
    b_model: bytes

    def a_bytes(self) -> list[bytes]:
        """Each id's bytes. A byte-level vocabulary writes bytes as characters: printable ones as themselves, the others from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        parsed = json.loads(self.a_json)
        vocab = parsed["model"]["vocab"]
        out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in parsed["added_tokens"])]))
        special = {t["content"] for t in parsed["added_tokens"]}
        for piece, i in vocab.items():
            out[i] = piece.encode() if piece in special else bytes(byte[c] for c in piece)
        return out

    def b_processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)


def b_bytes(processor) -> list[bytes]:
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def load(a_path: str, b_path: str) -> Tokenizers:
    """The second model without the blank that it puts before a text: texts come with it. No piece may hold a
    blank after other characters, a mark after a letter or a letter after a line end, else tokens could lie across segments."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(b_path).read_bytes())
    proto.normalizer_spec.add_dummy_prefix = False
    normal = [p.piece for p in proto.pieces if p.type == proto.SentencePiece.NORMAL]
    if any("▁" in p.lstrip("▁") or re.search(r"[A-Za-z][.,;:!?]|\n[A-Za-z]", p) for p in normal):
        raise ValueError("a piece lies across a place where texts are cut")
    return Tokenizers(Path(a_path).read_text(encoding="utf-8"), proto.SerializeToString())


def segments(texts: pa.Array) -> Cut:
    """Texts cut before each blank after a character that is surely no white space (ASCII signs and letters, and characters of two
    bytes from C3 on, three from E4 to EE, or four), between an ASCII letter and a mark, and between a single line end after an ASCII
    sign or letter and an ASCII letter."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    back = [np.concatenate([np.zeros(k, np.uint8), raw[: max(0, len(raw) - k)]])[: len(raw)] for k in (1, 2, 3, 4)]
    within = (back[0] & 0xC0) == 0x80
    two, three = (back[1] >= 0xC3) & (back[1] < 0xE0), ((back[1] & 0xC0) == 0x80) & (back[2] >= 0xE4) & (back[2] < 0xEF)
    four = ((back[1] & 0xC0) == 0x80) & ((back[2] & 0xC0) == 0x80) & (back[3] >= 0xF0)
    solid = ((back[0] > 0x20) & (back[0] < 0x7F)) | (within & (two | three | four))
    first = (raw == 0x20) & solid
    letter = LETTERS[raw]
    first[1:] |= MARKS[raw[1:]] & letter[:-1]
    first |= letter & (back[0] == 0x0A) & (back[1] > 0x20) & (back[1] < 0x7F)
    first[at[:-1][at[:-1] < len(raw)]] = True
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(raw)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, ends[-1:] if len(ends) else 0).astype(np.int64)), pa.py_buffer(raw.tobytes())])
    found = pieces.dictionary_encode()
    return Cut(found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(begins, at))


def lockstep(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> list[np.ndarray]:
    """(lane, first A, end A, first B, end B) of every group. Lane k's tokens are those from starts[k] up to but without starts[k + 1];
    ends are their ends in bytes, and a lane's last A and B token end together."""
    lane = np.flatnonzero(np.diff(a_starts))
    i, j, stop = a_starts[lane], b_starts[lane], a_starts[lane + 1]
    from_i, from_j, out = i, j, []
    while len(lane):
        a, b = a_ends[i], b_ends[j]
        i, j, cut = i + (a <= b), j + (b <= a), a == b
        if cut.any():
            out.append((lane[cut], from_i[cut], i[cut], from_j[cut], j[cut]))
            from_i, from_j = np.where(cut, i, from_i), np.where(cut, j, from_j)
            live = i < stop
            if not live.all():
                lane, i, j, stop, from_i, from_j = (x[live] for x in (lane, i, j, stop, from_i, from_j))
    return [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for the first length, and so on."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Aligned(NamedTuple):
    """Columns of aligned segments, of which one whose bytes either tokenizer doesn't keep isn't `kept`. Pairs are distinct in a segment, A's id
    times B's vocabulary plus B's id, with how often each is linked; segment k's are those from starts[k] up to but without starts[k + 1]."""

    kept: np.ndarray
    counts: np.ndarray  # rows of n_a, n_b, n_groups, n_links
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray
    starts: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:  # type: ignore[override]
        both = [np.concatenate([x, y]) for x, y in ((self.kept, other.kept), (self.counts, other.counts), (self.pairs, other.pairs), (self.times, other.times))]
        return Aligned(both[0], both[1], [*self.groups, *other.groups], both[2], both[3], np.append(self.starts, other.starts[1:] + self.starts[-1]))


NOTHING = Aligned(np.empty(0, bool), np.empty((0, 4), np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each part of values."""
    return np.diff(np.append(0, np.cumsum(values))[starts])


class Aligner:
    """Both tokenizers at work on segments."""

    def __init__(self, tokenizers: Tokenizers):
        tokenizer = tokenizer_from(tokenizers.a_json)
        tokenizer.encode_special_tokens = True
        self.a_ids, self.b = ids_of(tokenizer), tokenizers.b_processor()
        self.a_bytes, self.b_bytes = tokenizers.a_bytes(), b_bytes(self.b)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def _keeps(self, texts: list[bytes], ids: list[list[int]], flat: list[int], starts: np.ndarray, bytes_of: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which texts their tokens' bytes are."""
        same = _sums(size[np.array(flat, np.int64)], starts) == np.fromiter(map(len, texts), np.int64, len(texts))
        if same.all() and b"".join(map(bytes_of.__getitem__, flat)) == b"".join(texts):
            return same
        return np.array([b"".join([bytes_of[t] for t in x]) == y for x, y in zip(ids, texts, strict=True)], bool)

    def __call__(self, texts: list[str]) -> Aligned:
        raw = [t.encode() for t in texts]
        ids = [self.a_ids(texts), self.b.encode(texts, num_threads=1)]
        tables = ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size))
        starts = [np.append(0, np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))) for x in ids]
        flat = [list(chain.from_iterable(x)) for x in ids]
        kept = np.ones(len(texts), bool)
        for x, f, at, (bytes_of, size) in zip(ids, flat, starts, tables, strict=True):
            kept &= self._keeps(raw, x, f, at, bytes_of, size)
        if not kept.all():
            ids = [[x if k else [] for x, k in zip(y, kept.tolist(), strict=True)] for y in ids]
            starts = [np.append(0, np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))) for x in ids]
            flat = [list(chain.from_iterable(x)) for x in ids]
        (a_all, b_all), (a_starts, b_starts) = (np.array(x, np.int64) for x in flat), starts
        ends = []
        for (_, size), all_, at in zip(tables, (a_all, b_all), starts, strict=True):
            total = np.append(0, np.cumsum(size[all_]))
            ends.append(total[1:] - np.repeat(total[at[:-1]], np.diff(at)))
        lane, a0, a1, b0, b1 = lockstep(ends[0], a_starts, ends[1], b_starts)
        order = np.argsort(a0)  # A's tokens stand in the order of lanes
        lane, a0, a1, b0, b1 = (x[order] for x in (lane, a0, a1, b0, b1))
        pair, times, of = self._links(a_all, b_all, lane, a0, a1, b0, b1)
        groups = [f"{x}|{y}" for x, y in zip(a_all[a0].tolist(), b_all[b0].tolist(), strict=True)]
        p, q = a1 - a0, b1 - b0
        for g in np.flatnonzero((p > 1) | (q > 1)).tolist():
            groups[g] = f"{','.join(map(str, flat[0][a0[g] : a1[g]]))}|{','.join(map(str, flat[1][b0[g] : b1[g]]))}"
        edges = np.searchsorted(lane, np.arange(len(texts) + 1))
        n_links = _sums(p * q, edges)
        counts = np.stack([np.diff(a_starts), np.diff(b_starts), np.diff(edges), n_links], 1)
        said, at = ";".join(groups), np.append(0, np.cumsum(np.fromiter(map(len, groups), np.int64, len(groups)) + 1))[edges].tolist()
        return Aligned(kept, counts, [said[x : y - 1] if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)], pair, times, np.searchsorted(of, np.arange(len(texts) + 1)))

    def _links(self, a_all: np.ndarray, b_all: np.ndarray, lane: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each lane with their times and lanes, in the order of lanes."""
        p, q = a1 - a0, b1 - b0
        small = p * q < LARGE_GROUP
        links_a = np.repeat(_spread(a0[small], p[small]), np.repeat(q[small], p[small]))
        links_b = _spread(np.repeat(b0[small], p[small]), np.repeat(q[small], p[small]))
        pair, of = a_all[links_a] * len(self.b_bytes) + b_all[links_b], np.repeat(lane[small], (p * q)[small])
        times = np.ones(len(pair), np.int64)
        for g in np.flatnonzero(~small).tolist():  # many tokens, few distinct ones
            x, n_x = np.unique(a_all[a0[g] : a1[g]], return_counts=True)
            y, n_y = np.unique(b_all[b0[g] : b1[g]], return_counts=True)
            pair, times = np.append(pair, (x[:, None] * len(self.b_bytes) + y).ravel()), np.append(times, np.outer(n_x, n_y).ravel())
            of = np.append(of, np.full(len(x) * len(y), lane[g]))
        by = np.lexsort((pair, of))
        pair, of, times = pair[by], of[by], times[by]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))) if len(pair) else np.empty(0, np.int64)
        return pair[new], np.add.reduceat(times, new) if len(new) else times, of[new]


class SegmentMemo:
    """Segments that were aligned before, up to a number of them and of their pairs; a full memory starts anew."""

    def __init__(self, aligner: Aligner, limit: int = MEMO_SEGMENTS):
        self.aligner, self.limit = aligner, limit
        self.places: dict[str, int] = {}
        self.known = NOTHING

    def coded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of texts in turn the places, in `known`, of their segments, and where each text's begin."""
        for group in groups_of(texts):
            cut = segments(group)
            chunks = cut.chunks.to_pylist()
            place = np.fromiter((self.places.get(c, -1) for c in chunks), np.int64, len(chunks))
            new = [chunks[k] for k in np.flatnonzero(place < 0).tolist()]
            if new and len(self.places) and (len(self.places) + len(new) > self.limit or len(self.known.pairs) > 4 * self.limit):
                self.places, self.known, place, new = {}, NOTHING, np.full(len(chunks), -1), chunks
            if new:
                place[place < 0] = len(self.places) + np.arange(len(new))
                self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
                self.known += self.aligner(new)
            yield place[cut.codes], cut.starts


def _compact(x: np.ndarray) -> bytes:
    """As few bytes a number as the largest needs, told by a first byte."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _spelt(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


DOC = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"
PAIRS = "block_pairs array<long>, block_docs array<int>"


def _aligned_groups(memo: SegmentMemo, ids: pa.Array, texts: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts its documents' rows, with their links as places among the block's pairs, and a row with those pairs."""
    at = 0
    for codes, starts in memo.coded(texts):
        n, known = len(starts) - 1, memo.known
        fine = (_sums(known.kept[codes], starts) == np.diff(starts)) & (np.diff(starts) > 0)
        of = np.repeat(np.arange(n), np.diff(starts))
        use = fine[of]
        totals = np.stack([_sums(known.counts[codes, k] * use, starts) for k in range(4)], 1)
        begin, size = known.starts[codes[use]], np.diff(known.starts)[codes[use]]
        take = _spread(begin, size)
        pair, doc, time = known.pairs[take], np.repeat(of[use], size), known.times[take]
        own, place = np.unique(pair, return_inverse=True)
        both = doc * max(1, len(own)) + place
        by = np.argsort(both)
        both = both[by]
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
        sums = np.add.reduceat(time[by], new) if len(new) else time
        doc, place = doc[by][new], place[by][new]
        edges = np.searchsorted(doc, np.arange(n + 1))
        shas, places, times = [""] * n, [b""] * n, [b""] * n
        for k in np.flatnonzero(fine).tolist():
            x, y = edges[k], edges[k + 1]
            said = ";".join(map(known.groups.__getitem__, codes[starts[k] : starts[k + 1]].tolist()))
            shas[k], places[k], times[k] = hashlib.sha256(said.encode()).hexdigest(), _compact(np.diff(place[x:y], prepend=0)), _compact(sums[x:y])
        columns = {c: pa.array(totals[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        columns |= {"groups_sha256": pa.array(shas, pa.string()), "places": pa.array(places, pa.binary()), "times": pa.array(times, pa.binary())}
        none = {"block_pairs": pa.nulls(n, pa.list_(pa.int64())), "block_docs": pa.nulls(n, pa.list_(pa.int32()))}
        yield pa.record_batch({"block": pa.array([block] * n, pa.int64()), "id": ids.slice(at, n)} | columns | none)
        if len(own):
            lists = {"block_pairs": pa.array([own], pa.list_(pa.int64())), "block_docs": pa.array([np.bincount(place, minlength=len(own)).astype(np.int32)], pa.list_(pa.int32()))}
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "id": pa.nulls(1, pa.int64())} | {c: pa.nulls(1, v.type) for c, v in columns.items()} | lists)
        at += n
        block += 1


@lru_cache(1)
def _memo(tokenizers: Tokenizers) -> SegmentMemo:
    """A worker keeps its tokenizers, and what they have aligned, from task to task."""
    return SegmentMemo(Aligner(tokenizers))


def _block_writer(tokenizers: Tokenizers):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(tokenizers)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for out in _aligned_groups(memo, batch.column("id"), batch.column("text"), block):
                block = max(block, out.column("block")[0].as_py() + 1) if out.num_rows else block
                yield out

    return align


def _summed(pairs: pa.Table, docs: pa.Table) -> pa.Table:
    """A block's documents with the counts of its pairs (place, count, best)."""
    n = int(pairs["place"].to_numpy().max()) + 1 if pairs.num_rows else 0
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count[pairs["place"].to_numpy()], best[pairs["place"].to_numpy()] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        where, many = np.cumsum(_spelt(places)), _spelt(times)
        n_best.append(int((best[where] * many).sum()))
        count_sum.append(int((count[where] * many).sum()))
    return docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


SUMMED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def link_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether its A id is in no pair of more."""
    each = blocks.where("block_pairs is not null").select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("x"))
    counts = each.groupBy(F.col("x.block_pairs").alias("pair")).agg(F.sum("x.block_docs").alias("count"))
    counts = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_a and n_b (tokens), n_groups, n_links, groups_sha256, n_best (links whose pair is its A id's most
    frequent, ties included) and count_sum (of all links, in how many rows their pair is linked).

    a_path is a byte-level BPE for the tokenizers library, b_path a sentencepiece BPE that puts a blank before a text; both encode
    a blank and the text, in which special tokens' strings are plain. A null or empty text, and one whose
    bytes either tokenizer doesn't keep, has no tokens: zeros and an empty groups_sha256. Repeated rows each count and each
    give a row; empty tables give none. Ids must fit a long and may be null. Columns other than id and text aren't read. Texts count whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "align")
    tokenizers = load(a_path, b_path)
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.when(text == "", "").otherwise(F.concat(F.lit(" "), text)).alias("text"))
    blocks = space.keep(rows.mapInArrow(_block_writer(tokenizers), f"{DOC}, {PAIRS}"))
    counts = space.keep(link_counts(blocks, tokenizers.b_processor().get_piece_size()))
    own = blocks.where("block_pairs is not null").select("block", F.posexplode("block_pairs").alias("place", "pair"))
    own = own.join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    some = blocks.where("block_pairs is null").drop("block_pairs", "block_docs")
    with_links = own.groupBy("of").cogroup(some.where("n_links > 0").groupBy("block")).applyInArrow(_summed, SUMMED)
    without = some.where("n_links = 0").select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    done = space.keep(with_links.unionByName(without))
    space.drop_all_but(done)
    return done.withColumnRenamed("id", id_column)
