"""Token ids in files of patched frame-of-reference blocks.

File: MAGIC, then blocks, then a footer. A block holds up to 128 ids: the smallest one, a bit width, the packed
differences, and a list of exceptions for differences wider than that. The footer holds each document's id and
length, the byte at which each block starts, and its own size, so that a reader can start at any block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chunks import LATIN, ChunkMemo, cut_at_blanks, ids_of, joined, tokenizer_from
from .common import small_batches, text_of, written
from .sp_bpe import byte_characters

MAGIC = b"GALPFOR1"
BLOCK = 128
#: Differences up to this percentile of a block set its width; the rest are exceptions.
PERCENTILE = 90
#: Blocks that are packed or read at once.
BLOCKS_AT_ONCE = 2048
HEAD = np.dtype([("least", "<u4"), ("n", "u1"), ("width", "u1"), ("n_exceptions", "u1")])
TAIL = np.dtype([("n_docs", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
MANIFEST = "part int, file string, n_docs long, n_ids long"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that a non-negative integer below 2**32 needs."""
    return np.frexp(x.astype(np.float64))[1]


def _squeeze(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK integers below 2**w as rows of bytes, w bits for each, lowest first: eight of them fill w bytes."""
    lanes = values.reshape(-1, 8).astype(np.uint64)
    words = np.zeros((len(lanes), -(-w // 8)), "<u8")
    for i in range(8):
        word, shift = divmod(i * w, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + w > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.view(np.uint8)[:, :w].reshape(len(values), -1)


def _spread(body: np.ndarray, w: int) -> np.ndarray:
    """The inverse of _squeeze."""
    packed = body.reshape(-1, w)
    raw = np.zeros((len(packed), -(-w // 8) * 8), np.uint8)
    raw[:, :w] = packed
    words = raw.view("<u8")
    out = np.empty((len(packed), 8), np.uint32)
    for i in range(8):
        word, shift = divmod(i * w, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + w > 64:
            lane |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = lane & np.uint64((1 << w) - 1)
    return out.reshape(len(body), BLOCK)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run of ids' blocks and each block's size; the last block may hold fewer ids."""
    if not len(ids):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    n_blocks = -(-len(ids) // BLOCK)
    full = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n_blocks, BLOCK)
    least = full.min(1)
    diff = full - least[:, None]
    at = BLOCK * PERCENTILE // 100
    width = _bits(np.partition(diff, at, 1)[:, at])
    row, place = np.nonzero(diff.astype(np.uint64) >> width[:, None].astype(np.uint64))  # the exceptions
    beyond = diff[row, place]
    diff[row, place] = 0
    n_beyond = np.bincount(row, minlength=n_blocks)
    head = np.zeros(n_blocks, HEAD)
    head["least"], head["n"], head["width"], head["n_exceptions"] = least, BLOCK, width, n_beyond
    head["n"][-1] = len(ids) - (n_blocks - 1) * BLOCK
    body = BLOCK // 8 * width.astype(np.int64)
    size = HEAD.itemsize + body + 5 * n_beyond
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n_blocks, -1)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[(start[rows] + HEAD.itemsize)[:, None] + np.arange(BLOCK // 8 * int(w))] = _squeeze(diff[rows], int(w))
    lists = start + HEAD.itemsize + body
    nth = np.arange(len(row)) - (np.cumsum(n_beyond) - n_beyond)[row]  # of a block's exceptions
    out[lists[row] + nth] = place
    out[(lists[row] + n_beyond[row] + 4 * nth)[:, None] + np.arange(4)] = beyond.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, size


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a run of ids, one by one."""
    data, size = pack(ids)
    return [data[end - n : end].tobytes() for n, end in zip(size, np.cumsum(size), strict=True)]


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; starts: where in data each begins."""
    raw = np.frombuffer(data, np.uint8)
    if not len(starts):
        return np.empty(0, np.uint32)
    heads = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    out = np.zeros((len(starts), BLOCK), np.uint32)
    body_at = starts + HEAD.itemsize
    size = BLOCK // 8 * heads["width"].astype(np.int64)
    for w in np.unique(heads["width"][heads["width"] > 0]):
        rows = np.flatnonzero(heads["width"] == w)
        out[rows] = _spread(raw[body_at[rows][:, None] + np.arange(BLOCK // 8 * int(w))], int(w))
    n_beyond = heads["n_exceptions"].astype(np.int64)
    row = np.repeat(np.arange(len(starts)), n_beyond)
    nth = np.arange(len(row)) - (np.cumsum(n_beyond) - n_beyond)[row]
    lists = body_at + size
    at = (lists[row] + n_beyond[row] + 4 * nth)[:, None] + np.arange(4)
    out[row, raw[lists[row] + nth]] = raw[at].view("<u4")[:, 0]
    out += heads["least"][:, None]
    return out[np.arange(BLOCK) < heads["n"][:, None].astype(np.int64)]


class PackedWriter:
    """Streams documents into one file; only the footer's numbers stay in memory."""

    def __init__(self, sink):
        self.sink, self.at, self.n_ids = sink, sink.write(MAGIC) or len(MAGIC), 0
        self.starts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.add_many([doc_id], np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))

    def add_many(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents whose ids follow each other."""
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK * BLOCKS_AT_ONCE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, n, BLOCK * BLOCKS_AT_ONCE):
            data, size = pack(ids[i : min(n, i + BLOCK * BLOCKS_AT_ONCE)])
            self.starts.append(self.at + np.cumsum(size) - size)
            self.at += len(data)
            self.sink.write(data.tobytes())
        self.n_ids += n
        self.waiting = [ids[n:]]
        self.n_waiting = len(ids) - n

    def close(self) -> None:
        self._flush(True)
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        starts = np.concatenate([np.empty(0, np.int64), *self.starts])
        lengths = np.concatenate([np.empty(0, np.int64), *self.lengths])
        for part in (np.array([x or 0 for x in self.doc_ids], "<i8"), null, lengths.astype("<u8"), starts.astype("<u8"), np.array((len(self.doc_ids), self.n_ids, len(starts)), TAIL)):
            self.sink.write(part.tobytes())


def read_packed(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, ids of all documents before it in the file, its ids) from a seekable file, some blocks at a time."""
    end = source.size()
    source.seek(end - TAIL.itemsize)
    tail = np.frombuffer(source.read(TAIL.itemsize), TAIL)[0]
    n_docs, n_blocks = int(tail["n_docs"]), int(tail["n_blocks"])
    foot = end - TAIL.itemsize - 17 * n_docs - 8 * n_blocks
    source.seek(foot)
    footer = source.read(end - TAIL.itemsize - foot)
    doc_ids = np.frombuffer(footer, "<i8", n_docs)
    null = np.frombuffer(footer, "u1", n_docs, 8 * n_docs)
    ends = np.cumsum(np.frombuffer(footer, "<u8", n_docs, 9 * n_docs).astype(np.int64))
    starts = np.append(np.frombuffer(footer, "<u8", n_blocks, 17 * n_docs).astype(np.int64), foot)
    left, done, doc = np.empty(0, np.uint32), 0, 0
    for i in range(0, max(n_blocks, 1), BLOCKS_AT_ONCE):
        j = min(n_blocks, i + BLOCKS_AT_ONCE)
        source.seek(int(starts[i]))
        left = np.concatenate([left, unpack_blocks(source.read(int(starts[j] - starts[i])), starts[i:j] - starts[i])])
        stop = int(np.searchsorted(ends, done + len(left), "right"))
        used = 0
        for k in range(doc, stop):
            n = int(ends[k]) - done - used
            yield None if null[k] else int(doc_ids[k]), done + used, left[used : used + n]
            used += n
        left, done, doc = left[used:], done + used, max(doc, stop)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class WordIds:
    """Ids of chunks as bytes. The tokenizer's model alone encodes words of lower-case Latin letters, if the tokenizer's other
    steps only write those as byte characters, which is asked of it first; all else goes through the whole tokenizer."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = tokenizer_from(tokenizer_json)
        self.whole = ids_of(whole)
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bare = ids_of(bare)
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        vocabulary = whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.letters, self.chars = {c for c in LATIN if c.islower()}, byte_characters()
        probe = "".join(a + b for a in sorted(self.letters) for b in sorted(self.letters))  # every two letters side by side
        mapped = [self._mapped(probe)]
        self.plain = bool(suffix) and self._parts(whole, probe) == mapped
        self.lowers = self._parts(whole, probe.upper().replace("SS", "ß")) == mapped and self._parts(whole, "SS") == ["ss"]

    def _mapped(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)

    @staticmethod
    def _parts(tokenizer, text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    def _words(self, words: list[str]) -> list[bytes]:
        """Many words at once, parted where an id ends a word."""
        ids = np.concatenate([np.array(x, "<u4") for x in self.bare([" ".join(map(self._mapped, words[i : i + 1000])) for i in range(0, len(words), 1000)])])
        at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        data = ids.tobytes()
        if len(at) != len(words) + 1 or at[-1] != len(data):
            raise ValueError("a word does not end where its last id says so")
        return [data[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        plain = [self.plain and c != "" and self.letters.issuperset(c) for c in chunks]
        words = [c for c, p in zip(chunks, plain, strict=True) if p]
        others = [c for c, p in zip(chunks, plain, strict=True) if not p]
        of_words, of_others = iter(self._words(words) if words else []), iter(self.whole(others) if others else [])
        return [next(of_words) if p else np.array(next(of_others), "<u4").tobytes() for p in plain]


@lru_cache(maxsize=1)
def _memo(tokenizer_json: str) -> ChunkMemo:
    """A worker's tokenizer and what it has encoded, kept from task to task; ChunkMemo bounds it."""
    encode = WordIds(tokenizer_json)
    return ChunkMemo(partial(cut_at_blanks, lower=encode.lowers), encode)


def _writer(folder: str, tokenizer_json: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, writer = _memo(tokenizer_json), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, path = _open(folder)
                fs.create_dir(path, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"  # an attempt that fails leaves a file that no manifest names
                sink = fs.open_output_stream(f"{path}/{name}")
                writer = PackedWriter(sink)
            doc_ids, at = batch.column("id").to_pylist(), 0
            for results, codes, starts in memo.coded(batch.column("text")):
                data, where = joined(results, codes, starts)
                ids = np.insert(np.frombuffer(data, "<u4"), where[1:] // 4, end_id)
                writer.add_many(doc_ids[at : at + len(starts) - 1], ids, np.diff(where) // 4 + 1)
                at += len(starts) - 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.doc_ids)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes every text, appends the end id, and writes files in ascending id order; returns their manifest
    (part, file, n_docs, n_ids), which is itself a written table. Files that it doesn't name don't count.

    The tokenizer must drop white space and part letters from marks, so that no token crosses either. Null and empty texts have the end id
    alone; null ids come first; repeated rows are all written; an empty table gives no file. Columns other than
    id and text are not read. folder: any address that Arrow's file systems open and all executors share.
    """
    small_batches(docs.sparkSession)
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]  # rows of one id in the order of their texts' hashes, so that a hot id is split
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(_writer(folder, tokenizer_json, end_id), MANIFEST), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    The manifest is a written table with a row per file; files are read by as many tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as source:
                    out: list[tuple] = []
                    for doc_id, start, ids in read_packed(source):
                        out.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("file", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.record_batch({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "n_tokens", "ids_crc32"), columns, strict=True)})
