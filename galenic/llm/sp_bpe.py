"""Byte-level BPE by way of a sentencepiece model that is serialised from the vocabulary.

Each byte string of the vocabulary becomes a piece of printable characters, one for a byte, and its
score is its negative rank, so that sentencepiece's best-scored merge is byte-level BPE's lowest rank.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .chunks import ChunkMemo, cut_before_blanks, joined
from .common import small_batches, text_of


def byte_characters() -> str:
    """A printable character for each byte: itself where it is one in Latin-1, otherwise from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


def read_ranks(text: str) -> dict[bytes, int]:
    """A vocabulary in lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(str.split, text.splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_from(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: the unknown piece, then the vocabulary by rank. Piece n + 1 has the n-th rank."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    bpe, none = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class SpBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model_from(ranks))
        self.by_piece = [-1, *sorted(ranks.values())]
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.chars = byte_characters()

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Each pre-token by itself. One that is a token as a whole stays whole, which its merges need not reach."""
        raw = [p.encode("utf-8", "replace") for p in pretokens]
        mapped = [b.decode("latin-1").translate(self.chars) for b in raw]
        pieces = self.model.encode(mapped, out_type=int, num_threads=1) if mapped else []
        return [[self.ranks[b]] if b in self.ranks else [self.by_piece[i] for i in p] for b, p in zip(raw, pieces, strict=True)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pretokens(self.find(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """For each chunk its ids in decimal, each with a comma after it, and the bytes that they decode to."""
        parts = [self.find(c) for c in chunks]
        new = list(set().union(*parts))
        found = {p: ("".join([f"{i}," for i in ids]).encode(), self.decode(ids)) for p, ids in zip(new, self.encode_pretokens(new), strict=True)}
        return [found[p[0]] if len(p) == 1 else (b"".join([found[x][0] for x in p]), b"".join([found[x][1] for x in p])) for p in parts]


def bpe_round_trip(vocabulary_path: str, pattern: str, text: Column) -> Column:
    """A column of (n_tokens, ids_sha256, decoded_sha256) of each text; null and empty texts have no tokens."""
    vocabulary = Path(vocabulary_path).read_text()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = ChunkMemo(cut_before_blanks, SpBpe(read_ranks(vocabulary), pattern).encode_chunks)
        for series in texts:
            rows = []
            for results, codes, starts in memo.coded(pa.array(series.fillna(""), pa.string())):
                ids, id_at = joined([r[0] for r in results], codes, starts)
                raw, raw_at = joined([r[1] for r in results], codes, starts)
                commas = np.append(0, np.cumsum(np.frombuffer(ids, np.uint8) == ord(",")))
                n_tokens = np.diff(commas[id_at])
                for k in range(len(starts) - 1):
                    decimal = ids[id_at[k] : max(id_at[k], id_at[k + 1] - 1)]  # without the last comma
                    rows.append((int(n_tokens[k]), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(raw[raw_at[k] : raw_at[k + 1]]).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests.asNondeterministic()(text)  # else a filter on the result would make it run again


def bpe_ids(vocabulary_path: str, pattern: str, text: Column) -> Column:
    """A column of each text's ids, an array of integers; null and empty texts have none."""
    vocabulary = Path(vocabulary_path).read_text()

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = SpBpe(read_ranks(vocabulary), pattern)
        memo = ChunkMemo(cut_before_blanks, lambda chunks: [bpe.encode(c) for c in chunks])
        for series in texts:
            yield pd.Series([[i for part in found for i in part] for found in memo.each(series.fillna("").tolist())])

    return ids(text)


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows each give a row; an empty table
    gives none. Columns other than id and text are not read. Texts are encoded whole; the pattern must start a
    match at a blank, and at a mark after a letter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column), bpe_round_trip(vocabulary_path, pattern, text_of(text_column)).alias("trip"))
    return rows.select(id_column, "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256")
