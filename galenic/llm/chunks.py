"""Whole texts through a tokenizer by way of chunks whose results are remembered.

A text is cut only where no token can cross: then the text's tokens are its chunks' tokens in turn, and a frequent
chunk is encoded once for a worker. Cutting, numbering the distinct chunks and putting results together are Arrow's
and numpy's work on many texts at once; Python sees distinct chunks only. The memory is bounded; a full one starts anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before a blank that follows no white space. In byte-level patterns a blank there starts a new match,
#: and everything before it ends with the match it belongs to. Python's \s holds what other engines' \s hold.
BEFORE_BLANK = re.compile(r"(?<=[^\s\u180e\ufeff])(?= )")
SPACE_AT_END = r"(?:[\s\v\x1c-\x1f]|\p{Z}|\x{85}|\x{180e}|\x{feff})\z|\A\z"
#: Marks that part from Latin letters before them: a run of letters ends there in every pattern that tells letters from signs.
MARKS = ".,;:!?"
LATIN = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MEMO_CHUNKS = 400_000
MEMO_CHARS = 48
#: Bytes of texts that are worked on together; a longer text is worked on by itself.
GROUP_BYTES = 4_000_000


class Cut(NamedTuple):
    """The chunks of some texts: text k consists of chunks[codes[starts[k]]], ... up to but without starts[k + 1]."""

    chunks: pa.Array
    codes: np.ndarray
    starts: np.ndarray


def _parted(texts: pa.Array) -> Cut:
    parts = pc.split_pattern(texts, " ")
    starts = parts.offsets.to_numpy().astype(np.int64)
    found = parts.flatten().dictionary_encode()
    return Cut(found.dictionary, found.indices.to_numpy().astype(np.int64), starts - starts[0])


def _unmarked(cut: Cut, lower: bool = False) -> Cut:
    """A chunk that is a word of Latin letters with marks after it becomes two, the word and the marks."""
    stem = pc.utf8_rtrim(cut.chunks, MARKS)
    plain = pc.match_substring_regex(stem, f"\\A ?[{LATIN}]+\\z")
    word = pc.if_else(plain, pc.utf8_lower(stem) if lower else stem, cut.chunks).dictionary_encode()
    marks = pc.if_else(plain, pc.utf8_ltrim(cut.chunks, " " + LATIN), "").dictionary_encode()
    codes = np.stack([word.indices.to_numpy(), marks.indices.to_numpy() + len(word.dictionary)], 1).astype(np.int64)
    there = np.stack([np.ones(len(plain), bool), pc.not_equal(pc.if_else(plain, marks.dictionary.take(marks.indices), ""), "").to_numpy(zero_copy_only=False)], 1)
    codes, there = codes[cut.codes].reshape(-1), there[cut.codes].reshape(-1)
    return Cut(pa.concat_arrays([word.dictionary, marks.dictionary]), codes[there], np.append(0, np.cumsum(there))[2 * cut.starts])


def cut_at_blanks(texts: pa.Array, lower: bool = False) -> Cut:
    """For tokenizers that drop white space: the parts between blanks and line ends, without their marks, and the marks.
    lower: words of Latin letters in lower case, for tokenizers that take them so anyway."""
    return _unmarked(_parted(pc.replace_substring(texts, "\n", " ")), lower)


def cut_before_blanks(texts: pa.Array) -> Cut:
    """Cuts at BEFORE_BLANK and parts marks off. A text in which a blank follows white space is cut by itself."""
    words, codes, starts = _parted(texts)
    first = starts[:-1]
    after_space = pc.match_substring_regex(words, SPACE_AT_END).to_numpy(zero_copy_only=False)[codes]
    after_space[starts[1:] - 1] = False  # the last part has no blank after it
    odd = np.flatnonzero(np.logical_or.reduceat(after_space, first)) if len(first) else []
    leading, which = np.unique(codes[first], return_inverse=True)  # the first part of a text has no blank before it
    codes[first] = len(words) + which
    chunks = pa.concat_arrays([pc.binary_join_element_wise("", words, " "), words.take(pa.array(leading))])
    if len(odd):
        place: dict[str, int] = {}
        each = np.split(codes, first[1:])
        for k in odd:
            each[k] = np.array([place.setdefault(c, len(chunks) + len(place)) for c in BEFORE_BLANK.split(texts[int(k)].as_py())])
        chunks = pa.concat_arrays([chunks, pa.array(list(place), pa.string())])
        codes, starts = np.concatenate(each), np.cumsum([0, *map(len, each)])
    return _unmarked(Cut(chunks, codes, starts))


class Coded(NamedTuple):
    """Like Cut, with the chunks' results in place of the chunks."""

    results: list
    codes: np.ndarray
    starts: np.ndarray


def groups_of(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES)))
        yield texts.slice(at, end - at)
        at = end


class ChunkMemo:
    def __init__(self, cut: Callable[[pa.Array], Cut], encode: Callable[[list[str]], list], limit: int = MEMO_CHUNKS):
        self.cut, self.encode, self.limit, self.known = cut, encode, limit, {}

    def coded(self, texts: pa.Array) -> Iterator[Coded]:
        """Groups of texts in turn, with the results of their chunks. Texts are strings without nulls."""
        for group in groups_of(texts):
            cut = self.cut(group)
            used = np.zeros(len(cut.chunks), bool)
            used[cut.codes] = True
            place = np.cumsum(used) - 1  # chunks that occur in no text go
            chunks = cut.chunks.filter(pa.array(used)).to_pylist()
            results = list(map(self.known.get, chunks))
            order = [c for c, r in zip(chunks, results, strict=True) if r is None]
            if order:
                if len(self.known) + len(order) > self.limit:
                    self.known, order = {}, chunks
                order = list(dict.fromkeys(order))
                self.known.update(zip(order, self.encode(order), strict=True))
                results = list(map(self.known.__getitem__, chunks))
            yield Coded(results, place[cut.codes], cut.starts)
            for chunk in order:
                if len(chunk) > MEMO_CHARS:
                    del self.known[chunk]

    def each(self, texts: list[str]) -> Iterator[list]:
        """For each text the results of its chunks, in order."""
        for results, codes, starts in self.coded(pa.array(texts, pa.string())):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield [results[k] for k in codes[a:b]]


def joined(results: list[bytes], codes: np.ndarray, starts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """All texts' results one after the other, and where each text's begin (and, last, where they end)."""
    taken = pa.array(results, pa.large_binary()).take(pa.array(codes))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset :][starts] if len(taken) else np.zeros(len(starts), np.int64)
    return memoryview(data or b""), at


def tokenizer_from(json_text: str):
    """A tokenizer of the tokenizers library, without truncation or padding, on the worker's one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(tokenizer) -> Callable[[list[str]], list[list[int]]]:
    return lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
