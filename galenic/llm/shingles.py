"""Word shingles of whole texts as sets of 64-bit hashes, digests and sketches of those sets, many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SKETCH_LONGS = 8
U = np.uint64
#: Bytes that are hashed at once; a longer word is hashed by itself.
SLICE_BYTES = 1 << 20
_RANDOM = np.random.Generator(np.random.Philox(20240311))
BYTE_VALUES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]  # A-Z count as a-z
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEPS = _RANDOM.integers(0, 1 << 62, 64, np.uint64) * U(4) + U(1)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE and its inverse, made as far as they are needed."""

    up = down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, SLICE_BYTES), x, U)])) for x in (BASE, INVERSE))
        return cls.up, cls.down


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word raw[first[k]:last[k]], words in order: a polynomial in its bytes, taken from running sums over all bytes of a slice."""
    out = np.empty(len(first), U)
    i = 0
    while i < len(first):  # words i, ... of one slice
        j = max(i + 1, int(np.searchsorted(last, first[i] + SLICE_BYTES, "right")))
        up, down = _Powers.upto(int(last[j - 1] - first[i]) + 1)
        sums = np.cumsum(BYTE_VALUES[raw[first[i] : last[j - 1]]] * up[: last[j - 1] - first[i]])
        sums = np.concatenate([np.zeros(1, U), sums])
        a, b = first[i:j] - first[i], last[i:j] - first[i]
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
        i = j
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and where each text's words begin. A-Z count as a-z; words part at ASCII white space."""
    if not len(texts):
        return np.empty(0, U), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(raw, first, last), np.searchsorted(first, at)


class Shingles(NamedTuple):
    """Distinct shingle hashes of some texts, in ascending order: text k's from starts[k] up to but without starts[k + 1]."""

    hashes: np.ndarray
    starts: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.starts[k] : self.starts[k + 1]]

    def nodes(self) -> np.ndarray:
        """A digest of 125 bits of each set, as two numbers, low and high: equal sets are one node."""
        wide = [xxhash.xxh3_128_intdigest(self.of(k)) >> 3 for k in range(len(self.starts) - 1)]
        return np.array([(w & (1 << 64) - 1, w >> 64) for w in wide], U).reshape(-1, 2)

    def sketches(self) -> np.ndarray:
        """One bit for each shingle's hash, XOR-ed: rows of SKETCH_LONGS."""
        n, h = len(self.starts) - 1, mix(self.hashes)
        bit = np.repeat(np.arange(n), np.diff(self.starts)) * (64 * SKETCH_LONGS) + (h % U(64 * SKETCH_LONGS)).astype(np.int64)
        parity = np.bincount(bit, minlength=n * 64 * SKETCH_LONGS) & 1
        return np.packbits(parity.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view("<u8").reshape(n, SKETCH_LONGS)


def shingled(texts: pa.Array, n: int) -> Shingles:
    """n-word shingles; fewer words than a shingle has are one shingle."""
    h, at = word_hashes(texts)
    count = np.diff(at)
    windows = np.full(max(0, len(h) - n + 1), U(n))
    for i in range(n):
        windows += h[i : len(h) - n + 1 + i] * STEPS[i]
    inside = np.arange(len(windows)) + n <= np.repeat(at[1:], count)[: len(windows)]
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.maximum(count - n + 1, count > 0))])
    out = np.empty(starts[-1], U)
    short = np.flatnonzero((count > 0) & (count < n))
    from_windows = np.ones(len(out), bool)
    from_windows[starts[short]] = False
    out[from_windows] = mix(windows[inside])
    sums = [int((h[at[k] : at[k + 1]] * STEPS[: count[k]]).sum()) for k in short]
    out[starts[short]] = mix(np.array(sums, U) + count[short].astype(U))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][starts[:-1] < len(out)]] = True
    return Shingles(out[new], np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])[starts])


def decimals(nodes: np.ndarray) -> pa.Array:
    """Digests as decimal(38,0), which Spark compares, groups and takes the least of."""
    return pa.Array.from_buffers(pa.decimal128(38), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes))])
