"""The packed file format and the chunking of texts, by round trip."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import public_tokenizers as P
from galenic.llm import packed_ids as K, sp_bpe
from galenic.llm.chunks import ChunkMemo, cut_at_blanks, cut_before_blanks, ids_of, tokenizer_from


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.integers(0, 3))
def test_blocks(ids, shift):
    x = (np.array(ids, np.uint64) >> np.uint64(8 * shift)).astype(np.uint32)
    blocks = K.pack_blocks(x)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert (K.unpack_blocks(b"".join(blocks), starts) == x).all()


def test_exceptions_save_space():
    ids = np.full(128, 5, np.uint32)
    ids[7] = 4_000_000_000
    assert len(K.pack_blocks(ids)[0]) < 20


@pytest.mark.parametrize("n", [0, 1, 40])
def test_files(n):
    rng = np.random.default_rng(n)
    docs = [(None if k == 0 else k, rng.integers(0, 50_000, 0 if k % 5 == 4 else rng.integers(0, 20_000)).astype("<u4")) for k in range(n)]
    sink = pa.BufferOutputStream()
    writer = K.PackedWriter(sink)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    done = 0
    for (doc_id, ids), (got_id, start, got) in zip(docs, K.read_packed(pa.BufferReader(sink.getvalue())), strict=True):
        assert (got_id, start) == (doc_id, done) and (got == ids).all()
        done += len(ids)


ALPHABET = st.sampled_from(list("ab AB \n\t'sSÉéß中😀ﬁ1٣ ́​ 　\x1c\x85İΣ.,-<|>") + ["<|endoftext|>", "<|startoftext|>", "'ll", " 's", "  ", "\r\n", "᠎ ", "﻿ "])
TEXTS = st.lists(ALPHABET, max_size=40).map("".join)
TOKENIZERS = {"byte_bpe_50k.json": cut_before_blanks, "word_bpe_49k.json": cut_at_blanks}
LIBRARY = {name: ids_of(tokenizer_from(open(P.path(name), encoding="utf-8").read())) for name in TOKENIZERS}


@pytest.mark.parametrize("name", list(TOKENIZERS))
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_no_token_crosses_a_cut(name, text):
    memo = ChunkMemo(TOKENIZERS[name], LIBRARY[name], limit=50)
    assert [i for part in next(memo.each([text])) for i in part] == LIBRARY[name]([text])[0]


BPE = sp_bpe.SpBpe(sp_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken")).read()), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_bpe_as_the_library(text):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
    memo = ChunkMemo(cut_before_blanks, lambda chunks: [BPE.encode(c) for c in chunks])
    ids = [i for part in next(memo.each([text])) for i in part]
    assert ids == library.encode_ordinary(text) == BPE.encode(text)
    assert BPE.decode(ids) == text.encode()


def test_a_full_memory_starts_anew():
    calls = []
    memo = ChunkMemo(cut_at_blanks, lambda chunks: [calls.append(c) or c for c in chunks], limit=3)
    assert list(memo.each(["a b", "a c", "d e f", "g"])) == [["a", "b"], ["a", "c"], ["d", "e", "f"], ["g"]]
    assert len(memo.known) <= 7 and calls.count("a") == 1
