"""Cross-tokenizer alignment against a plain merge of whole texts' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from galenic.llm import chunks, cross_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n", "\t", " ", " ", " ", "　", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x00", "\r\n", "don't", "中文", "ひらがな", "😀", "👩‍👩‍👧", "é", "—", "”", "naïve", ".", ",,,", "====", "a" * 40, "İ", "﷽", "﻿", "\x1c", "\x85", "1,234", "x", "a.b", "a.\nB", "\nC", "A;", "!!a"]


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, both):
    """(n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each text by the contract's words."""
    t, sp = both
    a_bytes, b_bytes = cross_align.load(A, B).a_bytes(), cross_align.b_bytes(sp)
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b, raw = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
        if b"".join(a_bytes[x] for x in a) != raw or b"".join(b_bytes[x] for x in b) != raw:
            found.append(None)
            continue
        ends = [set(np.cumsum([len(m[x]) for x in ids]).tolist()) for ids, m in ((a, a_bytes), (b, b_bytes))]
        groups, at = [], [0, 0, 0, 0]
        for end in sorted(ends[0] & ends[1]):
            one = [[], []]
            for side, (ids, m) in enumerate(((a, a_bytes), (b, b_bytes))):
                while at[side] < len(ids) and at[2 + side] < end:
                    one[side].append(ids[at[side]])
                    at[2 + side] += len(m[ids[at[side]]])
                    at[side] += 1
            groups.append(one)
        found.append((a, b, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        a, b, groups, links = f
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), sum(n for (x, y), n in links.items() if count[x, y] == most[x]), sum(n * count[p] for p, n in links.items())))
    return out


def compared(df, both):
    got = cross_align.align_tokenizers(df, A, B)
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows], both), strict=True)]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want)


def test_given_and_awkward_tables(documents, awkward, nothing, both):
    compared(documents, both)
    compared(awkward, both)
    assert cross_align.align_tokenizers(nothing, A, B).count() == 0


@pytest.mark.parametrize("limit", [1, 100_000])
def test_segments_hold_no_token_across(both, limit, monkeypatch):
    """Odd characters in every order: segments' tokens are the whole text's."""
    monkeypatch.setattr(chunks, "GROUP_BYTES", 5000)
    rng = random.Random(3)
    texts = ["".join(rng.choice([*ODD, " ", " ", "word", " the"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    aligner = cross_align.SegmentMemo(cross_align.Aligner(cross_align.load(A, B)), limit)
    rows = [r for out in cross_align._aligned_groups(aligner, pa.array(range(len(texts))), pa.array([" " + t for t in texts]), 0) for r in out.to_pylist() if r["id"] is not None]
    want = plain(texts, both)
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows] == [w[:5] for w in want]
    assert sum(w[0] > 0 for w in want) > 500


def test_groups_of_many_tokens(both, monkeypatch):
    monkeypatch.setattr(cross_align, "LARGE_GROUP", 2)
    aligner = cross_align.Aligner(cross_align.load(A, B))
    texts = [" 中文😀中文😀", " ====----====", " İstanbul'da"]
    few = aligner(texts)
    monkeypatch.setattr(cross_align, "LARGE_GROUP", 1 << 40)
    assert all(np.array_equal(x, y) for x, y in zip(few, aligner(texts), strict=True))


def test_lockstep_cuts_where_both_end():
    rng = np.random.default_rng(1)
    lanes = [[np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in "ab"] for n in rng.integers(1, 60, 200)]
    starts = [np.cumsum([0, *[len(x[s]) for x in lanes]]) for s in (0, 1)]
    got = cross_align.lockstep(*[y for s in (0, 1) for y in (np.concatenate([x[s] for x in lanes]), starts[s])])
    for k, (a, b) in enumerate(lanes):
        mine = got[0] == k
        assert a[got[2][mine] - starts[0][k] - 1].tolist() == b[got[4][mine] - starts[1][k] - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
