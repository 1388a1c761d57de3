"""Phrase collocations and the trie that counts them, against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from galenic.llm import hat_trie, phrases


@pytest.mark.parametrize("burst, held", [(4, 40), (50, 300), (1 << 15, 1 << 22)])
def test_trie_counts(burst, held):
    """Whatever bursts and leaves, sums are right, runs are sorted, and no more is held than allowed."""
    rng = np.random.default_rng(2)
    trie, want, got = hat_trie.HatTrie(burst, held), Counter(), Counter()

    def take(runs):
        for keys, counts in runs:
            assert (np.diff(keys.astype(object)) > 0).all()
            got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))

    for n in (0, 1, 5, 100, 1000, 3000):
        keys = rng.integers(0, 1 << 64, n, np.uint64)
        keys[: n // 2] = rng.integers(0, 30, n // 2, np.uint64) << np.uint64(30)  # many under one prefix
        keys[n // 2 : n // 2 + n // 4] = np.uint64(7)
        want.update(keys.tolist())
        take(trie.add(keys))
        assert trie.size <= max(held, 0)
    take(trie.spill())
    assert got == want and trie.size == 0


def plain(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            score, cut = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if inside[p] < a:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


def mixed(spark):
    rng = random.Random(7)
    words = ["New", "york", "City", "of", "the", "é", "É", "a\tb", "x  y", "zz!", "a", "a a", ".", "\n", "中文 词", " nb", "long" * 50]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    return rows + [(None, "en"), ("", None), (None, None), ("new york city of the " * 500, "xx")] + [("ties here " * 4, "t1"), ("here ties " * 4, "t1")]


def test_collocations_are_those_of_plain_counting(spark, tmp_path, monkeypatch):
    rows = mixed(spark)
    spark.createDataFrame(rows, "text string, lang string").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for least, top in ((3, 2000), (20, 7), (1, 50)):
        got = phrases.collocations(df, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert Counter(tuple(r) for r in got.collect()) == plain(rows, least, top)


def test_a_full_filter_loses_and_adds_nothing(spark, monkeypatch):
    """Where nearly all bits are set more passes, and the exact counts decide."""
    rows = mixed(spark)[:150]
    monkeypatch.setattr(phrases, "_bitmap", lambda frequent: np.full((1 << phrases.FILTER_BITS) // 8, 255, np.uint8))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert Counter(tuple(r) for r in phrases.collocations(df, 5, 100).collect()) == plain(rows, 5, 100)


def test_empty_and_awkward_tables(nothing, awkward):
    assert phrases.collocations(nothing).count() == 0
    rows = [(r.text, r.lang) for r in awkward.select("text", "lang").collect()]
    assert Counter(tuple(r) for r in phrases.collocations(awkward, 2, 500).collect()) == plain(rows, 2, 500)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts as large as those of a very large corpus."""
    big = 3_000_000_000_000
    counts = [("en", 0, "", 9 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 5)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: spark.createDataFrame(counts, "lang string, k int, phrase string, n long"))
    got = phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert [r.score for r in got] == [1000 * (big - 5) * 9 * big // (big * (big + 1))]
