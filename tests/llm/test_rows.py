"""Operators that work row by row, against plain computations."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from galenic.llm import license_scan, packed_ids, quality, sp_bpe, token_counts
from galenic.llm.common import scratch, written
from galenic.llm.license_rules import ANCHORS, rules


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    at = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_license_scan(request, which):
    df = request.getfixturevalue(which)
    got = license_scan.license_digest(df).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(i, *base(t)) for i, t in texts(df)])
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_rules_have_their_anchor_and_keyword():
    assert len(rules()) > 300
    for r in rules():
        assert re.search(rf"(?:{ANCHORS})", r.regex.replace("[cs]", "s").replace("(?:", "").replace("?", "")), r
        re.compile(r.regex)


def examples(parsed):
    """All strings that a parsed rule regex matches, one of each open class."""
    out = [""]
    for op, arg in parsed:
        if str(op) == "LITERAL":
            each = [chr(arg)]
        elif str(op) == "NOT_LITERAL":
            each = ["x"]
        elif str(op) == "IN":
            each = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg]
        elif str(op) == "BRANCH":
            each = [e for b in arg[1] for e in examples(b)]
        elif str(op) == "SUBPATTERN":
            each = examples(arg[3])
        else:
            least, _, what = arg
            each = [""] * (least == 0) + [e * max(least, 1) for e in examples(what)]
        out = [a + b for a, b in product(out, each)]
    return out


def test_license_gates_lose_nothing(spark):
    found = {r.rank: examples(re._parser.parse(r.regex)) for r in rules()}
    for r in rules():
        for e in found[r.rank]:
            assert re.fullmatch(r.regex, e) and r.keyword in e and re.search(f" (?:{ANCHORS}) ", f" {e} "), (r, e)
    df = spark.createDataFrame([(k, v[0]) for k, v in found.items()] + [(-1, "AGPLv3"), (-2, "SPDX-License-Identifier: BSL-1.0"), (-3, "GPL2 only")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [got[k].labels for k in (-1, -2, -3)] == [["agpl-3.0"], ["bsl-1.0"], ["gpl-2.0-only"]]
    for k, v in found.items():
        low = f" {v[0]} "
        ungated = sorted((low[: m.start()].count(" ") - 1, r.rank) for r in rules() for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", low))
        assert sorted((d.start, d.rank) for d in got[k].detections) == ungated, v[0]


def test_license_suppression(spark):
    df = spark.createDataFrame([(1, "licensed under the Apache License, Version 2.0"), (2, "SPDX-License-Identifier: GPL-2.0-or-later"), (3, "the unlicense; nothing else"), (4, "a gpl v3 thing and MIT license")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, len(r.detections), r.n_unsuppressed) for r in license_scan.scan_licenses(df).collect()}
    assert got[1][0] == ["apache-2"] and got[1][1] > got[1][2]
    assert got[2][0] == ["gpl-2.0-or-later"]
    assert got[3][0] == ["unlicense"] and got[4][0] == ["gpl-3.0-only", "mit"]


SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    got = quality.quality_cascade(df).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *measures(t)) for i, t in texts(df)])
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_keeps_good_documents(spark, sf_dir, documents):
    got = written(quality.quality_cascade(documents), "judged").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    bad = got.where("quality = 0")
    assert bad.where("NOT kept").count() >= 0.9 * bad.count()


def test_order_of_rules_has_no_effect(spark, documents):
    m = quality.sampled(quality.measured(documents), documents.count())
    order = quality.ordered_rules(m, quality.default_rules())
    rates = [rate / max(s, 1e-6) for _, s, rate in order]
    assert rates == sorted(rates, reverse=True)
    a = written(quality.quality_cascade(documents, rules=quality.default_rules()[::-1], sample_rows=1), "judged").where("kept").select("doc_id").collect()
    assert sorted(a) == sorted(written(quality.quality_cascade(documents), "judged").where("kept").select("doc_id").collect())


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_counts(request, spark, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = P.path("byte_bpe_50k.json")
    cache = scratch(spark, "cache")
    got = token_counts.count_tokens(df, cache, path).collect()
    library = Tokenizer.from_file(path)
    same([tuple(r) for r in got], [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts(df)])
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t for _, t in texts(df)})
    # what is stored is not encoded again: a count that is put in stays
    token_counts.count_tokens(df, cache, path).count()
    assert spark.read.parquet(cache).count() == stored.count()


def test_the_cache_is_used(spark):
    path, cache = P.path("byte_bpe_50k.json"), scratch(spark, "cache")
    version = token_counts.version_of(open(path, encoding="utf-8").read())
    df = spark.createDataFrame([(1, "hello"), (2, "world"), (3, "hello")], "doc_id long, text string")
    spark.createDataFrame([(version, hashlib.sha256(b"hello").digest(), 77)], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, cache, path).collect()} == {(1, 77), (2, 1), (3, 77)}
    assert token_counts.read_cache(spark, cache, "another version").count() == 0


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_files(request, spark, which):
    import numpy as np
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    folder, path = scratch(spark, "files"), P.path("word_bpe_49k.json")
    got = packed_ids.read_token_files(spark, folder, packed_ids.write_token_files(df, folder, path)).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts(df) for ids in [[*library.encode(t, add_special_tokens=False).ids, 1]]]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    starts = [r.start for r in got]
    assert starts == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_byte_bpe(request, which):
    import tiktoken

    df = request.getfixturevalue(which)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = sp_bpe.read_ranks(open(path).read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sp_bpe.encode_decode(df, path, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    same([tuple(r) for r in got], [(i, len(e), sha(",".join(map(str, e)).encode()), sha(t.encode())) for i, t in texts(df) for e in [library.encode_ordinary(t)]])
    ids = df.select("doc_id", "text", sp_bpe.bpe_ids(path, P.PATTERN, F.col("text")).alias("ids")).collect()
    assert all(library.decode(r.ids) == (r.text or "") for r in ids)


def test_every_vocabulary_entry_is_one_token():
    ranks = sp_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken")).read())
    bpe = sp_bpe.SpBpe(ranks, P.PATTERN)
    whole = [t.decode() for t in ranks if t.decode("utf-8", "ignore").encode() == t]
    assert bpe.encode_pretokens(whole) == [[ranks[t.encode()]] for t in whole]


def test_empty_tables(spark, nothing):
    assert license_scan.license_digest(nothing).count() == 0
    assert quality.quality_cascade(nothing).count() == 0
    assert token_counts.count_tokens(nothing, scratch(spark, "cache"), P.path("byte_bpe_50k.json")).count() == 0
    folder = scratch(spark, "files")
    assert packed_ids.read_token_files(spark, folder, packed_ids.write_token_files(nothing, folder, P.path("word_bpe_49k.json"))).count() == 0
    assert sp_bpe.encode_decode(nothing, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
