"""Operators that compare or learn from rows, against brute force or held-out labels."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galenic.llm import ann, jaccard_join, language_id, lsh_forest, mixing, rare_shingles, toxicity
from galenic.llm import shingles as shingle_sets
from galenic.llm.common import held_out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.fixture(params=[1 << 20, 2])
def bucket_pairs(request, monkeypatch):
    """With 2 nearly every bucket goes by rare shingles."""
    monkeypatch.setattr(jaccard_join, "BUCKET_PAIRS", request.param)
    monkeypatch.setattr(lsh_forest, "BUCKET_PAIRS", request.param)


def families(spark):
    """Texts of a few sizes, each with edits of it and edits of those, near the threshold on both sides."""
    rng = np.random.default_rng(3)
    rows = []
    for f, size in enumerate((1, 2, 3, 8, 12, 19, 40, 90, 250, 900)):
        base = [f"f{f}w{i}" for i in range(size)]
        for _ in range(7):
            w = list(base)
            for at in rng.integers(0, size, rng.integers(0, 1 + size // 12)):
                w[at] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(w)))
            base = w if rng.random() < 0.3 else base
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 8, 10)])
def test_links_are_those_of_brute_force(spark, tmp_path, bucket_pairs, k, num, den):
    families(spark).write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    want = components([(r.doc_id, r.text) for r in df.collect()], k, num, den)
    assert Counter(tuple(r) for r in jaccard_join.similar_components(df, k, num, den).collect()) == want
    forest = lsh_forest.near_duplicates(df, k, num, den).collect()
    assert Counter(tuple(r)[:3] for r in forest) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in forest)


@pytest.mark.parametrize("num, den", [(90, 100), (85, 100), (8, 10), (1, 2)])
def test_linked_sets_share_a_rare_key(num, den):
    rng = np.random.default_rng(8)
    starts = rare_shingles.size_bands(num, den)
    frequency = rng.integers(0, 5, 1 << rare_shingles.RARITY_BITS).astype(np.uint16)
    for size in (1, 2, 3, 7, 20, 61, 300, 1500):
        for _ in range(30):
            one, both = rng.integers(0, 1 << 63, 2 * size, np.uint64), int(size * (num / den + rng.random() * (1 - num / den)))
            a, b = one[:size], np.concatenate([one[:both], one[size : size + rng.integers(0, size - both + 1)]])
            linked = den * both >= num * len(set(a.tolist()) | set(b.tolist()))
            two = shingle_sets.Shingles(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
            keys = [set(zip(*(x.tolist() for x in rare_shingles.set_keys(two, k, frequency, starts, num, den)), strict=True)) for k in (0, 1)]
            assert not linked or {(k, -r % 3) for k, r in keys[0]} & keys[1]
            assert all(len(k) <= 6 * len(two.of(i)) + 40 for i, k in enumerate(keys))


def test_awkward_rows_link_as_they_should(awkward):
    got = jaccard_join.similar_components(awkward, 3, 90, 100).collect()
    assert Counter(tuple(r) for r in got) == components([(r.doc_id, r.text) for r in awkward.collect()], 3, 90, 100)


def test_pieces_and_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    crowded = rng.integers(0, 2, 1 << jaccard_join.CELL_BITS).astype(np.int8)
    for num, den in ((9, 10), (8, 10)):
        bands = jaccard_join.Bands(num, den)
        for _ in range(60):
            n = int(rng.integers(9, 400))
            a = np.unique(rng.integers(0, 2**63, n, np.int64).astype(np.uint64))
            spare = n * (den - num) // (den + num)
            b = np.unique(np.concatenate([a[spare:], rng.integers(0, 2**63, int(rng.integers(0, spare + 1)), np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            differing = len(a) + len(b) - 2 * both
            two = jaccard_join.Shingles(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            wide = [{w["band"]: w["bits"] for w in jaccard_join.wide_sketches(k, bands)} for k in (a, b)]
            for band in wide[0].keys() & wide[1].keys():
                assert sum(int(w).bit_count() for w in (wide[0][band] ^ wide[1][band]).view(np.uint64)) <= differing
            assert bool(wide[0]) == (len(a) > jaccard_join.WIDE_FROM)
            x = two.sketches()
            assert sum(int(w).bit_count() for w in x[0] ^ x[1]) <= differing
            for cells in (None, crowded):
                p = jaccard_join.pieces(two, bands, cells)
                used = p.ranks < p.needed
                if den * both >= num * (len(a) + len(b) - both) and differing:
                    assert set(p.keys[used & (p.sets == 0)].tolist()) & set(p.keys[used & (p.sets == 1)].tolist())


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_shingles_are_those_of_the_words(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(shingle_sets, "SLICE_BYTES", size)
    texts = ["", " \n", "a", "A b", "b a", "The the THE the the", "x" * 5000 + " y", "ünï a\x0bb\x1cc d", "İ É é", "one two three four", "one two\tthree\x0cFOUR "]
    some = pa.array(["cut off", *texts], pa.string()).slice(1)
    for k in (3, 5):
        got = jaccard_join.shingled(some, k)
        sets = [shingles(t, k) for t in texts]
        assert np.diff(got.starts).tolist() == [len(s) for s in sets]
        of = [set(got.of(i).tolist()) for i in range(len(texts))]
        assert [[len(a & b) for b in of] for a in of] == [[len(a & b) for b in sets] for a in sets]
        assert (got.nodes()[9] == got.nodes()[10]).all() and got.of(9).tolist() == sorted(got.of(9).tolist())
    assert len(jaccard_join.shingled(some.slice(0, 0), 3).hashes) == 0


def test_nearest(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet")
    got = ann.nearest(e, F.col("vec_id") % 50 == 0, block_rows=100, block_queries=4).collect()
    rows = e.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        want |= {(ids[q], ids[i]) for i in np.argsort(-s)[:5]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert Counter(r.rank for r in got) == Counter({k: 10 for k in range(1, 6)})


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.9, 0.1], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"), (5, [None, 1.0], "x"), (None, [1.0, 0.0], "x"), (6, [0.9, 0.1], "x"), (7, [-1.0, 0.0], "x"), (50, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 6), (0, 3, 7)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix(spark, awkward, sf_dir):
    larger = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    for df in (awkward, larger):
        got = mixing.mixing_digest(df).collect()
        sizes = {}
        for r in df.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, open_, left = {}, set(order), float(sum(sizes.values()))
        while open_:
            level = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
            for s in over or open_:
                target[s] = 3.0 * sizes[s] if over else weight[s] * level
            left -= sum(target[s] for s in over)
            open_ = open_ - over if over else set()
        source = {r.doc_id: r.source for r in df.collect()}
        assert len(got) == df.count() and all(r.taken <= 3 * r.size for r in got)
        times = Counter(x.doc_id for x in got)
        for r in got:
            if times[r.doc_id] == 1:
                assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        if df is larger:
            for s in order:
                assert sum(r.taken for r in got if source[r.doc_id] == s) == pytest.approx(target[s], rel=0.02)
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixing_digest(df.repartition(3)).collect()))


def test_the_mix_has_the_documents_as_often_as_it_says(documents):
    times = {r.doc_id: r.times for r in mixing.mixing_digest(documents).collect()}
    mix = mixing.mixed_documents(documents)
    assert mix.columns == documents.columns
    assert Counter(r.doc_id for r in mix.select("doc_id").collect()) == Counter({k: v for k, v in times.items() if v})


def test_languages(spark, awkward, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.identify_languages(docs, docs.where(~held_out("doc_id")).select("text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id"))
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify_languages(awkward, awkward.select("text", "lang")).collect()}
    assert {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)} <= got and all(0 <= s <= 1 for _, _, s in got)
    assert {r.lang_pred for r in language_id.identify_languages(awkward, awkward.select("text", "lang").limit(0)).collect()} == {"und"}


def test_toxicity(spark, awkward, nothing, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, labels, ~held_out("doc_id"))
    found = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(held_out("doc_id")).collect()
    hit = sum(r.predicted and r.toxic for r in found)
    assert hit >= 0.8 * sum(r.toxic for r in found) and hit >= 0.9 * sum(r.predicted for r in found)
    where = spark.createDataFrame([(1, "the thing is here. what an idiot and moron he is. and more")], "doc_id long, text string")
    assert [x.number for x in where.select(toxicity.offending_sentences(model, F.col("text")).alias("s")).first().s] == [1]
    odd = toxicity.score_toxicity(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.score_toxicity(nothing, toxicity.learn(nothing, labels.limit(0), F.lit(True))).count() == 0


def test_toxicity_learns_from_the_end_of_a_long_text(spark):
    plain = "The weather was fair and they walked home along the river. "
    rows = [(i, plain * 300 + ("You are a vile grobnik." if i % 2 else "That was a quiet evening.")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {i: i % 2 for i in range(60)}
    assert [x.number for x in docs.where("doc_id = 1").select(toxicity.offending_sentences(model, F.col("text")).alias("s")).first().s] == [300]


def test_toxicity_samples_one_text_of_an_id_in_any_order(spark):
    rows = [(0, f"copy {i % 3} of a plain note") for i in range(300)] + [(i, f"note {i}") for i in range(1, 9)]
    labels = spark.createDataFrame([(i, int(i > 4)) for i in range(9)], "doc_id long, toxic int")

    def sample(rows, parts):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return sorted(tuple(r) for r in toxicity.sampled_texts(docs, labels, F.lit(True), of_each=5).collect())

    got = sample(rows, 1)
    assert [(k, t) for k, t, _ in got] == [(i, int(i > 4)) for i in range(9)] and got == sample(rows[::-1], 5)


def test_pipeline_stages_keep_the_columns(spark, documents, sf_dir):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "ngram_jaccard_join", "mixing", "byte_bpe"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("NOT round_trip").count() == 0 and 0 < out.select("doc_id").distinct().count() <= documents.count()
    kept = corpus_pipeline.drop_near_copies(spark, documents, sf_dir)
    assert kept.columns == documents.columns
    groups = jaccard_join.similar_components(documents, 5, 8, 10)
    assert kept.count() == groups.select("component_id").distinct().count()


def test_long_clean_texts_are_not_toxic(spark):
    """Length alone, repetition and words that the labels say nothing about leave a text clean."""
    rng = np.random.default_rng(2)
    words = [f"wort{i}" for i in range(3000)]
    clean = lambda n: ". ".join(" ".join(rng.choice(words, 8)) for _ in range(n))
    rows = [(i, clean(20) + (". you vile grobnik you. " if i % 2 else ". ") + clean(20)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    long = spark.createDataFrame([(1, clean(2500)), (2, clean(25_000)), (3, "the same harmless sentence. " * 20_000), (4, clean(2500) + ". vile grobnik you. " + clean(2500))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(long, model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}
    features = toxicity.WordFeatures(model.weights != 0)
    for r in toxicity.score_toxicity(docs, model).join(docs, "doc_id").collect():
        none = 1.0
        for bag in {tuple(b) for b in toxicity._bags(r.text, features) if b}:
            p = 1 / (1 + np.exp(-sum(model.weights[f] for f in bag) - model.bias))
            none *= 1 - max(p - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR)
        assert r.score == pytest.approx(1 - none, abs=1e-9)


def test_language_is_the_prototype_of_the_largest_cosine(documents):
    prototypes = language_id.learn_prototypes(documents.select("text", "lang"))
    binder, names = language_id.Binder(), list(prototypes)
    for r in language_id.identify_languages(documents, documents.select("text", "lang")).join(documents.select("doc_id", "text"), "doc_id").limit(60).collect():
        v = binder.bundle(r.text or "").astype(float)
        if v.any():
            cosines = [v @ prototypes[n] / np.linalg.norm(v) / np.linalg.norm(prototypes[n]) for n in names]
            assert r.lang_pred == names[int(np.argmax(cosines))] and r.score == pytest.approx(max(cosines), abs=1e-5)


def test_nearest_of_repeated_rows_other_lengths_and_extreme_norms(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 1e-300]), (4, [-1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.5]), (6, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    half = round(0.5**0.5, 9)
    one = [(0, 1, 0, 1.0), (0, 2, 2, 1.0), (0, 3, 6, 1.0), (0, 4, 1, half), (0, 5, 3, 0.0)]
    assert got == sorted(one + one + [(50, 1, 5, round((14 + 1.5) / (14**0.5 * 17.25**0.5), 9))])


def test_one_of_each_group_stays(spark):
    """Null, repeated and clashing ids: one row of each group of near copies, all rows without words."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text, "b"), (None, text, "c"), (2, "quite another text of some six words", "d"), (None, "words that nobody else has written here", "e"), (3, text + " more", "f"), (1, text, "a"), (4, None, "g"), (4, "", "h"), (4, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r.hash for r in kept.collect())
    assert got == ["a", "d", "e", "g", "g", "h"]
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_texts_of_one_template_stay_in_proportion(spark):
    """Texts that share a template and have enough of their own (here each changes 30 of 300 words) make few candidate pairs."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(300)]

    def text(i):
        w = list(base)
        for at in rng.choice(300, 30, replace=False):
            w[at] = f"x{i}_{at}"
        return " ".join(w)

    bands, of_each = jaccard_join.Bands(90, 100), []
    for n in (1500, 3000):  # candidates for each text stay as many while the family grows
        df = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
        cells = jaccard_join.crowded_cells(df.select("text"), 3, bands)
        keys = df.select("text").mapInArrow(jaccard_join._keyer(3, bands, cells), f"key long, node {jaccard_join.NODE}").groupBy("key").count()
        of_each.append(keys.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] / n)
    assert of_each[1] < 1.3 * of_each[0]
    assert jaccard_join.similar_components(df, 3, 90, 100).select("component_id").distinct().count() == 3000


def test_texts_of_one_template_meet_by_rare_shingles_in_proportion(spark):
    """Each changes 10 of 300 words, too few for pieces of its own, and too many to link."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(300)]

    def text(i):
        w = list(base)
        for at in rng.choice(300, 10, replace=False):
            w[at] = f"x{i}_{at}"
        return " ".join(w)

    of_each = []
    for n in (1500, 3000, 6000):
        df = spark.createDataFrame([(i, text(i)) for i in range(n)], "node long, text string").repartition(8)
        keys = rare_shingles.rare_keys(df, 3, 90, 100).groupBy("key").count()
        of_each.append((keys.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0) / n)
    assert of_each[2] < 1.3 * of_each[0] + 1
    found = jaccard_join.similar_components(df.withColumnRenamed("node", "doc_id"), 3, 90, 100)
    assert found.select("component_id").distinct().count() == 6000
