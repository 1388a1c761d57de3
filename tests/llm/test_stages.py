"""The pipeline's stages on odd, repeated, empty and clashing rows, and what they keep."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from galenic.llm import alphabet


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name, stage", P.STAGES[:2] + P.STAGES[3:])
def test_stages_on_odd_and_empty_tables(spark, awkward, nothing, sf_dir, name, stage):
    """Rows in are rows out, as they were but for lang, in at most the multiplicity the stage says; an empty table gives an empty one of the same columns."""
    got = stage(spark, awkward, sf_dir)
    assert stage(spark, nothing, sf_dir).count() == 0
    if name == "byte_bpe":
        assert got.count() == awkward.count() and got.where("NOT round_trip").isEmpty()
        return
    assert got.columns == awkward.columns
    kept = [c for c in awkward.columns if not (name == "language_id" and c == "lang")]
    have, found = rows(awkward.select(*kept)), rows(got.select(*kept))
    assert set(found) <= set(have)
    assert name == "mixing" or all(n <= have[r] for r, n in found.items())


def test_no_labels_reject_nothing(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert rows(P.drop_toxic(spark, awkward, str(tmp_path))) == rows(awkward)


@pytest.fixture(scope="module")
def mixed_up(spark, documents):
    """Clean texts of all lengths, short ones, and ones in alphabets that nothing is learned from."""
    other = ["Быстрая коричневая лиса прыгает через ленивую собаку", "Да", "敏捷的棕色狐狸跳过了懒狗", "η γρήγορη καφέ αλεπού " * 50, "12345 !!", "", None]
    short = ["Merci beaucoup", "Revenue 2023", "Ja", "été"]
    extra = spark.createDataFrame([(10_000_000 + 5 * i, t) for i, t in enumerate([*other, *short])], "doc_id long, text string")
    some = documents.select("doc_id", "text", "lang", "source", "n_chars")
    return some.unionByName(extra, allowMissingColumns=True), other, short


def test_unknown_alphabets_go_and_short_clean_texts_stay(spark, mixed_up, sf_dir):
    docs, other, short = mixed_up
    kept = {r.text for r in P.drop_unknown_language(spark, docs, sf_dir).where("doc_id >= 10000000").select("text").collect()}
    assert kept == set(short)


def test_nearly_all_given_documents_stay(spark, documents, sf_dir):
    with_letters = documents.where(F.col("text").rlike(r"\p{L}"))
    assert P.drop_unknown_language(spark, documents, sf_dir).count() >= 0.995 * with_letters.count()


def test_letters_of_a_rare_language_are_learned(spark):
    texts = [("plain words", "en")] * 500 + [("слово", "ru"), ("слова", "ru"), ("γ", "en"), ("δ", None), (None, "el")]
    letters = alphabet.learned_letters(spark.createDataFrame(texts, "text string, lang string"))
    assert set("plainwords") <= set(letters) and set("слов") <= set(letters) and not set("γδ") & set(letters)
    one = alphabet.learned_letters(spark.createDataFrame([("ß", "de")], "text string, lang string"))
    assert one == "ß" and alphabet.learned_letters(spark.createDataFrame([], "text string, lang string")) == ""
