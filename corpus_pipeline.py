"""A training corpus from `documents`: five stages, each an operator of galenic.llm applied to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from galenic.llm import alphabet, jaccard_join, language_id, mixing, sp_bpe, toxicity
from galenic.llm.common import held_out, scratch, small_batches, table

#: Letters of a text from which its cosine counts: below, chance alone makes as large ones. Texts of as many letters or more whose cosine is less
#: than chance gives once in some forty times (two of its standard deviations) are in no language that was learned.
LETTERS_THAT_TELL = 200
LEAST_COSINE = 2 / language_id.DIMENSIONS**0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted to be toxic, learned from the labels of documents that aren't held out.

    Null and empty texts hold no sentence and stay, as does everything where there are no labels. Texts count whole. Repeated rows go or stay
    together. Columns are those of the input, whatever they are called; an empty table stays empty.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return docs.where(toxicity.toxicity(model, F.col("text")) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts in no language that was learned: those without a letter, those most of whose letters are none of the learned
    languages', and those of LETTERS_THAT_TELL letters or more that are unlike all languages. lang becomes the language found.

    Null and empty texts go. Short texts in learned letters stay. Of equally near languages the smaller name counts. Where nothing is labelled nothing is known,
    and all go. Texts count whole; repeated rows go or stay together. Columns are those of the input; an empty table stays empty.
    """
    small_batches(spark)
    labelled = docs.where(~held_out("doc_id")).select("text", "lang")
    prototypes, letters = language_id.learn_prototypes(labelled), alphabet.learned_letters(labelled)
    own = docs.where(~alphabet.foreign(F.col("text"), letters))
    found = own.withColumn("__found", language_id.predicted(prototypes, F.col("text")))
    alike = (F.col("__found.score") >= LEAST_COSINE) | (alphabet.n_letters(F.col("text")) < LETTERS_THAT_TELL)
    return found.where((F.col("__found.lang") != language_id.UNKNOWN) & alike).withColumn("lang", F.col("__found.lang")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect (five-word shingles, similarity of 0.8 or more) the one of the
    smallest id stays, one row of it. Null and empty texts are in no group and stay.

    A null id is larger than all; of one id's rows that of the text with the smallest hash stays. Texts count whole. Columns are those of
    the input; an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs, n_words=5, num=8, den=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be never: sources weigh 5, 2, 1, repeating.

    Null and empty texts have no words and are taken as often as their source's whole repetitions say. A null source is one of its own, the last. Equal rows
    are taken alike; reruns take the same. Texts count whole. Columns are those of the input; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id, lang and source with digests of its text's ids and of what they decode to, how many ids they are, and whether they decode to the text.

    A null text counts as the empty one, which has no ids. Texts are encoded whole; repeated rows each give a row; other columns are left out; an empty
    table gives an empty one.
    """
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    trip = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), sp_bpe.bpe_round_trip(path, pattern, F.col("text")).alias("trip"))
    return trip.select("doc_id", "lang", "source", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256", (F.col("trip.decoded_sha256") == F.col("sha")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Learned models and tokenizers decide on rows here, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
