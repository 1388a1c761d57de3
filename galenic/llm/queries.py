"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .common import held_out, scratch, table
from .cross_align import align_tokenizers
from .jaccard_join import similar_components
from .language_id import identify_languages
from .license_scan import license_digest
from .lsh_forest import near_duplicates
from .mixing import mixing_digest
from .packed_ids import read_token_files, write_token_files
from .phrases import collocations
from .quality import quality_cascade
from .sp_bpe import encode_decode
from .sql import COLLOCATIONS, FOREST, NGRAM_JACCARD, QUALITY
from .token_counts import count_tokens
from .toxicity import learn, score_toxicity

TOKEN_LIMIT = 1024


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache of the query's own, which starts empty: every distinct text is encoded."""
    counts = count_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n_words=3, num=90, den=100)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.where(~held_out("doc_id")).select("text", "lang"))
    return found.withColumn("held_out", held_out("doc_id"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return score_toxicity(docs, model).withColumn("held_out", held_out("doc_id"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_token_counts, op3_quality_rules, op4_ngram_jaccard, op5_nearest, op6_mixing,
            op7_language_id, op8_token_files, op9_byte_bpe, op10_toxicity,
            op11_collocations, op12_cross_align, op13_lsh_forest,
        )
    }


def oracle_sql() -> dict[str, str]:
    """For the queries whose whole result the contract and the default rules fix; the others depend on models, tokenizers or draws."""
    return {"op3_quality_rules": QUALITY, "op4_ngram_jaccard": NGRAM_JACCARD, "op11_collocations": COLLOCATIONS, "op13_lsh_forest": FOREST}
