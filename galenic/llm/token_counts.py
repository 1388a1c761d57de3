"""Token counts through a digest cache: only distinct texts that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import ChunkMemo, cut_before_blanks, ids_of, tokenizer_from
from .common import small_batches, text_of

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def version_of(tokenizer_json: str) -> str:
    return hashlib.sha256(tokenizer_json.encode()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version, or None where no cache has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops what a task has already passed on: of a text that a third of all rows share, a task sends one."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encoder(tokenizer_json: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_from(tokenizer_json))
        memo = ChunkMemo(cut_before_blanks, lambda chunks: [len(x) for x in ids(chunks)])
        seen: set[bytes] = set()
        for batch in batches:
            new = {}
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    new[digest] = text
            counts = [np.add.reduceat(np.array(results, np.float64)[codes], starts[:-1]) for results, codes, starts in memo.coded(pa.array(new.values(), pa.string()))]
            n_tokens = np.concatenate([np.empty(0), *counts]).astype(np.int64)
            yield pa.record_batch({"version": pa.array([version] * len(new)), "digest": pa.array(list(new), pa.binary()), "n_tokens": pa.array(n_tokens)})

    return encode


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, as the tokenizers library counts them for the file's tokenizer.

    It must be a byte-level tokenizer whose pattern starts a match at a blank and at a mark after a letter. Texts are normalised only by taking
    null as empty, for any other change could change the count. The cache is a table of counts by text digest and
    tokenizer version in `cache_path`; texts that it lacks are encoded, each once, and appended. One writer at a time
    may use a cache.

    Repeated rows each give a row; an empty table gives none, and appends none. Columns other than id and text are
    not read. A text is counted whole, however long.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    version = version_of(tokenizer_json)
    keyed = docs.select(F.col(id_column), text_of(text_column).alias("text"))
    keyed = keyed.select(F.col(id_column).alias("id"), "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    missing = keyed.select("digest", "text")
    stored = read_cache(spark, cache_path, version)
    if stored is not None:
        missing = missing.join(stored, "digest", "left_anti")
    apart = missing.mapInArrow(_first_of_each, "digest binary, text string").repartition("digest")
    apart.mapInArrow(_encoder(tokenizer_json, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    lengths = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return lengths.join(counts, "digest").select(F.col("id").alias(id_column), "n_bytes", "n_tokens")
