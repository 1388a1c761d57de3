"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: their signs after a rotation that is learned on a sample so that signs lose little.
A code is cut into m substrings, each with an index: rows by the substring's value. If two codes differ in at most
r = m * s + a bits, then one of the first a + 1 substrings differs in at most s bits or one of the others in at most s - 1;
probing the buckets of those values finds every code within radius r. What is found is ranked by exact cosines of the original vectors.

Queries and vectors meet in blocks of bounded size: a block of vectors holds its own indexes, and each block of queries
probes each block of vectors once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Vectors on which rotation and radius are learned, at most; queries of the sample for the radius.
SAMPLE_ROWS = 8000
SAMPLE_QUERIES = 400
#: Share of the sample's true neighbours that the radius is to reach.
REACH = 0.96
SUBSTRING_BITS = 16
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
#: Probed at once by one block.
QUERIES_AT_ONCE = 64
POPCOUNT = np.array([i.bit_count() for i in range(1 << SUBSTRING_BITS)], np.uint8)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one: angles stay exactly, and squares of very large
    and very small components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Hasher:
    """Binary codes: centred, rotated, signs. Learned by alternating between the signs and the best rotation onto them."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 3):
        x = unit(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        rng = np.random.default_rng(seed)
        self.bits = -(-x.shape[1] // SUBSTRING_BITS) * SUBSTRING_BITS
        self.rotation = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0][: x.shape[1]]
        for _ in range(rounds):
            signs = np.where(x @ self.rotation > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ signs, full_matrices=False)
            self.rotation = u @ v
        self.radius = self.bits

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One integer for each substring."""
        return np.packbits((unit(vectors) - self.mean) @ self.rotation > 0, axis=1).view(">u2").astype(np.int64)

    def learn_radius(self, sample: np.ndarray, k: int, queries: int = SAMPLE_QUERIES, reach: float = REACH) -> None:
        """The distance within which the given share of sampled queries' k nearest lie. A whole table is denser than
        a sample of it, so its neighbours are nearer and the share there is larger."""
        x = unit(sample)
        q = np.arange(min(queries, len(x)))
        near = x[q] @ x.T
        near[q, q] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        codes = self.codes(sample)
        far = POPCOUNT[codes[q][:, None] ^ codes[top]].sum(-1)
        self.radius = int(np.quantile(far, reach, method="higher"))


class Indexes:
    """For each substring the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, starts = np.unique(codes[order, s], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    def probe(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every pair of codes within the radius: of each substring's index the buckets whose value is near enough
        are opened, and what they hold is compared as a whole."""
        m = self.codes.shape[1]
        least, more = divmod(radius, m)
        found = np.zeros((len(queries), len(self.codes)), bool)
        for s, (order, values, starts) in enumerate(self.tables):
            at_q, bucket = np.nonzero(POPCOUNT[queries[:, s][:, None] ^ values] <= (least if s <= more else least - 1))
            n = starts[bucket + 1] - starts[bucket]
            rows = order[np.arange(n.sum()) + np.repeat(starts[bucket] - (np.cumsum(n) - n), n)]
            found[np.repeat(at_q, n), rows] = True
        at_q, at_x = np.nonzero(found)
        near = POPCOUNT[queries[at_q] ^ self.codes[at_x]].sum(1, dtype=np.int64) <= radius
        return at_q[near], at_x[near]


def learn_hasher(vectors: DataFrame, k: int, rows: int = SAMPLE_ROWS) -> Hasher:
    """From at most `rows` vectors, those of the smallest hash of id and vector. There must be one."""
    picked = vectors.select("vector", F.xxhash64(F.col("id").cast("string"), F.xxhash64("vector")).alias("h")).orderBy("h").limit(rows).select("vector")
    sample = np.array([r[0] for r in picked.collect()], float)
    hasher = Hasher(sample)
    hasher.learn_radius(sample, k)
    return hasher


def _search(hasher: Hasher, k: int):
    def search(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not len(queries) or not len(rows):
            return pd.DataFrame(columns=names)
        own, ids = rows["row"].to_numpy(), rows["id"].to_numpy()
        x = scaled(np.stack(rows["vector"].to_numpy()).astype(float))
        norms = np.linalg.norm(x, axis=1)
        indexes = Indexes(hasher.codes(x))
        out = []
        for i in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries.iloc[i : i + QUERIES_AT_ONCE]
            q_row, q_id = some["row"].to_numpy(), some["id"].to_numpy()
            q = scaled(np.stack(some["vector"].to_numpy()).astype(float))
            q_norms = np.linalg.norm(q, axis=1)
            probe = hasher.codes(q)
            open_, radius = np.arange(len(q)), hasher.radius
            while len(open_):
                at_q, at_x = indexes.probe(probe[open_], radius)
                other = q_row[open_[at_q]] != own[at_x]
                at_q, at_x = at_q[other], at_x[other]
                enough = np.bincount(at_q, minlength=len(open_)) >= k
                if radius >= hasher.bits:
                    enough[:] = True
                keep = enough[at_q]
                at_q, at_x = open_[at_q[keep]], at_x[keep]
                score = np.einsum("ij,ij->i", q[at_q], x[at_x]) / (q_norms[at_q] * norms[at_x])
                order = np.lexsort((ids[at_x], -score, at_q))
                at_q, at_x, score = at_q[order], at_x[order], score[order]
                best = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
                out.append(pd.DataFrame({"query_row": q_row[at_q[best]], "query_id": q_id[at_q[best]], "vec_id": ids[at_x[best]], "score": score[best]}))
                open_, radius = open_[~enough], min(hasher.bits, radius + probe.shape[1])  # too few within the radius: probe further
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    return search


def _of_length(rows: DataFrame, n: int, n_queries: int, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """query_row, query_id, vec_id, score: each query's k nearest of each block, for vectors of one length."""
    hasher = learn_hasher(rows, k)
    row_blocks, query_blocks = -(-n // block_rows), -(-n_queries // block_queries)
    spread = F.xxhash64(F.lit(5), "row")
    blocks = rows.select("row", "id", "vector", "is_query", F.pmod(spread, F.lit(row_blocks)).cast("int").alias("row_block"), F.pmod(F.shiftright(spread, 7), F.lit(query_blocks)).cast("int").alias("query_block"))
    asked = blocks.where("is_query").select("row", "id", "vector", "query_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"))
    there = blocks.select("row", "id", "vector", "row_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    keys = ["query_block", "row_block"]
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_search(hasher, k), "query_row long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row for which `queries` holds, among all other rows;
    ties go to the smaller id.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite components take no part. All others
    are indexed. Vectors have an angle with vectors of their own length only, so each length is searched by itself. A row
    that is repeated is found as often, also by its equals, and each copy is a query of its own: one of an id
    that two rows share has ranks 1 to k twice. A query with fewer than k other rows gets those. Components may be as
    large or small as doubles are. Empty tables give none. Columns other than id and vector are not read.
    """
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = written(rows, "vectors")  # so that a row keeps its number
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).where(F.col("q") > 0).collect()
    found = [_of_length(rows.where(F.size("vector") == x.length), x.n, x.q, k, block_rows, block_queries) for x in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = written(every, "found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
