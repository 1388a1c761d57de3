"""Mixing sources to target weights by capped water-filling, and seeded sampling of the repetitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of, written

#: Weights of the sources in order of their names' code points, null last, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20240501
#: Leading bits of the draw that make its ranges. Words are summed by range, so that no task sorts a whole source.
RANGE_BITS = 20
#: Documents before and after the end of a source's fractional repetition that are chosen one by one; besides, a range's at most.
EDGE_DOCS = 1000


def word_count(text: Column) -> Column:
    joined = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def water_levels(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to one row per source (source, source_size): its weighted share of all sizes, at most
    max_epochs times its size, with the excess of clamped sources shared out by weight until none is above.

    In ascending order of cap over weight, clamping the first k leaves the rest a level; the sources that end
    up clamped are those whose own cap over weight is below the level once all before them are clamped. The first of
    the others has the final level; what the later ones would give is lower.
    The window runs over sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    caps = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = caps.withColumn("own_level", level).withColumn("clamped", F.col("cap") / F.col("weight") < level)
    final = F.coalesce(F.max(F.when(~F.col("clamped"), F.col("own_level"))).over(everything), F.lit(float("inf")))
    return levels.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * final).alias("target"))


def _closest(edge: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents at the edge, in order of their draw, those that still fit into the words wanted;
    then up to three exchanges that bring the sum nearer."""
    edge = edge.sort_values("draw", kind="stable").reset_index(drop=True)
    left = float(edge["wanted"].iat[0] - edge["before"].iat[0]) if len(edge) else 0.0
    more = []
    for size in edge["size"].tolist():
        fits = 0 < size <= left
        more.append(int(fits))
        left -= size * fits
    size, taken = edge["size"].to_numpy(float), np.array(more, bool)
    for _ in range(3):  # one more document, or one for another, if the sum comes nearer
        out = np.flatnonzero(~taken & (size > 0))
        if not len(out):
            break
        had = np.append(np.flatnonzero(taken), -1)  # -1: none is given up
        given = np.where(had >= 0, size[had], 0.0)
        out = out[np.argsort(size[out], kind="stable")]
        place = np.searchsorted(size[out], left + given)
        near = np.stack([np.maximum(place - 1, 0), np.minimum(place, len(out) - 1)])  # for each the next smaller and the next larger one
        gain = size[out][near] - given
        which, b = np.unravel_index(np.abs(left - gain).argmin(), gain.shape)
        if abs(left - gain[which, b]) >= abs(left):
            break
        left -= gain[which, b]
        taken[out[near[which, b]]] = True
        if had[b] >= 0:
            taken[had[b]] = False
    edge["more"] = taken.astype(int)
    return edge[["source", "draw", "more"]]


def mixed(docs: DataFrame, keep: list[str], source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per input row: struct `row` of the columns to keep, size, source_size, target and times, how often the mix takes it.

    Each document has floor(target / source_size) whole repetitions. Of each source, one more goes to the documents
    that come first by a seeded draw, as far as the words still wanted reach; where they end, EDGE_DOCS on either side
    are chosen so that the sum comes close. So a source misses its target by half a small document's size.

    Sizes count words of whole texts, null as empty; empty texts are taken as their source's whole repetitions say, at
    size 0, and no more. A null source is a source. Equal rows have one draw and are taken alike. Extra columns
    don't matter. An empty table gives no rows. Reruns give the same.
    """
    text = text_of(text_column)
    draw = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"), F.xxhash64(text))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source_column).alias("source"), word_count(text).alias("size"), draw.alias("draw"))
    if text_column in keep:  # texts are not written again, but counted again
        thin = written(rows.select("source", "size", "draw"), "sizes")
    else:
        rows = thin = written(rows, "sizes")
    in_range = F.shiftrightunsigned("draw", 64 - RANGE_BITS)
    ranges = written(thin.groupBy("source", in_range.alias("range")).agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("n")), "ranges")
    levels = water_levels(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    levels = levels.withColumn("whole", F.least(F.floor(epochs), F.lit(max_epochs)).cast("int"))
    levels = levels.withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumnRenamed("source", "s")
    # of each source the range in which its fractional repetition ends, and those shortly before and after it: the edge
    upto = Window.partitionBy("source").orderBy("range")
    run = ranges.select("source", "range", "range_size", F.sum("range_size").over(upto).alias("words"), "n", F.sum("n").over(upto).alias("docs"))
    run = run.join(_fit(levels.select("s", "wanted")), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    ends = F.min(F.when(F.col("words") > F.col("wanted"), F.struct("range", "docs"))).over(Window.partitionBy("source"))
    run = run.withColumn("end", ends).where((F.col("docs") > F.col("end.docs") - EDGE_DOCS) & (F.col("docs") - F.col("n") < F.col("end.docs") + EDGE_DOCS))
    edges = run.groupBy("source").agg(F.min("range").alias("first"), F.max("range").alias("last"), F.min(F.col("words") - F.col("range_size")).alias("before"))
    plan = written(levels.join(edges, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "plan")
    placed = rows.withColumn("range", in_range).join(_fit(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_edge = F.col("range").between(F.col("first"), F.col("last"))
    near = thin.withColumn("range", in_range).join(_fit(plan), F.col("source").eqNullSafe(F.col("s"))).where(at_edge)
    near = near.groupBy("source", "draw").agg(F.sum("size").cast("double").alias("size"), F.first("wanted").alias("wanted"), F.first("before").cast("double").alias("before"))
    source_type = thin.schema["source"].dataType.simpleString()
    chosen = near.groupBy("source").applyInPandas(_closest, f"source {source_type}, draw long, more int")
    chosen = chosen.select(F.col("source").alias("s"), F.col("draw").alias("d"), "more")
    inside = placed.where(at_edge).join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d"))).drop("s", "d")
    outside = placed.where(~F.coalesce(at_edge, F.lit(False)))
    outside = outside.withColumn("more", ((F.col("size") > 0) & F.coalesce(F.col("range") < F.col("first"), F.col("wanted") > 0)).cast("int"))
    both = outside.unionByName(inside)
    return both.select("row", "size", "source_size", "target", F.least(F.col("whole") + F.col("more"), F.lit(max_epochs)).alias("times"))


#: A plan has a row per source; up to this many it is sent to all executors, beyond that it is joined by shuffling.
MOST_BROADCAST_SOURCES = 10_000


def _fit(plan: DataFrame) -> DataFrame:
    few = len(plan.select("s").limit(MOST_BROADCAST_SOURCES + 1).take(MOST_BROADCAST_SOURCES + 1)) <= MOST_BROADCAST_SOURCES
    return F.broadcast(plan) if few else plan


def mixing_digest(docs: DataFrame) -> DataFrame:
    """The contract row per document: doc_id, size, source_size, target and taken, the words that the mix takes of it."""
    rows = mixed(docs, ["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of the input."""
    rows = mixed(docs, docs.columns)
    repeated = rows.where(F.col("times") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("row.*")
