"""MinHash near-dedup by an LSH forest.

A set of word shingles has TREES signatures of DEPTH minima each. In a tree the sets are sorted by signature, dealt out by
ranges, so that a hot signature is split; a set's neighbour there is the one of its longest common prefix, however deep that is. Neighbours that share
BASE minima or more are compared first, and each with the first of its run; linked ones become components, so a group of copies costs a few comparisons a set.

What neighbours leave open stands in regions, the sets of a tree that share a prefix. A region of few pairs across components
is compared at the base depth, a larger one where it falls into small ones at full depth, and what even those leave
open is found by rare shingles (`rare_shingles`), which is exact. So a region's size bounds no result. Two sets of similarity s share
the base prefix in no tree with odds of (1 - s ** BASE) ** TREES: for s = 0.85 3e-7, for 0.9 3e-11. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, maybe_in, small_batches
from .jaccard_join import BUCKET_PAIRS, NODE, OF_NODE, SKETCH, Bands, _checked, _filtered, _Firsts, _signed, across, bridged, components, keyed_rows, labels_over, relabelled
from .shingles import Shingles, U, decimals, shingled

TREES, DEPTH = 32, 8
#: Minima that candidates share at least.
BASE = 6
#: Trees whose neighbours are compared first, each set with one in each tree. Groups of near copies become components here.
NEIGHBOURS = 2
#: Bytes of one minimum in a signature.
WIDTH = 2
#: Shingles whose minima are taken together, so that they stay in the processor's cache.
AT_ONCE = 1 << 16
_RANDOM = np.random.Generator(np.random.Philox(20250913))
FACTORS = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
SUMMANDS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, np.uint32)


def signatures(s: Shingles) -> np.ndarray:
    """For each set that holds anything TREES * DEPTH minima, one a row; zeros for the others."""
    out = np.zeros((len(s.starts) - 1, TREES * DEPTH), np.uint32)
    full = np.flatnonzero(np.diff(s.starts))
    h = (s.hashes >> U(32)).astype(np.uint32)
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(s.starts[full], s.starts[full[i]] + AT_ONCE)))
        a, b = s.starts[full[i]], s.starts[full[j - 1] + 1]
        some, starts, row = h[a:b], s.starts[full[i:j]] - a, np.empty(b - a, np.uint32)
        for k in range(TREES * DEPTH):
            np.multiply(some, FACTORS[k], out=row)
            np.bitwise_xor(row, SUMMANDS[k], out=row)
            out[full[i:j], k] = np.minimum.reduceat(row, starts)
        i = j
    return out


SIGNED = f"id long, hash {NODE}, n_shingles long, band int, node {NODE}, first boolean, minima binary, " + ", ".join(f"{s} long" for s in SKETCH)


def _signer(n_words: int, bands: Bands):
    """Sizes, nodes, signatures and sketches; the last two of the first text of a node in a task only, which `first` marks."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in batches:
            s = shingled(batch.column("text"), n_words)
            nodes, size = s.nodes(), np.diff(s.starts)
            first = firsts(s, nodes)
            own = Shingles(s.hashes[np.repeat(first, size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size[first])]))
            # the low bits of a minimum tell minima apart; the high ones are near zero in all
            minima = (signatures(own) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")
            place = np.cumsum(first) - 1
            block = _signed(np.where(first[:, None], s.sketches(), U(0)))
            yield pa.record_batch(
                {"id": batch.column("id"), "hash": batch.column("hash"), "n_shingles": pa.array(size), "band": pa.array(bands.own(size)), "node": decimals(nodes), "first": pa.array(first)}
                | {"minima": pa.array([minima[p].tobytes() if f else None for f, p in zip(first, place, strict=True)], pa.binary())}
                | {name: pa.array(block[:, i].copy()) for i, name in enumerate(SKETCH)}
            )

    return sign


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, signature, node, label) in order: pairs of each row with the one before it and with the first of its run, the rows
    that share BASE minima in a tree, where their labels differ. First ones keep the distances in a group of copies short."""
    carried = None  # the first row of the run that is under way, and the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        one = pa.Table.from_batches([batch])
        both = (pa.concat_tables([one.slice(0, 1), one] if carried is None else [*carried, one])).combine_chunks()
        signature = np.frombuffer(b"".join(both["signature"].to_pylist()), np.uint8).reshape(both.num_rows, DEPTH * WIDTH)[:, : BASE * WIDTH]
        tree = both["tree"].to_numpy()
        near = np.append(False, (tree[1:] == tree[:-1]) & (signature[1:] == signature[:-1]).all(1))
        place = np.arange(both.num_rows)
        head = np.maximum.accumulate(np.where(near, 0, place))
        at = place[near]
        a, b = np.append(at, at), np.append(at - 1, head[at])
        label = both["label"].combine_chunks()
        apart = pc.not_equal(label.take(pa.array(a)), label.take(pa.array(b)))
        sides = {"a": a, "b": b}
        yield pa.record_batch({name + more: both[c].combine_chunks().take(pa.array(x)).filter(apart) for more, c in (("", "node"), ("_label", "label")) for name, x in sides.items()})
        carried = [both.slice(int(head[-1]), 1), both.slice(both.num_rows - 1)]


def _neighbour_links(rows: DataFrame, texts: DataFrame, sketches: DataFrame, n_words: int, num: int, den: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the neighbours among rows (tree, signature, node, label) whose labels differ, a > b, as far as sketches let them link, and those that do with their labels."""
    in_order = rows.select("tree", "signature", "node", "label").repartitionByRange("tree", "signature", "node").sortWithinPartitions("tree", "signature", "node")
    pairs = in_order.mapInArrow(_neighbours, f"a {NODE}, b {NODE}, a_label {NODE}, b_label {NODE}")
    up = F.col("a") > F.col("b")
    either = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = pairs.select(either("a", "b", "a"), either("b", "a", "b"), either("a_label", "b_label", "a_label"), either("b_label", "a_label", "b_label")).distinct()
    pairs = space.keep(_filtered(pairs, sketches, num, den, "a_label", "b_label").drop("band"))
    return pairs.select("a", "b"), space.keep(_checked(pairs.select("a", "b"), texts, sketches, n_words, num, den, space).join(pairs, ["a", "b"]))


def _region(depth: int) -> Column:
    """A key for the sets that share a prefix in a tree."""
    return F.xxhash64(F.col("tree"), F.substring("signature", 1, depth * WIDTH))


def _in_trees(nodes: DataFrame, trees: int) -> DataFrame:
    """A row (tree, signature) of each node for each of the first trees."""
    step = DEPTH * WIDTH
    each = nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return each.withColumn("signature", F.substring("minima", F.col("tree") * step + 1, F.lit(step))).drop("minima")


def labelled_rows(docs: DataFrame, n_words: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    """One row per input row: id, n_shingles and label, which rows have in common if and only if links connect them; null for a text without words."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "forest")
    rows = keyed_rows(docs, id_column, text_column)
    signed = space.keep(rows.mapInArrow(_signer(n_words, Bands(num, den)), SIGNED))
    nodes = space.keep(signed.where("first").dropDuplicates(["node"]).select("node", *OF_NODE, "minima"))
    placed = space.keep(signed.select("id", "n_shingles", "node"))
    space.drop(signed)
    sketches = nodes.drop("minima")

    each = _in_trees(nodes.select("node", "minima", F.col("node").alias("label")), NEIGHBOURS)
    near, linked = _neighbour_links(each, rows, sketches, n_words, num, den, space)
    labels = components(linked, space)

    labelled = nodes.select("node", "minima").join(labels, "node", "left").select("node", "minima", F.coalesce("label", "node").alias("label"))
    each = _in_trees(space.keep(labelled), TREES).withColumn("key", _region(BASE))
    # regions of several components, told apart by few bits
    mark = F.hash("label").alias("mark")
    opened = each.select("key", mark).groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    opened = space.keep(opened.where(F.col("lo") != F.col("hi")).select("key"))
    side = space.keep(maybe_in(each, "key", opened, "key").join(opened, "key"))
    # neighbours in all trees of what is still apart, so that few pairs across components are left
    more, linked = _neighbour_links(side, rows, sketches, n_words, num, den, space)
    over = labels_over(linked, space)
    if over is not None:
        labels = space.keep(relabelled(labels, over))
        side = space.keep(side.join(over, "label", "left").withColumn("label", F.coalesce("upper", "label")).drop("upper"))
    near = near.unionByName(more)
    regions = space.keep(across(side))
    few, many = regions.where(F.col("pairs") <= BUCKET_PAIRS), regions.where(F.col("pairs") > BUCKET_PAIRS)
    few, crowded = few.select("key", "node", "label", "stray"), None if many.isEmpty() else many
    if crowded is not None:  # regions that are too large fall into smaller ones
        deep = space.keep(across(many.drop("stray", "pairs").withColumn("key", _region(DEPTH))))
        few = few.unionByName(deep.where(F.col("pairs") <= BUCKET_PAIRS).select("key", "node", "label", "stray"))
    labels = bridged(few, crowded, labels, near, sketches, None, rows, n_words, num, den, space)

    placed = placed.join(labels, "node", "left")
    placed = space.keep(placed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).alias("label")))
    space.drop_all_but(placed)
    return placed


def near_duplicates(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (distinct word n-grams), component_id (smallest id reachable over links) and kept
    (the id is its component's).

    Two rows link if their shingle sets' intersection is at least num / den of their union and both hold anything; found with the
    odds above. A text of fewer words than a shingle is one shingle; null and empty texts link with nothing, are their own
    component and stay. Null ids take part, a component's id ignores them, and kept is true for them only where the component has no
    other id. Repeated rows each give a row, so rows of one id and text are kept or not together. Empty tables give none.
    Columns other than id and text are not read. Texts count whole.
    """
    placed = labelled_rows(docs, n_words, num, den, id_column, text_column)
    least = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("component_id"))
    alone = placed.where(F.col("label").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    found = placed.where(F.col("label").isNotNull()).join(least, "label").select("id", "n_shingles", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_column)
