"""N-gram Jaccard join by parity sketches.

Each text's word shingles are hashed to 64 bits. XOR-ing them into a sketch leaves in each bit the parity of the
shingles that fell on it, so two sketches' Hamming distance is at most the sets' symmetric difference, and a Jaccard
threshold bounds that difference. By size band, sketches are cut into more pieces than the bound, so texts
that are alike enough agree on a piece: pieces are the join keys, sketches filter, and the shingles themselves decide.

A sketch of 512 bits says little about large sets, so those have wide ones besides, as long as their band needs.

There are half as many pieces again as the pigeonhole needs, and a text's keys are those of its pieces that come first in an
order that all texts share: pieces that fall on crowded cells come last. So passages that many texts have in common are
keys only of texts that have too little else.

Equal sets are one node from the start. Nodes of a bucket are first linked with its smallest node, and what is then in
one component needs no more comparison; only pairs in different components that share a bucket are compared beyond that.
So copies are never expanded into pairs, and no link between different components is lost. In a bucket of very many
components pairs are not made: its texts are compared where they share one of their rarest shingles (`rare_shingles`),
which finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, maybe_in, small_batches, text_of, wide_hash
from .rare_shingles import rare_keys
from .shingles import SKETCH_LONGS, Shingles, U, decimals, mix, shingled

#: Shared cells in which all texts' pieces are counted, and a cell's excess over the others from which it is crowded.
CELL_BITS = 17
CROWD = 64
#: Low bits of a key, which hold its band.
BAND_MASK = 255
#: Sets of more shingles have wide sketches, of three bits or more for two shingles.
WIDE_FROM = 300
#: Pairs that are compared with one copy of their common text.
FAN = 1000
#: Pairs across components in one bucket up to which sketches compare them all; it bounds work, not results.
BUCKET_PAIRS = 1 << 20


class Bands:
    """Size bands for a threshold of num / den, and the pieces of each.

    The wider the bands, the more pieces their smaller sets have; the narrower, the more sets take part in two.
    """

    def __init__(self, num: int, den: int, most: int = 1 << 32):
        self.num, self.den = num, den
        ratio = 1 + 2.5 * (den - num) / num
        #: Pieces with fewer shingles are alike in many texts.
        self.least_load = 2 if num >= 5 * (den - num) else 1
        starts = [1]
        while starts[-1] < most:
            starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
        if len(starts) > BAND_MASK + 1:
            raise ValueError("the threshold is too high for the bands' numbers")
        self.starts = np.array(starts)
        #: Of two linked sets, the smaller one in a band, at most `bound` shingles stand in one alone.
        self.bound = (self.starts[1:] - 1) * (den - num) // num

    def own(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size. Of two linked sets, both take part in the smaller one's."""
        return (np.searchsorted(self.starts, sizes, "right") - 1).astype(np.int32)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (set, band): a set takes part in its own band and in lower ones that hold a set it can link with.
        Bands in which only equal sets link, which are one node already, are left out."""
        own = self.own(sizes)
        first = np.searchsorted(self.starts, -(-sizes * self.num // self.den), "right") - 1
        n = np.where(sizes > 0, own - first + 1, 0)
        sets = np.repeat(np.arange(len(sizes)), n)
        bands = first[sets] + np.arange(len(sets)) - np.repeat(np.cumsum(n) - n, n)
        some = self.bound[bands] > 0
        return sets[some], bands[some]


class Pieces(NamedTuple):
    """Keys of pieces, of which set each is, its rank among the set's pieces of that band, and how many of those are needed."""

    keys: np.ndarray
    sets: np.ndarray
    ranks: np.ndarray
    needed: np.ndarray


def pieces(shingles: Shingles, bands: Bands, crowded: np.ndarray | None = None) -> Pieces:
    """Every set's sketch in pieces, by band. With bound + 1 + spare pieces, linked sets agree on more than `spare`; the first of
    those in an order that depends on the piece alone is among both sets' first bound + 1. The order: pieces in cells
    that are not crowded, then those with enough shingles, then by place."""
    sizes = np.diff(shingles.starts)
    sets, band = bands.of(sizes)
    needed = bands.bound[band] + 1
    n = needed + needed // 2 + 1
    offset = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    length = sizes[sets]
    segment = np.repeat(np.arange(len(sets)), length)
    h = shingles.hashes[np.repeat(shingles.starts[sets] - (np.cumsum(length) - length), length) + np.arange(len(segment))]
    at = offset[segment] + ((h >> U(6)) % n[segment].astype(U)).astype(np.int64)
    words = np.zeros(offset[-1], U)
    np.bitwise_xor.at(words, at, h)
    owner = np.repeat(np.arange(len(sets)), n)
    place = (np.arange(len(words)) - offset[owner]).astype(U)
    keys = mix(words ^ mix(place + (band[owner].astype(U) << U(32)))) & ~U(BAND_MASK) | band[owner].astype(U)
    grade = (np.bincount(at, minlength=len(words)) < bands.least_load).astype(np.int8)
    if crowded is not None:
        grade += 2 * crowded[(keys >> U(64 - CELL_BITS)).astype(np.int64)]
    ranks, below = np.empty(len(words), np.int64), np.zeros(len(sets), np.int64)
    for g in range(4):
        mine = grade == g
        so_far = np.concatenate([np.zeros(1, np.int64), np.cumsum(mine)])
        ranks[mine] = (below[owner] + so_far[:-1] - so_far[offset[owner]])[mine]
        below += np.diff(so_far[offset])
    return Pieces(keys, sets[owner], ranks, needed[owner])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
OF_NODE = ["hash", "n_shingles", "band", *SKETCH]
NODE = "decimal(38,0)"
SIGNATURE = f"id long, hash {NODE}, n_shingles long, band int, node {NODE}, first boolean, " + ", ".join(f"{s} long" for s in SKETCH) + ", wide array<struct<band: int, bits: array<long>>>"
WIDE = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.list_(pa.int64()))]))


def wide_sketches(shingles: np.ndarray, bands: Bands) -> list[dict]:
    """For each band in which a large set takes part a sketch as long as the band's largest sets need."""
    out = []
    if len(shingles) > WIDE_FROM:
        h = mix(shingles)
        for band in bands.of(np.array([len(shingles)]))[1].tolist():
            n = 1 << int(np.ceil(np.log2(1.5 * bands.starts[band + 1])))
            parity = np.bincount((h & U(n - 1)).astype(np.int64), minlength=n) & 1
            out.append({"band": band, "bits": np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")})
    return out


class _Firsts:
    """Which sets of a task hold anything and have not come before in it."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, shingles: Shingles, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), bool)
        for k, (node, size) in enumerate(zip(map(bytes, nodes), np.diff(shingles.starts).tolist(), strict=True)):
            if size and node not in self.seen:
                self.seen.add(node)
                out[k] = True
        return out


def _signer(n_words: int, bands: Bands):
    """Sizes, nodes and sketches; `first` marks the first text of a node in a task, the only one whose sketch is kept."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in batches:
            s = shingled(batch.column("text"), n_words)
            nodes = s.nodes()
            first = firsts(s, nodes)
            block = _signed(np.where(first[:, None], s.sketches(), U(0)))
            yield pa.record_batch(
                {"id": batch.column("id"), "hash": batch.column("hash"), "n_shingles": pa.array(np.diff(s.starts)), "band": pa.array(bands.own(np.diff(s.starts))), "node": decimals(nodes), "first": pa.array(first)}
                | {name: pa.array(block[:, i].copy()) for i, name in enumerate(SKETCH)}
                | {"wide": pa.array([wide_sketches(s.of(k), bands) if f else [] for k, f in enumerate(first)], WIDE)}
            )

    return sign


def _of_firsts(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[tuple[Shingles, np.ndarray]]:
    """The shingles and nodes of a task's first text of each node."""
    firsts = _Firsts()
    for batch in batches:
        s = shingled(batch.column("text"), n_words)
        nodes = s.nodes()
        first = firsts(s, nodes)
        size = np.diff(s.starts)
        yield Shingles(s.hashes[np.repeat(first, size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size[first])])), nodes[first]


def _counter(n_words: int, bands: Bands):
    """How many pieces of a task fall on each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        for s, _ in _of_firsts(batches, n_words):
            n += np.bincount((pieces(s, bands).keys >> U(64 - CELL_BITS)).astype(np.int64), minlength=len(n))
        cell = np.flatnonzero(n)
        yield pa.record_batch({"cell": pa.array(cell), "n": pa.array(n[cell])})

    return count


def crowded_cells(texts: DataFrame, n_words: int, bands: Bands) -> np.ndarray:
    """For each of 2 ** CELL_BITS cells whether many more pieces of all texts fall on it than on most: it holds a piece that many texts share."""
    found = texts.mapInArrow(_counter(n_words, bands), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << CELL_BITS, np.int64)
    n[found["cell"].to_numpy()] = found["n"].to_numpy()
    usual = np.median(n)
    return (n > usual + 8 * np.sqrt(usual) + CROWD).astype(np.int8)


def _keyer(n_words: int, bands: Bands, crowded: np.ndarray):
    """Join keys of the first text of each node in a task, a row for each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, nodes in _of_firsts(batches, n_words):
            p = pieces(s, bands, crowded)
            used = p.ranks < p.needed
            yield pa.record_batch({"key": pa.array(_signed(p.keys[used])), "node": decimals(nodes[p.sets[used]])})

    return keyed


def _checker(n_words: int, num: int, den: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("b").dictionary_encode().indices.to_numpy()  # many pairs have their second text in common
            _, one = np.unique(which, return_index=True)
            left, right = shingled(batch.column("text_a"), n_words), shingled(batch.column("text_b").take(pa.array(one)), n_words)
            keep = []
            for k in range(len(which)):
                s, t = left.of(k), right.of(which[k])
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node reachable. In each round nodes join their smallest
    neighbour, or none if they are smaller, and edges are drawn anew between those that are left. Nodes are digests, in random order, so
    every round leaves a fraction of them, and all rounds together cost little more than the first. Each round's
    tables are written; the driver sees only whether edges are left."""
    edges = space.keep(edges.select("a", "b").where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e"))
        joined = space.keep(ends.groupBy(F.col("e.node").alias("node")).agg(F.min("e.near").alias("near")).select("node", F.least("node", "near").alias("label")))
        rounds.append(joined)
        left = edges
        for end in ("a", "b"):
            left = left.join(joined.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end)
        left = left.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a != b")
        left = space.keep(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        space.drop(edges)
        edges = left
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = space.keep(earlier.join(upper, "label", "left").select("node", F.coalesce("upper", "label").alias("label")))
    return labels


def keyed_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text (null as empty) and hash of the text."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return rows.select("id", wide_hash(F.col("text")).alias("hash"), "text")


def labelled_rows(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, hash (of the text), n_shingles and label, which rows have in common if and only if links connect
    them; null for a text without words. The contract is that of `similar_components`."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "jaccard")
    bands = Bands(num, den)
    rows = keyed_rows(docs, id_column, text_column)
    texts = rows.select("text")
    signed = space.keep(rows.mapInArrow(_signer(n_words, bands), SIGNATURE))

    # keys are many and mostly of one text; they are made twice rather than kept: to find which are shared, and whose those are
    keyed = texts.mapInArrow(_keyer(n_words, bands, crowded_cells(texts, n_words, bands)), f"key long, node {NODE}")
    shared = space.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key"))
    sharing = space.keep(maybe_in(keyed, "key", shared, "key").join(shared, "key").distinct())
    space.drop(shared)
    buckets = sharing.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where(F.col("pivot") != F.col("last"))
    members = space.keep(sharing.join(buckets.select("key", "pivot"), "key"))
    space.drop(sharing)

    among = space.keep(members.select("node").distinct())
    of_node = [F.min(c).alias(c) for c in OF_NODE]
    sketches = space.keep(signed.where("first").join(among, "node", "left_semi").groupBy("node").agg(*of_node))
    wide = signed.where("first").join(among, "node", "left_semi").select("node", "n_shingles", F.explode("wide").alias("w"))
    wide = space.keep(wide.select("node", "n_shingles", "w.band", "w.bits").dropDuplicates(["node", "band"]))
    star = members.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = _widely_filtered(_filtered(star, sketches, num, den), wide, num, den)
    near = space.keep(near.select("a", "b").distinct())
    linked = space.keep(_checked(near, rows, sketches, n_words, num, den, space))
    labels = components(linked, space).select("node", "label")

    side = space.keep(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    space.drop(members, linked)
    opened = space.keep(across(side))
    space.drop(side)
    few, many = opened.where(F.col("pairs") <= BUCKET_PAIRS), opened.where(F.col("pairs") > BUCKET_PAIRS)
    labels = bridged(few, None if many.isEmpty() else many, labels, near, sketches, wide, rows, n_words, num, den, space)

    placed = signed.select("id", "hash", "n_shingles", "node").join(labels, "node", "left")
    placed = space.keep(placed.select("id", "hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).alias("label")))
    space.drop_all_but(placed)
    return placed


def across(side: DataFrame) -> DataFrame:
    """The rows of the keys that hold several labels, of rows (key, node, label, ...): with stray, whether the node is outside the key's
    most frequent label, and pairs, all nodes of the key times those."""
    per = side.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    per = per.where(F.col("n") > F.col("main.n")).select("key", F.col("main.label").alias("main"), (F.col("n") * (F.col("n") - F.col("main.n"))).alias("pairs"))
    return side.join(per, "key").select(*side.columns, (F.col("label") != F.col("main")).alias("stray"), "pairs")


def stray_pairs(open_rows: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, band, a_label, b_label), a > b: the pairs of one key's nodes in different components whose sizes and sketches allow a link. One of
    the two is a stray, so a large component's nodes aren't paired with each other. Roles, where there are such, are those of `rare_keys`.
    The band is the smaller set's."""
    told = open_rows.join(sketches.drop("hash"), "node")
    own = [c for c in ("label", "role", "band", "n_shingles", *SKETCH) if c in told.columns]
    left = told.where("stray").select("key", F.col("node").alias("x"), *[F.col(c).alias(f"a_{c}") for c in own])
    right = told.select("key", F.col("node").alias("y"), "stray", *[F.col(c).alias(f"b_{c}") for c in own])
    both = left.join(right, "key")
    if "role" in own:
        both = both.where((F.col("a_role") + F.col("b_role")).isin(0, 3))
    both = both.where((F.col("a_label") != F.col("b_label")) & (~F.col("stray") | (F.col("x") > F.col("y"))) & _may_link(num, den))
    up = F.col("x") > F.col("y")
    either = lambda p, q, name: F.when(up, F.col(p)).otherwise(F.col(q)).alias(name)
    return both.select(either("x", "y", "a"), either("y", "x", "b"), F.least("a_band", "b_band").alias("band"), either("a_label", "b_label", "a_label"), either("b_label", "a_label", "b_label")).distinct()


def bridged(few: DataFrame, many: DataFrame | None, labels: DataFrame, near: DataFrame, sketches: DataFrame, wide: DataFrame | None, rows: DataFrame, n_words: int, num: int, den: int, space: Workspace) -> DataFrame:
    """The labels (node, label) with those merged that links connect between nodes of one key. few and many are rows as of `across`:
    pairs of few's keys are made, many's nodes meet by rare shingles. Pairs in near were compared before."""
    pairs = stray_pairs(few, sketches, num, den)
    if many is not None:
        pairs = pairs.unionByName(stray_pairs_of_rare(many, rows, sketches, n_words, num, den, space)).distinct()
    rest = pairs.join(near, ["a", "b"], "left_anti")
    rest = space.keep((rest if wide is None else _widely_filtered(rest, wide, num, den)).drop("band"))
    if rest.isEmpty():
        return labels
    more = _checked(rest.select("a", "b"), rows, sketches, n_words, num, den, space).join(rest, ["a", "b"])
    over = labels_over(more, space)
    return labels if over is None else relabelled(labels, over)


def labels_over(links: DataFrame, space: Workspace) -> DataFrame | None:
    """(label, upper) of the labels that links (a_label, b_label) join; None without links."""
    bridges = space.keep(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
    return None if bridges.isEmpty() else components(bridges, space).select(F.col("node").alias("label"), F.col("label").alias("upper"))


def relabelled(labels: DataFrame, over: DataFrame) -> DataFrame:
    """(node, label) with labels replaced; a label that no node had is a node of itself."""
    labels = labels.unionByName(over.join(labels, "label", "left_anti").select(F.col("label").alias("node"), "label"))
    return labels.join(over, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))


def stray_pairs_of_rare(many: DataFrame, rows: DataFrame, sketches: DataFrame, n_words: int, num: int, den: int, space: Workspace) -> DataFrame:
    """Pairs of nodes (node, label) of crowded buckets, in different components, that share one of their rarest shingles."""
    many = space.keep(many.select("node", "label").distinct().join(sketches.select("node", "hash"), "node"))
    texts = maybe_in(rows.select("hash", "text"), "hash", many, "hash").mapInArrow(_first_texts, f"hash {NODE}, text string")
    texts = space.keep(texts.join(many.select("hash", "node"), "hash").dropDuplicates(["hash"]).select("node", "text"))
    keys = rare_keys(texts, n_words, num, den).join(many.select("node", "label"), "node")
    return stray_pairs(space.keep(across(space.keep(keys))), sketches, num, den)


def similar_components(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (distinct word n-grams), component_id, the smallest id reachable over links.

    Two rows link if their shingle sets' intersection is at least num / den of their union, and if both sets hold anything.
    A text of fewer words than a shingle is one shingle; null and empty texts link with nothing and are their own
    component. Null ids take part and a component's id ignores them; repeated rows each give a row. Empty tables give
    none. Columns other than id and text are not read. Texts count whole.
    """
    placed = labelled_rows(docs, n_words, num, den, id_column, text_column)
    least = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("component_id"))
    alone = placed.where(F.col("label").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    grouped = placed.where(F.col("label").isNotNull()).join(least, "label").select("id", "n_shingles", "component_id")
    return grouped.unionByName(alone).withColumnRenamed("id", id_column)


def one_of_each(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies: of the rows that links connect, the one of the smallest id stays (a null id is
    larger than all; of one id's rows the one whose text has the smallest hash; of rows that have id and text in
    common any one). Rows without words all stay. The columns are those of the input."""
    row = wide_hash(F.col("id").isNull(), F.col("id"), F.col("hash"))
    placed = labelled_rows(docs, n_words, num, den, id_column, text_column).where(F.col("label").isNotNull())
    stay = placed.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("least"))
    stay = stay.select("least.id", "least.hash").select(row.alias("__row"))
    text = text_of(text_column)
    key = wide_hash(F.col(id_column).isNull(), F.col(id_column).cast("long"), wide_hash(text))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    one = docs.where(has_words).withColumn("__row", key).join(stay, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return one.unionByName(docs.where(~has_words))


def _may_link(num: int, den: int):
    """Sizes and sketches of a_ and b_ allow a link: the symmetric difference is at most (a + b)(1 - t) / (1 + t)."""
    a, b = F.col("a_n_shingles"), F.col("b_n_shingles")
    differing = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    return (a * den >= b * num) & (b * den >= a * num) & (differing * (den + num) <= (a + b) * (den - num))


def _filtered(pairs: DataFrame, sketches: DataFrame, num: int, den: int, *also: str) -> DataFrame:
    """(a, b, band, also) of the pairs whose sizes and sketches allow a link; the band is the smaller set's."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.drop("hash").select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sketches.columns if c not in ("hash", "node")]), side)
    return pairs.where(_may_link(num, den)).select("a", "b", F.least("a_band", "b_band").alias("band"), *also)


def _widely_filtered(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, band, ...) whose wide sketches allow a link, and those without such."""
    for side in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("node").alias(side), "band", F.col("n_shingles").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")), [side, "band"], "left")
    each = F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(each, F.lit(0), lambda n, x: n + x)
    fits = differing * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num)
    return pairs.where(F.coalesce(fits, F.lit(True))).drop("a_n", "a_bits", "b_n", "b_bits")


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text that many rows share leaves a task once."""
    seen: set = set()
    for batch in batches:
        new = []
        for k, h in enumerate(batch.column("hash").to_pylist()):
            if h not in seen:
                seen.add(h)
                new.append(k)
        yield batch.take(pa.array(new, pa.int64()))


def _checked(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, n_words: int, num: int, den: int, space: Workspace) -> DataFrame:
    """The pairs (a, b) that link, by their shingles. Texts of nodes in no pair aren't moved. A b of very many pairs is dealt
    out FAN pairs at a time, with a copy of its text for each deal."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = space.keep(sketches.select("node", "hash").join(ends, "node", "left_semi"))
    found = maybe_in(rows.select("hash", "text"), "hash", wanted, "hash").mapInArrow(_first_texts, f"hash {NODE}, text string")
    texts = space.keep(found.join(wanted, "hash").dropDuplicates(["hash"]).select("node", "text"))
    deals = pairs.groupBy("b").agg(F.floor(F.count(F.lit(1)) / FAN + 1).cast("int").alias("deals"))
    dealt = pairs.join(deals, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int").alias("deal"))
    dealt = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    common = deals.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    common = common.select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    both = dealt.join(common, ["b", "deal"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_checker(n_words, num, den), f"a {NODE}, b {NODE}")
