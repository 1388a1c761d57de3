"""Queries over detections and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..operators import matching as M
from ..views import with_views
from .registry import query

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda k: CAST({a}[k] AS DOUBLE) * CAST({b}[k] AS DOUBLE)))"
_SCORES = f""", p AS (SELECT s.run, s.image, s.instance_id AS sub_id, r.instance_id AS ref_id, {_DOT.format(a='s.v', b='r.v')} AS visual, coalesce(s.lot = r.lot, false) AS lm, coalesce(s.ndc = r.ndc, false) AS nm,
        coalesce(s.exp = r.exp, false) AS em, coalesce(split_part(s.ndc, '-', 1) = split_part(r.ndc, '-', 1), false) AS pm FROM v_detections s JOIN v_detections r ON s.run = r.run AND s.image <> 0 AND r.image = 0),
        q AS (SELECT *, 0.35 * visual + CASE WHEN lm THEN 0.30 ELSE 0 END + CASE WHEN nm THEN 0.15 WHEN pm THEN 0.075 ELSE 0 END + CASE WHEN em THEN 0.05 ELSE 0 END AS base FROM p)"""


@query(
    "pair_scores",
    with_views(_SCORES + " SELECT run, image, sub_id, ref_id, round(visual, 5) AS visual, round(CASE WHEN lm AND visual >= 0.55 THEN greatest(base, 0.55 + 0.1 * visual) ELSE base END, 5) AS score FROM q", "v_detections").replace(") , p AS", "), p AS"),
)
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_scores(V.detections(spark, d)).select("run", "image", "sub_id", "ref_id", F.round("visual", 5).alias("visual"), F.round("score", 5).alias("score"))


@query("reference_assignment")
def reference_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of later images on the slots of the reference image; the assignment maximises the total score."""
    return M.assigned(M.pair_scores(V.detections(spark, d)))


@query("forced_assignment")
def forced_assignment(spark: SparkSession, d: str) -> DataFrame:
    return M.assigned(M.pair_scores(V.detections(spark, d)), force=True)


@query(
    "reflection_filter",
    with_views(
        """SELECT run, image, instance_id, arg_min(parent, o_pos) AS parent FROM (SELECT d.run, d.image, d.instance_id, o.instance_id AS parent, o.pos AS o_pos FROM v_detections d JOIN v_detections o ON d.run = o.run AND d.image = o.image AND d.instance_id <> o.instance_id
        WHERE d.y1 - o.y2 >= -0.05 * (d.y2 - d.y1) AND d.y1 - o.y2 <= 30 AND least(d.x2, o.x2) - greatest(d.x1, o.x1) >= 0.30 * (d.x2 - d.x1) AND o.mask_area >= 2 * d.mask_area) GROUP BY 1, 2, 3""",
        "v_detections",
    ),
)
def reflection_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.reflections(V.detections(spark, d))


@query("detection_cleanup")
def detection_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Without boxes that span the frame and reflections, overlapping boxes merged."""
    boxes = M.without_frames(V.detections(spark, d), 700, 580)
    return M.merged(boxes.join(M.reflections(boxes).select("instance_id"), "instance_id", "left_anti"))


@query("frame_filter", with_views("SELECT image, count(*) AS n, count(CASE WHEN ((x2 - x1) * (y2 - y1)) / (180.0 * 180.0) >= 0.80 THEN 1 END) AS n_frames FROM v_detections GROUP BY 1", "v_detections"))
def frame_filter(spark: SparkSession, d: str) -> DataFrame:
    boxes = V.detections(spark, d)
    kept = M.without_frames(boxes, 180, 180).groupBy("image").agg(F.count(F.lit(1)).alias("kept"))
    return boxes.groupBy("image").agg(F.count(F.lit(1)).alias("n")).join(kept, "image", "left").select("image", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("n_frames"))


@query(
    "sibling_pairs",
    with_views(
        """SELECT a.run, a.image, a.instance_id AS a, b.instance_id AS b FROM v_detections a JOIN v_detections b ON a.run = b.run AND a.image = b.image AND a.instance_id < b.instance_id
        WHERE a.mask_area > 0 AND b.mask_area > 0 AND least(a.mask_area, b.mask_area) / greatest(a.mask_area, b.mask_area) >= 0.85 AND abs((a.x2 - a.x1) / (a.y2 - a.y1) - (b.x2 - b.x1) / (b.y2 - b.y1)) <= 0.15""",
        "v_detections",
    ),
)
def sibling_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.sibling_pairs(V.detections(spark, d))


@query("sibling_fill")
def sibling_fill(spark: SparkSession, d: str) -> DataFrame:
    return M.siblings_filled(V.detections(spark, d))


@query("counts_by_image_class", with_views("SELECT run, image, class_label, count(*) AS n FROM v_detections GROUP BY 1, 2, 3", "v_detections"))
def counts_by_image_class(spark: SparkSession, d: str) -> DataFrame:
    return V.detections(spark, d).groupBy("run", "image", "class_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "inventory_summary",
    with_views("SELECT concat_ws(' ', class_label, ndc, lot) AS description, count(*) AS n, count(DISTINCT run) AS runs, min(instance_id) AS first_seen FROM v_detections WHERE image = 0 GROUP BY 1", "v_detections"),
)
def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Slots of reference images by description."""
    s = V.detections(spark, d).where(F.col("image") == 0)
    return s.groupBy(F.concat_ws(" ", "class_label", "ndc", "lot").alias("description")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"), F.min("instance_id").alias("first_seen"))


@query(
    "fifo_match",
    with_views(
        """, p AS (SELECT a.run, a.image AS image_a, b.image AS image_b FROM (SELECT DISTINCT run, image FROM v_detections) a JOIN (SELECT DISTINCT run, image FROM v_detections) b ON a.run = b.run AND a.image < b.image),
        s AS (SELECT run, image, lot, instance_id, row_number() OVER (PARTITION BY run, image, lot ORDER BY instance_id) AS n FROM v_detections WHERE lot IS NOT NULL)
        SELECT p.run, p.image_a, p.image_b, a.lot, CAST(a.n AS INTEGER) AS n, a.instance_id AS a, b.instance_id AS b FROM p JOIN s a ON a.run = p.run AND a.image = p.image_a JOIN s b ON b.run = p.run AND b.image = p.image_b AND a.lot = b.lot AND a.n = b.n""",
        "v_detections",
    ).replace(") , p AS", "), p AS"),
)
def fifo_match(spark: SparkSession, d: str) -> DataFrame:
    """The n-th box of a lot in an image with its n-th in each later image of the run."""
    first, second = M.image_pairs(V.detections(spark, d))
    return M.fifo(first, second, "lot", "instance_id", "pair").select("pair.*", "lot", "n", "a", "b")


def components(spark: SparkSession, d: str) -> DataFrame:
    b = V.detections(spark, d)
    i = F.col("instance_id")
    return b.select(
        "run", "image", i.alias("id"), F.when(i % 2 == 0, "vial").otherwise("bag").alias("type"), "ndc", "lot", "exp",
        F.when(i % 6 != 0, F.concat(F.lit("mfg"), (i % 3).cast("string"))).alias("mfg"), F.concat(F.lit("drug"), (i % 4).cast("string")).alias("product"), F.concat((i % 2 * 5 + 5).cast("string"), F.lit(" mg")).alias("strength"),
    )


_COMPONENTS = """, c AS (SELECT run, image, instance_id AS id, CASE WHEN instance_id % 2 = 0 THEN 'vial' ELSE 'bag' END AS type, ndc, lot, exp, CASE WHEN instance_id % 6 <> 0 THEN 'mfg' || CAST(instance_id % 3 AS VARCHAR) END AS mfg,
        'drug' || CAST(instance_id % 4 AS VARCHAR) AS product, CAST(instance_id % 2 * 5 + 5 AS VARCHAR) || ' mg' AS strength FROM v_detections),
        x AS (SELECT a.run * 10000 + a.image * 100 + b.image AS run, a.id AS i, b.id AS j, coalesce(a.ndc = b.ndc, false) AS ns, coalesce(a.ndc <> b.ndc, false) AS nd, coalesce(a.lot = b.lot, false) AS ls, coalesce(a.lot <> b.lot, false) AS ld, coalesce(a.exp = b.exp, false) AS es, coalesce(a.exp <> b.exp, false) AS ed,
          coalesce(a.mfg = b.mfg, false) AS ms, coalesce(a.mfg <> b.mfg, false) AS md, a.product = b.product AS ps, a.strength = b.strength AS ss FROM c a JOIN c b ON a.run = b.run AND a.image < b.image AND a.type = b.type),
        y AS (SELECT run, i, j, CASE WHEN NOT (nd OR ld OR ed OR md) AND ls AND (ns OR es OR ms) THEN 'identity' WHEN ns AND NOT (md OR NOT ps) THEN 'sku' WHEN ps AND ss AND ms AND NOT (nd OR ld) THEN 'sku' WHEN ps AND ss THEN 'therapeutic' END AS tier,
          CAST(CASE WHEN NOT (nd OR ld OR ed OR md) AND ls AND ns THEN 10 + CASE WHEN es THEN 1 ELSE 0 END + CASE WHEN ms THEN 0.5 ELSE 0 END WHEN NOT (nd OR ld OR ed OR md) AND ls AND (es OR ms) THEN 8 + CASE WHEN ms THEN 0.5 ELSE 0 END
          WHEN ns AND NOT (md OR NOT ps) THEN 6 + CASE WHEN ss THEN 0.5 ELSE 0 END WHEN ps AND ss AND ms AND NOT (nd OR ld) THEN 5 WHEN ps AND ss AND (md OR nd) THEN 3.5 WHEN ps AND ss THEN 2.5 END AS DOUBLE) AS score FROM x)"""


def _tier(n: int, tier: str, anti: str) -> str:
    return f""", a{n} AS (SELECT *, max(score) OVER (PARTITION BY run, i) AS bi, max(score) OVER (PARTITION BY run, j) AS bj FROM y WHERE tier = '{tier}'{anti}), b{n} AS (SELECT run, i, j, tier, score, count(*) OVER (PARTITION BY run, i) AS ni, count(*) OVER (PARTITION BY run, j) AS nj FROM a{n} WHERE score >= bi - 1.0 AND score >= bj - 1.0)"""


def _unused(*tiers: int) -> str:
    return "".join(f" AND (run, i) NOT IN (SELECT (run, i) FROM b{n} WHERE ni = 1) AND (run, j) NOT IN (SELECT (run, j) FROM b{n} WHERE nj = 1)" for n in tiers)


@query(
    "tiered_links",
    with_views(
        _COMPONENTS + _tier(1, "identity", "") + _tier(2, "sku", _unused(1)) + _tier(3, "therapeutic", _unused(1, 2))
        + " SELECT run // 10000 AS run, run // 100 % 100 AS image_a, run % 100 AS image_b, i, j, tier, score, ni > 1 OR nj > 1 AS ambiguous FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)",
        "v_detections",
    ).replace(") , c AS", "), c AS"),
)
def tiered_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the components of every two images of a run."""
    first, second = M.image_pairs(components(spark, d))
    links = M.tiered_links(M.classified_pairs(first, second, "pair"), "pair")
    return links.select("pair.*", "i", "j", "tier", "score", "ambiguous")


@query(
    "unmatched_components",
    with_views(
        _COMPONENTS + " SELECT c.run, c.image AS image_a, o.image AS image_b, c.id FROM c JOIN (SELECT DISTINCT run, image FROM c) o ON o.run = c.run AND o.image > c.image WHERE (c.run * 10000 + c.image * 100 + o.image, c.id) NOT IN (SELECT (run, i) FROM y WHERE tier IN ('identity', 'sku'))",
        "v_detections",
    ).replace(") , c AS", "), c AS"),
)
def unmatched_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of an image that no identity or product link reaches from a later image of the run, for every two images."""
    first, second = M.image_pairs(components(spark, d))
    pairs = M.classified_pairs(first, second, "pair").where(F.col("tier").isin("identity", "sku"))
    alone = first.select("pair", "id").join(pairs.select("pair", F.col("i").alias("id")), ["pair", "id"], "left_anti")
    return alone.select("pair.*", "id")


@query(
    "order_verification",
    with_views(
        """, f AS (SELECT order_id, pos, CASE WHEN pos % 2 = 0 THEN product_ndc ELSE package_ndc END AS ndc, CASE WHEN pos % 4 = 3 THEN lot || 'X' WHEN pos % 4 <> 0 THEN lot END AS lot, exp FROM v_order_components WHERE pos % 5 <> 0),
        h AS (SELECT e.order_id, e.pos, f.pos AS f_pos, f.lot AS f_lot, f.exp AS f_exp, row_number() OVER (PARTITION BY e.order_id, e.pos ORDER BY f.pos) AS rn FROM v_order_components e JOIN f ON f.order_id = e.order_id AND (f.ndc = e.package_ndc OR f.ndc = e.product_ndc))
        SELECT e.order_id, e.pos, h.f_pos IS NOT NULL AS found, e.lot = h.f_lot AS lot_match, e.exp = h.f_exp AS exp_match, h.f_pos IS NULL OR coalesce(e.lot <> h.f_lot, false) OR coalesce(e.exp <> h.f_exp, false) AS discrepant
        FROM v_order_components e LEFT JOIN h ON h.order_id = e.order_id AND h.pos = e.pos AND h.rn = 1""",
        "v_order_components",
    ).replace(") , f AS", "), f AS"),
)
def order_verification(spark: SparkSession, d: str) -> DataFrame:
    """Expected components against found ones, of which some are missing and some have another lot or none."""
    c = V.order_components(spark, d).repartition("order_id")
    found = F.struct(
        F.when(F.col("pos") % 2 == 0, F.col("product_ndc")).otherwise(F.col("package_ndc")).alias("ndc"),
        F.when(F.col("pos") % 4 == 3, F.concat("lot", F.lit("X"))).when(F.col("pos") % 4 != 0, F.col("lot")).alias("lot"), "exp",
    )
    return M.verified_sides(c.select("order_id", "pos", F.struct("product_ndc", "package_ndc", "lot", "exp").alias("e"), F.when(F.col("pos") % 5 != 0, found).alias("f"))).drop("e")
