"""Queries over the boxes of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import views as V
from ..operators import suppress as S
from ..views import with_views
from .registry import query

WIDTH, HEIGHT = 700, 580
_GATED = f"""SELECT run, image, instance_id, greatest(0, x1 - 10) AS x1, greatest(0, y1 - 10) AS y1, least({WIDTH}, x2 + 10) AS x2, least({HEIGHT}, y2 + 10) AS y2 FROM v_detections
    WHERE mask_area >= 0.004 * {WIDTH * HEIGHT} AND mask_area <= 0.75 * {WIDTH * HEIGHT} AND x2 - x1 >= 40 AND y2 - y1 >= 40"""


def _kept(overlap: str, contained: str) -> str:
    """Boxes in order of area and id, one after the other: a box joins those kept unless one of them threatens it."""
    return f""", g AS ({_GATED}), o AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY run, image ORDER BY (x2 - x1) * (y2 - y1), instance_id) AS k FROM g),
    s AS (SELECT a.run, a.image, a.k AS i, b.k AS j, a.area AS ai, b.area AS aj, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared FROM o a JOIN o b ON a.run = b.run AND a.image = b.image AND a.k < b.k),
    t AS (SELECT run, image, j, list(i) AS by_ FROM s WHERE shared > 0 AND ((aj > 1.5 * ai AND shared / greatest(1, ai) >= {contained}) OR shared / (ai + aj - shared) >= {overlap}) GROUP BY 1, 2, 3),
    z AS (SELECT o.*, coalesce(t.by_, []) AS by_ FROM o LEFT JOIN t ON t.run = o.run AND t.image = o.image AND t.j = o.k),
    r AS (SELECT run, image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY 1, 2
      UNION ALL SELECT z.run, z.image, z.k, CASE WHEN list_has_any(r.kept, z.by_) THEN r.kept ELSE list_append(r.kept, z.k) END FROM r JOIN z ON z.run = r.run AND z.image = r.image AND z.k = r.k + 1)
    SELECT o.run, o.image, o.instance_id, CAST(row_number() OVER (PARTITION BY o.run, o.image ORDER BY o.x1, o.instance_id) - 1 AS INTEGER) AS place FROM o
    JOIN (SELECT run, image, arg_max(kept, k) AS kept FROM r GROUP BY 1, 2) f ON f.run = o.run AND f.image = o.image WHERE list_contains(f.kept, o.k)"""


def _small_first(spark: SparkSession, d: str, overlap: float, contained: float) -> DataFrame:
    w, h = F.lit(WIDTH), F.lit(HEIGHT)
    boxes = S.padded(S.gated(V.detections(spark, d), w, h, 0.004, 0.75, 40), w, h, 10)
    kept = S.suppressed(boxes.select("run", "image", "instance_id", *S.BOX), ["run", "image"], "instance_id", overlap, contained)
    return kept.select("run", "image", "instance_id", (F.row_number().over(Window.partitionBy("run", "image").orderBy("x1", "instance_id")) - 1).alias("place"))


@query("small_first_suppression", with_views(_kept("0.10", "0.75"), "v_detections", recursive=True).replace(") , g AS", "), g AS"))
def small_first_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that size gates and smaller boxes let stay, from left to right."""
    return _small_first(spark, d, 0.10, 0.75)


@query("small_first_suppression_wide", with_views(_kept("0.30", "0.85"), "v_detections", recursive=True).replace(") , g AS", "), g AS"))
def small_first_suppression_wide(spark: SparkSession, d: str) -> DataFrame:
    """The same with the wider limits of the second segmentation method."""
    return _small_first(spark, d, 0.30, 0.85)


@query(
    "reading_order",
    with_views("SELECT run, image, instance_id, CAST(row_number() OVER (PARTITION BY run, image ORDER BY y1, least(x1, x1 + instance_id % 5 - 2), x1, y1, x2, y1 + instance_id % 9) - 1 AS INTEGER) AS place FROM v_detections", "v_detections"),
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as tilted quads, from top to bottom and left to right."""
    i = F.col("instance_id")
    corners = [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y1") + i % 9), (F.col("x2"), F.col("y2")), (F.col("x1") + i % 5 - 2, F.col("y2"))]
    quads = V.detections(spark, d).withColumn("points", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))
    return S.in_reading_order(quads, ["run", "image"], "points").select("run", "image", "instance_id", "place")
