"""Boxes of an image: size gates, reading order, and small-first suppression of boxes that swallow others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..storage import stored

BOX = ("x1", "y1", "x2", "y2")
#: Cells of a pixel grid in which boxes meet; it decides how many pairs are looked at, not which are found.
CELL = 128


def _area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x2") - F.col(f"{prefix}x1")) * (F.col(f"{prefix}y2") - F.col(f"{prefix}y1"))


def gated(boxes: DataFrame, width: Column, height: Column, least: float, most: float, least_side: int) -> DataFrame:
    """Boxes whose area (mask_area) is at least and at most those fractions of the image's, and neither side short."""
    image = width * height
    sides = (F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side)
    return boxes.where((F.col("mask_area") >= least * image) & (F.col("mask_area") <= most * image) & sides)


def padded(boxes: DataFrame, width: Column, height: Column, by: int) -> DataFrame:
    """Boxes larger on each side, within the image."""
    low = {c: F.greatest(F.lit(0), F.col(c) - by) for c in ("x1", "y1")}
    return boxes.withColumns(low | {"x2": F.least(width, F.col("x2") + by), "y2": F.least(height, F.col("y2") + by)})


def in_reading_order(quads: DataFrame, image: list[str], points: str, name: str = "place") -> DataFrame:
    """A row's place in its image, from 0: by its corners' (points, an array of x and y) least y, then least x, then the points themselves."""
    least = lambda k: F.array_min(F.transform(points, lambda p: p[k]))
    order = Window.partitionBy(*image).orderBy(least("y"), least("x"), F.col(points))
    return quads.withColumn(name, F.row_number().over(order) - 1)


def swallowing_pairs(boxes: DataFrame, image: list[str], id_column: str, overlap: float, contained: float, larger: float) -> DataFrame:
    """image, keeper, gone: pairs of which the later in order of area, then id, goes if the earlier is kept: it is `larger` times as large or more and
    holds `contained` of the earlier, or their overlap over union is `overlap` or more. Boxes meet in cells of a grid; a pair is looked at in the cell where its intersection begins."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / CELL), F.greatest(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    placed = boxes.select(*image, F.col(id_column).alias("id"), *BOX, _area().alias("area"))
    celled = placed.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    other = celled.select(*image, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("id", *BOX, "area")])
    pairs = celled.join(other, [*image, "cx", "cy"])
    first_cell = (F.col("cx") == F.floor(F.greatest("x1", "o_x1") / CELL)) & (F.col("cy") == F.floor(F.greatest("y1", "o_y1") / CELL))
    earlier = F.struct("area", "id") < F.struct("o_area", "o_id")
    w, h = F.least("x2", "o_x2") - F.greatest("x1", "o_x1"), F.least("y2", "o_y2") - F.greatest("y1", "o_y1")
    shared = F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)
    swallows = (F.col("o_area") > larger * F.col("area")) & (shared / F.greatest(F.lit(1), F.col("area")) >= contained)
    alike = G.iou([F.col(c) for c in BOX], [F.col(f"o_{c}") for c in BOX]) >= overlap
    return pairs.where(first_cell & earlier & (shared > 0) & (swallows | alike)).select(*image, F.col("id").alias("keeper"), F.col("o_id").alias("gone"))


def suppressed(boxes: DataFrame, image: list[str], id_column: str, overlap: float = 0.10, contained: float = 0.75, larger: float = 1.5) -> DataFrame:
    """The boxes that stay, smallest first: a box goes if a smaller one that stays meets the test of `swallowing_pairs`.

    Decided in rounds over the pairs of all images together: a box that no undecided smaller one threatens stays, those that it threatens go. Each round's
    rest is a written table; an image of any number of boxes is no task of its own, and rounds are as many as the longest chain of
    threats. Boxes without extent stay and threaten nothing; ids are unique within an image. Empty tables give none.
    """
    open_ = stored(swallowing_pairs(boxes, image, id_column, overlap, contained, larger), "threats")
    gone = None
    while not open_.isEmpty():
        threatened = open_.select(*image, F.col("gone").alias("keeper")).distinct()
        falls = stored(open_.join(threatened, [*image, "keeper"], "left_anti").select(*image, "gone").distinct(), "fallen")
        gone = falls if gone is None else gone.unionByName(falls)
        fallen = [falls.withColumnRenamed("gone", c) for c in ("keeper", "gone")]
        open_ = stored(open_.join(fallen[1], [*image, "gone"], "left_anti").join(fallen[0], [*image, "keeper"], "left_anti"), "threats")
    if gone is None:
        return boxes
    return boxes.join(gone.withColumnRenamed("gone", id_column), [*image, id_column], "left_anti")
