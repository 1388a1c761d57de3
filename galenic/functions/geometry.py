"""Boxes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def coverage(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return ((x2 - x1) * (y2 - y1)) / (width * height)


def aspect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) / (y2 - y1)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of boxes (x1, y1, x2, y2); 0 for boxes that don't overlap."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.when(w * h == 0, 0.0).otherwise(w * h / (area(a) + area(b) - w * h))


def correlation_likeness(a: Column, b: Column) -> Column:
    """Correlation of two histograms of equal length, from 0 to 1; 0 where one is missing or empty, 1 where both are flat, as they then are alike."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    mean = lambda x: total(x) / F.size(x)

    def of(m: Column) -> Column:
        x, y = m["x"], m["y"]
        both = total(F.zip_with(a, b, lambda p, q: (p - x) * (q - y)))
        spread = total(F.transform(a, lambda p: (p - x) * (p - x))) * total(F.transform(b, lambda q: (q - y) * (q - y)))
        return F.when(spread == 0, 1.0).otherwise((both / F.sqrt(spread) + 1) / 2)

    there = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    means = F.array(F.struct(mean(a).alias("x"), mean(b).alias("y")))
    return F.when(there, F.get(F.transform(means, of), F.lit(0))).otherwise(0.0)


#: Bits in which two descriptors of 256 bits may differ and still match.
MATCH_BITS = 64


def mutual_matches(a: Column, b: Column, limit: int = MATCH_BITS) -> Column:
    """Of two arrays of binary descriptors (longs) the share of the smaller one's that match: each is the other's nearest, the first of
    equals, and fewer than `limit` bits differ; 0 where one is missing or empty."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    nearest = lambda x, others: F.array_min(F.transform(others, lambda y, j: F.struct(apart(x, y).alias("bits"), j.alias("at"))))
    there = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    to_b, to_a = F.transform(a, lambda x: nearest(x, b)), F.transform(b, lambda y: nearest(y, a))
    both = F.array(F.struct(to_b.alias("there"), to_a.alias("back")))
    good = F.get(F.transform(both, lambda m: F.size(F.filter(F.transform(m["there"], lambda n, i: (n["bits"] < limit) & (F.get(m["back"], n["at"])["at"] == i)), lambda x: x))), F.lit(0))
    return F.when(there, good / F.least(F.size(a), F.size(b))).otherwise(0.0)
