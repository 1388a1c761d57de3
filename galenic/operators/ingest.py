"""Records from JSON documents, links of kit components, and fields that classes of detections share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INGREDIENTS = "array<struct<ingredient: string, name: string, strength: string, unit: string>>"
LABELERS = "map<string, struct<codes: array<string>>>"


def labeler_index(entries: DataFrame) -> DataFrame:
    """code, name of a curated list (pos, json), whose entries are objects from a name to its codes: one row for each code; of
    several entries that hold one the last counts, and within an entry the last name."""
    named = entries.select("pos", F.explode(F.from_json("json", LABELERS)).alias("name", "meta"))
    codes = named.select("pos", "name", F.explode("meta.codes").alias("code"))
    return codes.groupBy("code").agg(F.max_by("name", F.struct("pos", "name")).alias("name"))


def ingredient_rows(products: DataFrame, key: str) -> DataFrame:
    """key, name, strength, unit of products (key, json): an ingredient's name stands under `ingredient`, else under `name`; of a
    name that a product has more than once the last entry counts. A product without a list gives no row."""
    each = products.select(key, F.posexplode(F.from_json("json", INGREDIENTS)).alias("pos", "i"))
    named = each.select(key, "pos", F.coalesce("i.ingredient", "i.name").alias("name"), "i.strength", "i.unit")
    last = named.groupBy(key, "name").agg(F.max_by(F.struct("strength", "unit"), "pos").alias("last"))
    return last.select(key, "name", "last.strength", "last.unit")


def row_number_of(rxcui: Column) -> Column:
    """A concept's id as a number; null unless it is digits only."""
    return F.when(rxcui.rlike("^[0-9]+$"), rxcui.try_cast("long"))


def with_at_most(products: DataFrame, ingredients: Column, most: int) -> DataFrame:
    """Products with their ingredient_count, those of more than the limit left out; a missing list counts as empty."""
    return products.withColumn("ingredient_count", F.coalesce(F.size(ingredients), F.lit(0))).where(F.col("ingredient_count") <= most)


def linked_components(components: DataFrame, concepts: DataFrame) -> DataFrame:
    """Components (with rxcui) with the name of their concept, null where the id is null or not known."""
    known = concepts.select("rxcui", F.col("name").alias("concept"))
    return components.join(known, "rxcui", "left")


def merged_classes(detections: DataFrame, fields: tuple[str, ...] = ("lot", "ndc", "exp")) -> DataFrame:
    """run, image, class_label, members, and of each field the first value that a member has, by position."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in fields]
    return detections.groupBy("run", "image", "class_label").agg(F.count(F.lit(1)).alias("members"), *firsts)


def shared_fields(classes: DataFrame, fields: tuple[str, ...] = ("lot", "ndc", "exp")) -> DataFrame:
    """run, image, class_label, shared, inferred: what each class of a later image has in common with the reference image's class of
    the label. Shared fields are inferred if either class has more than one member, whose read may be another's."""
    columns = ["members", *fields]
    a = classes.where(F.col("image") == 0).select("run", "class_label", *[F.col(c).alias(f"r_{c}") for c in columns])
    b = classes.where(F.col("image") != 0)
    shared = F.concat_ws(",", *[F.when(F.col(c) == F.col(f"r_{c}"), c) for c in fields])
    several = (F.col("members") > 1) | (F.col("r_members") > 1)
    return b.join(a, ["run", "class_label"]).select("run", "image", "class_label", shared.alias("shared"), F.when(several, shared).otherwise("").alias("inferred"))
