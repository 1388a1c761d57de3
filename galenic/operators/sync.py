"""Products brought up to date from a directory's records, and repair of those without ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import records as P, rxname as R, text as X

INGREDIENTS = "array<struct<name:string,strength:string,unit:string>>"


def is_kit(form: Column) -> Column:
    return F.coalesce(F.upper(F.trim(form)) == "KIT", F.lit(False))


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _listed(c: Column) -> Column:
    """Ingredients with a name; null if none has one."""
    some = F.filter(F.coalesce(c, F.array().cast(INGREDIENTS)), lambda i: F.coalesce(F.trim(i["name"]), F.lit("")) != "")
    tidy = F.transform(some, lambda i: F.struct(F.trim(i["name"]).alias("name"), F.coalesce(F.trim(i["strength"]), F.lit("")).alias("strength"), F.coalesce(F.trim(i["unit"]), F.lit("")).alias("unit")))
    return F.when(F.size(tidy) > 0, tidy)


def synchronised(records: DataFrame) -> DataFrame:
    """product_ndc, generic, brand, dosage_form, route (array), labeler_code, labeler, ingredients, is_kit, from_name of each record.

    records: product_ndc, generic, brand, dosage_form, route (array), labeler_name, ingredients. Where a record lacks ingredients, dosage form or route,
    its generic name may say them (`vancomycin 5 MG Oral Tablet`); from_name lists what came from there. A kit has
    no ingredients of its own. What can be had from neither is null, an empty array for ingredients and route. A code that
    records repeat is one product, of the record with the smallest generic and brand name.
    """
    r = records.withColumn("name", P.strict_name(F.coalesce("generic", F.lit(""))))
    kit = is_kit(F.col("dosage_form"))
    said_form = F.col("name.dose_form")
    routed = R.route(F.coalesce(_given(F.col("dosage_form")), said_form))
    own = {"ingredients": F.when(~kit, _listed(F.col("ingredients"))), "dosage_form": _given(F.col("dosage_form")), "route": F.when(F.size("route") > 0, F.col("route"))}
    other = {"ingredients": F.when(~kit, _listed(F.col("name.ingredients"))), "dosage_form": F.when(~kit, said_form), "route": F.when(~kit & routed.isNotNull(), F.array(routed))}
    from_name = F.array_join(F.array_compact(F.array(*[F.when(own[c].isNull() & other[c].isNotNull(), c) for c in own])), ",")
    out = {c: F.coalesce(own[c], other[c]) for c in own}
    r = r.select(
        "product_ndc", "generic", "brand", out["dosage_form"].alias("dosage_form"), F.coalesce(out["route"], F.array().cast("array<string>")).alias("route"),
        F.split("product_ndc", "-")[0].alias("labeler_code"), X.clean_labeler(F.col("labeler_name")).alias("labeler"), F.coalesce(out["ingredients"], F.array().cast(INGREDIENTS)).alias("ingredients"), kit.alias("is_kit"), from_name.alias("from_name"),
    )
    rest = [c for c in r.columns if c != "product_ndc"]
    return r.groupBy("product_ndc").agg(F.min(F.struct("generic", "brand", *[c for c in rest if c not in ("generic", "brand")])).alias("r")).select("product_ndc", *[F.col(f"r.{c}").alias(c) for c in rest])


def entity_tables(products: DataFrame) -> dict[str, DataFrame]:
    """The tables of synchronised products that belong to one version: products, labelers, ingredients."""
    i = products.select("product_ndc", F.posexplode("ingredients").alias("place", "i")).select("product_ndc", "place", "i.*")
    labelers = products.groupBy("labeler_code").agg(F.min("labeler").alias("name"), F.count(F.lit(1)).alias("n_products"))
    return {"products": products.drop("ingredients", "labeler"), "labelers": labelers, "ingredients": i}


def repaired_ingredients(products: DataFrame, ingredients: DataFrame, records: DataFrame) -> DataFrame:
    """product_ndc, source, ingredients of the products without ingredients, kits aside: `json` where their own JSON (active_ingredients, an
    array of objects with name or ingredient) names some, `record` where the directory's record does, null with an empty array for what remains."""
    bare = products.where(~is_kit(F.col("dosage_form"))).join(ingredients.select("product_ndc").distinct(), "product_ndc", "left_anti")
    parsed = F.from_json("active_ingredients", "array<struct<name:string,ingredient:string,strength:string,unit:string>>")
    named = F.transform(parsed, lambda i: F.struct(F.coalesce(_given(i["name"]), _given(i["ingredient"])).alias("name"), i["strength"].alias("strength"), i["unit"].alias("unit")))
    own = bare.select("product_ndc", _listed(named).alias("own"))
    fresh = synchronised(records.join(own.where("own IS NULL").select("product_ndc"), "product_ndc", "left_semi")).select("product_ndc", F.when(F.size("ingredients") > 0, F.col("ingredients")).alias("fresh"))
    out = own.join(fresh, "product_ndc", "left")
    source = F.when(F.col("own").isNotNull(), "json").when(F.col("fresh").isNotNull(), "record")
    return out.select("product_ndc", source.alias("source"), F.coalesce("own", "fresh", F.array().cast(INGREDIENTS)).alias("ingredients"))
