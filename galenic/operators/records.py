"""Product records from end to end: resources, repairs, class correction, link groups, order reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.records import package_info
from . import inference as I, matching as M


def inner(text: Column) -> Column:
    """The package that stands inside: of a description that names itself loose, none."""
    last = F.concat(F.lit("/"), F.element_at(F.split(text, "/"), -1))
    return F.when(F.contains(text, F.lit("loose bulk")), F.lit(None)).otherwise(package_info(last))


def product_resource(products: DataFrame, labelers: DataFrame, ingredients: DataFrame, packages: DataFrame) -> DataFrame:
    """One row per product with its labeler, its ingredients by name and its packages by code, nested; empty arrays where it has
    none. Children are gathered by product before they are joined."""
    i = ingredients.groupBy("product_ndc").agg(F.array_sort(F.collect_list(F.struct("name", "strength", "unit"))).alias("ingredients"))
    k = packages.groupBy("product_ndc").agg(F.array_sort(F.collect_list(F.concat_ws("-", "product_ndc", "package_code"))).alias("packaged_products"))
    l = labelers.select(F.col("code").alias("labeler_code"), F.col("name").alias("labeler_name"))
    p = products.join(l, "labeler_code", "left").join(i, "product_ndc", "left").join(k, "product_ndc", "left")
    strength = F.concat_ws(" ", F.col("strength").cast("int").cast("string"), "unit")
    return p.select(
        "product_ndc", F.col("generic").alias("generic_name"), F.col("brand").alias("brand_name"), "labeler_name", "labeler_code", "dosage_form", "active",
        F.concat_ws(" ", "generic", strength, F.lower("dosage_form")).alias("description"), F.coalesce("ingredients", F.array()).alias("ingredients"),
        F.coalesce(F.size("ingredients"), F.lit(0)).cast("long").alias("ingredient_count"), F.coalesce("packaged_products", F.array()).alias("packaged_products"),
    ).withColumn("ingredient_count", F.greatest("ingredient_count", F.lit(0)))


#: Levels in the order in which they are preferred; others follow.
PREFERRED = ("SCSD", "SCD")


def selected_concept(related: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """key, concept_rxcui, n_related: of each key's distinct related concepts (key, rxcui) the first of a preferred level, else the
    first by id."""
    rank = F.lit(len(PREFERRED))
    for k, tty in reversed(list(enumerate(PREFERRED))):
        rank = F.when(F.col("tty") == tty, k).otherwise(rank)
    found = related.distinct().join(concepts.select("rxcui", "tty").distinct(), "rxcui")
    return found.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "rxcui")).alias("first"), F.count(F.lit(1)).alias("n_related")).select(key, F.col("first.rxcui").alias("concept_rxcui"), "n_related")


def labelers_updated(products: DataFrame, labelers: DataFrame, order: str) -> DataFrame:
    """product_ndc, the order column, labeler_name, labeler_code, created: by name; a name that no labeler has makes one, coded by the
    first five-digit segment of its first product's code."""
    known = labelers.groupBy(F.col("name").alias("labeler_name")).agg(F.min("code").alias("code"))
    missing = products.join(known, "labeler_name", "left_anti").where(F.col("labeler_name").isNotNull())
    made = missing.groupBy("labeler_name").agg(F.lpad(F.split(F.min_by("product_ndc", order), "-")[0], 5, "0").alias("made"))
    out = products.join(known, "labeler_name", "left").join(made, "labeler_name", "left")
    return out.select("product_ndc", order, "labeler_name", F.coalesce("code", "made").alias("labeler_code"), F.col("made").isNotNull().alias("created"))


def bracketed(route: Column) -> Column:
    return F.when(F.startswith(route, F.lit("[")) & F.endswith(route, F.lit("]")), route).otherwise(F.concat(F.lit("["), route, F.lit("]")))


def mapped_concepts(products: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """key, concept_rxcui: the concept that a product's mapping (JSON) names, if there is such a concept."""
    named = products.select(*key, F.get_json_object("rxcui_mapping", "$.concept_rxcui").alias("concept_rxcui")).where(F.col("concept_rxcui").isNotNull())
    return named.join(concepts.select(F.col("rxcui").alias("concept_rxcui")).distinct(), "concept_rxcui", "left_semi").select(*key, "concept_rxcui")


def children_replaced(children: DataFrame, parents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The children of all others, and the new ones of the given parents."""
    return children.join(parents.distinct(), key, "left_anti").unionByName(new)


def classes_resolved(boxes: DataFrame, codes: DataFrame, lots: DataFrame) -> DataFrame:
    """The boxes with source (ndc, lot or null), class_label as the code's or else the lot's form says, and corrected."""
    by_code = codes.select("ndc", F.col("form").alias("n_form"))
    by_lot = lots.select("lot", F.col("form").alias("l_form"))
    b = boxes.join(by_code, "ndc", "left").join(by_lot, "lot", "left")
    form = F.coalesce("n_form", "l_form")
    source = F.when(F.col("n_form").isNotNull(), "ndc").when(F.col("l_form").isNotNull(), "lot")
    return b.withColumn("source", source).withColumn("corrected", F.coalesce(form != F.col("class_label"), F.lit(False))).withColumn("class_label", F.coalesce(form, "class_label")).drop("n_form", "l_form")


def classes_propagated(boxes: DataFrame, area_ratio: float = 0.85, aspect_difference: float = 0.10) -> DataFrame:
    """Unresolved boxes take over the class of the first corrected box of their image that is alike in mask and aspect: peer is its id."""
    d = boxes.withColumn("aspect", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    anchors = d.where("corrected").select("run", "image", F.col("pos").alias("a_pos"), F.col("instance_id").alias("a_id"), F.col("class_label").alias("a_label"), F.col("mask_area").alias("a_area"), F.col("aspect").alias("a_aspect"))
    alike = (F.least("mask_area", "a_area") / F.greatest("mask_area", "a_area") >= area_ratio) & (F.abs(F.col("aspect") - F.col("a_aspect")) <= aspect_difference)
    first = d.where(F.col("source").isNull()).join(anchors, ["run", "image"]).where(alike).groupBy("run", "image", "instance_id").agg(F.min(F.struct("a_pos", "a_id", "a_label")).alias("a"))
    out = boxes.join(first, ["run", "image", "instance_id"], "left")
    return out.withColumn("class_label", F.coalesce("a.a_label", "class_label")).withColumn("peer", F.col("a.a_id")).drop("a")


def link_groups(scores: DataFrame, group: list[str], least: float = 3.0, margin: float = 1.0) -> DataFrame:
    """group, grp (smallest id), n_left, n_right, status: what pairs (i, j) connect whose score is good enough and within the margin of
    either side's best. Components are found image by image, which hold tens of boxes."""
    best_i, best_j = F.max("score").over(Window.partitionBy(*group, "i")), F.max("score").over(Window.partitionBy(*group, "j"))
    e = scores.withColumn("bi", best_i).withColumn("bj", best_j)
    e = e.where((F.col("score") >= least) & ((F.col("score") >= F.col("bi") - margin) | (F.col("score") >= F.col("bj") - margin))).select(*group, "i", "j")

    def grouped(pairs: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in zip(pairs["i"], pairs["j"], strict=True):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        each = pairs.assign(grp=[root(i) for i in pairs["i"]]).groupby("grp").agg(n_left=("i", "nunique"), n_right=("j", "nunique")).reset_index()
        for g in group:
            each[g] = pairs[g].iat[0]
        each["status"] = ["unique" if a == b == 1 else "ambiguous_group" for a, b in zip(each["n_left"], each["n_right"], strict=True)]
        return each[[*group, "grp", "n_left", "n_right", "status"]]

    schema = ", ".join(f"{g} long" for g in group) + ", grp long, n_left long, n_right long, status string"
    return e.groupBy(*group).applyInPandas(grouped, schema)


def order_reports(expected: DataFrame, found: DataFrame) -> DataFrame:
    """order_id, n_components, n_found, n_discrepant, verified, process, report: each order's components checked against what was
    found, the process they imply, and a line for each component with a verdict."""
    o = reports_of(M.order_sides(expected, found, "generic"))
    process = I.inferred_process(expected.withColumnRenamed("order_id", "tray_id")).select(F.col("tray_id").alias("order_id"), F.col("description").alias("process"))
    return o.join(process, "order_id", "left").select("order_id", "n_components", "n_found", "n_discrepant", "verified", "process", "report")


def reports_of(sides: DataFrame) -> DataFrame:
    """order_reports() without the process, from both sides of each order (`verified_sides`; e has the generic name too)."""
    line = F.concat(F.lit("["), F.when(F.col("discrepant"), "DISCREPANT").otherwise("OK"), F.lit("] "), "e.generic", F.lit(" ("), "e.package_ndc", F.lit(")"))
    o = M.verified_sides(sides).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if("found").alias("n_found"), F.count_if("discrepant").alias("n_discrepant"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
    )
    verdict = F.when(F.col("n_discrepant") == 0, "All components verified.").otherwise(F.concat(F.col("n_discrepant").cast("string"), F.lit(" discrepancy(ies) require review.")))
    return o.select("order_id", "n_components", "n_found", "n_discrepant", (F.col("n_discrepant") == 0).alias("verified"), F.concat_ws("\n", "lines", verdict).alias("report"))


def browsed(rows: DataFrame, order: list[Column], name: str = "", determination: str = "", confidence: float = 0.0, n_products: int = 0, size: int = 50, number: int = 1) -> DataFrame:
    """A page of classified labelers that match, each row with the number of all that do."""
    found = rows.where((F.col("confidence") >= confidence) & (F.col("n_products") >= n_products))
    if name:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if determination:
        found = found.where(F.col("determination") == determination)
    n = found.agg(F.count(F.lit(1)).alias("n_matching"))  # one row, which goes to every task
    return found.orderBy(*order).offset(size * (number - 1)).limit(size).join(F.broadcast(n))


def first_entries(products: DataFrame, asked: str, order: Column, most: int = 20) -> DataFrame:
    """The first products in order whose generic name holds what is asked for; fewer than three letters ask for nothing."""
    word = asked.strip().lower()
    return products.where(F.contains(F.lower("generic"), F.lit(word)) if len(word) >= 3 else F.lit(False)).orderBy(order).limit(most)


def relevance_split(generics: DataFrame, concepts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """generic, rxcui, relevance: concepts that name a generic, without confirmed ones; close if they have no more ingredients than
    it. Names are compared by their first word first, so that no name meets all others."""
    n = lambda c: F.size(F.split(c, " and "))
    g = generics.select("generic", n(F.col("generic")).alias("n"), F.split(F.lower("generic"), " ")[0].alias("word"))
    c = concepts.join(confirmed, "rxcui", "left_anti").select("rxcui", "name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word"))
    hit = c.join(g, "word").where(F.contains(F.lower("name"), F.lower("generic")))
    return hit.select("generic", "rxcui", F.when(n(F.col("name")) <= F.col("n"), "close").otherwise("obscure").alias("relevance"))


def image_reports(assigned: DataFrame, slots: DataFrame) -> DataFrame:
    """run, image, n_assigned, n_forced, n_out_of_inventory, n_excess, n_empty: of each image's boxes, and slots that none of them fills."""
    count = lambda s: F.count_if(F.col("status") == s)
    filled = F.count_distinct(F.when(F.col("status").isin("assigned", "forced"), F.col("slot")))
    r = assigned.groupBy("run", "image").agg(count("assigned").alias("n_assigned"), count("forced").alias("n_forced"), count("out_of_inventory").alias("n_out_of_inventory"), count("excess").alias("n_excess"), filled.alias("filled"))
    n = slots.groupBy("run").agg(F.count(F.lit(1)).alias("n_slots"))
    return r.join(n, "run", "left").select("run", "image", "n_assigned", "n_forced", "n_out_of_inventory", "n_excess", (F.coalesce("n_slots", F.lit(0)) - F.col("filled")).alias("n_empty"))


def edges_upserted(old: DataFrame, new: DataFrame, strength: Column) -> DataFrame:
    """source, rela, target, strength: edges by key, new ones added once; strength is a hook over the key's columns."""
    keys = ["source", "rela", "target"]
    return old.select(*keys).unionByName(new.select(*keys)).distinct().withColumn("strength", strength)


def clamped(boxes: DataFrame, x1: int, y1: int, x2: int, y2: int, least_mask: float) -> DataFrame:
    """Boxes whose mask has at least so many pixels, cut to the frame, without empty ones."""
    b = boxes.where(F.col("mask_area") >= least_mask).withColumns({"x1": F.greatest("x1", F.lit(x1)), "y1": F.greatest("y1", F.lit(y1)), "x2": F.least("x2", F.lit(x2)), "y2": F.least("y2", F.lit(y2))})
    return b.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
