"""Queries over ingested JSON records, kit links and shared fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..operators import etl as E, ingest as O
from ..views import with_views
from .registry import query


@query(
    "labeler_index",
    with_views(
        """, e AS (SELECT CAST(code AS INTEGER) AS pos, name, unnest([code, lpad(CAST(CAST(code AS INTEGER) // 3 AS VARCHAR), 5, '0')]) AS c FROM v_labelers)
        SELECT c AS code, arg_max(name, pos) AS name FROM e GROUP BY 1""",
        "v_labelers",
    ),
)
def labeler_index(spark: SparkSession, d: str) -> DataFrame:
    """Each labeler's entry holds its own code and that of a third of its number, which others hold too."""
    pos = F.col("code").cast("int")
    third = F.lpad(F.expr("CAST(CAST(code AS INT) div 3 AS STRING)"), 5, "0")
    entries = V.labelers(spark, d).select(pos.alias("pos"), F.to_json(F.create_map("name", F.struct(F.array("code", third).alias("codes")))).alias("json"))
    return O.labeler_index(entries)


@query(
    "ingredient_rows",
    with_views(
        """SELECT part_id, name, CASE WHEN part_id % 3 = 0 AND name = split_part(generic, ' and ', 1) THEN '99' ELSE CAST(CAST(strength AS INTEGER) AS VARCHAR) END AS strength, CASE WHEN part_id % 3 = 0 AND name = split_part(generic, ' and ', 1) THEN 'G' ELSE 'MG' END AS unit
        FROM (SELECT *, unnest(string_split(generic, ' and ')) AS name FROM v_products WHERE dosage_form <> 'KIT')""",
        "v_products",
    ),
)
def ingredient_rows(spark: SparkSession, d: str) -> DataFrame:
    """Products' JSON lists; every third names its first ingredient again, under the other key and with another strength."""
    p, size = V.products(spark, d), F.col("strength").cast("int").cast("string")
    null = F.lit(None).cast("string")
    one = lambda x, y, s, u: F.struct(x.alias("ingredient"), y.alias("name"), s.alias("strength"), u.alias("unit"))
    names = F.split("generic", " and ")
    each = F.transform(names, lambda x: one(x, null, size, F.lit("MG")))
    again = F.when(F.col("part_id") % 3 == 0, F.array(one(null, names[0], F.lit("99"), F.lit("G")))).otherwise(F.slice(each, 1, 0))
    return O.ingredient_rows(p.select("part_id", F.when(F.col("dosage_form") != "KIT", F.to_json(F.concat(each, again))).alias("json")), "part_id")


@query(
    "product_columns",
    with_views(
        """SELECT part_id, CASE WHEN part_id % 4 <> 0 THEN part_id * 7 END AS rxid, CAST(n AS INTEGER) AS ingredient_count FROM (SELECT *, CASE WHEN dosage_form = 'KIT' THEN 0 ELSE len(string_split(generic, ' and ')) END AS n FROM v_products) WHERE n <= 1""",
        "v_products",
    ),
)
def product_columns(spark: SparkSession, d: str) -> DataFrame:
    """Computed columns of products of one ingredient at most; every fourth id isn't a number."""
    rxcui = F.when(F.col("part_id") % 4 == 0, F.concat(F.lit("N"), F.col("part_id").cast("string"))).otherwise((F.col("part_id") * 7).cast("string"))
    names = F.when(F.col("dosage_form") != "KIT", F.split("generic", " and "))
    return O.with_at_most(V.products(spark, d), names, 1).select("part_id", O.row_number_of(rxcui).alias("rxid"), "ingredient_count")


@query(
    "kit_component_links",
    with_views(
        """, k AS (SELECT a.product_ndc, b.product_ndc AS component_ndc, b.generic AS name, b.part_id FROM v_products a JOIN v_products b ON b.part_id = a.part_id + 1 WHERE a.dosage_form = 'KIT'),
        r AS (SELECT k.product_ndc, k.component_ndc, k.name, CASE length(k.name) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'IN:' || k.name ELSE 'IN:no ' || k.name END AS rxcui FROM k)
        SELECT r.product_ndc, r.component_ndc, r.name, r.rxcui, c.name AS concept FROM r LEFT JOIN v_concepts c ON c.rxcui = r.rxcui""",
        "v_concepts",
    ),
)
def kit_component_links(spark: SparkSession, d: str) -> DataFrame:
    """Components of kits, by name with a known id, an unknown one or none."""
    p = V.products(spark, d)
    following = p.select((F.col("part_id") - 1).alias("part_id"), F.col("product_ndc").alias("one"))
    kits = p.where(F.col("dosage_form") == "KIT").join(following, "part_id")
    parts = E.kit_components(kits.select("product_ndc", F.concat(F.lit("1 VIAL ("), "one", F.lit("-02)")).alias("description")), p)
    n = F.length("name") % 3
    rxcui = F.when(n == 1, F.concat(F.lit("IN:"), "name")).when(n == 2, F.concat(F.lit("IN:no "), "name"))
    return O.linked_components(parts.select("product_ndc", "component_ndc", "name", rxcui.alias("rxcui")), V.concepts(spark, d)).select("product_ndc", "component_ndc", "name", "rxcui", "concept")


@query(
    "inferred_fields",
    with_views(
        """, c AS (SELECT run, image, class_label, count(*) AS members, arg_min(lot, pos) FILTER (lot IS NOT NULL) AS lot, arg_min(ndc, pos) FILTER (ndc IS NOT NULL) AS ndc, arg_min(exp, pos) FILTER (exp IS NOT NULL) AS exp FROM v_detections GROUP BY 1, 2, 3),
        s AS (SELECT b.run, b.image, b.class_label, greatest(a.members, b.members) AS members, concat_ws(',', CASE WHEN a.lot = b.lot THEN 'lot' END, CASE WHEN a.ndc = b.ndc THEN 'ndc' END, CASE WHEN a.exp = b.exp THEN 'exp' END) AS shared
          FROM c a JOIN c b ON a.run = b.run AND a.class_label = b.class_label AND a.image = 0 AND b.image <> 0)
        SELECT run, image, class_label, shared, CASE WHEN members > 1 THEN shared ELSE '' END AS inferred FROM s""",
        "v_detections",
    ),
)
def inferred_fields(spark: SparkSession, d: str) -> DataFrame:
    return O.shared_fields(O.merged_classes(V.detections(spark, d)))
