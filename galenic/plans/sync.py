"""Queries that bring products up to date and compare pictures' descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..functions import geometry as G
from ..operators import sync as S
from ..views import with_views
from .registry import query


def records(spark: SparkSession, d: str) -> DataFrame:
    """Directory records of every product: some name strength and form in the generic name and list nothing else, some lack their route, some everything."""
    i, size = F.col("part_id"), F.col("strength").cast("int").cast("string")
    makers = V.labelers(spark, d).select(F.col("code").alias("labeler_code"), F.col("name").alias("labeler_name"))
    p = V.products(spark, d).join(makers, "labeler_code", "left")
    first = F.split("generic", " and ")[0]
    listed = F.transform(F.split("generic", " and "), lambda n: F.struct(n.alias("name"), size.alias("strength"), F.lit("MG").alias("unit")))
    return p.select(
        "product_ndc", F.when(i % 3 == 0, F.concat(first, F.lit(" "), size, F.lit(" MG Oral Tablet"))).otherwise(F.col("generic")).alias("generic"), "brand",
        F.when((i % 3 != 0) | (F.col("dosage_form") == "KIT"), F.col("dosage_form")).alias("dosage_form"), F.when(i % 4 == 0, F.array(F.lit("TOPICAL"))).alias("route"), "labeler_name", F.when(i % 3 == 1, listed).alias("ingredients"),
    )


_RECORDS = """, r AS (SELECT p.product_ndc, CASE WHEN part_id % 3 = 0 THEN split_part(generic, ' and ', 1) || ' ' || CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' MG Oral Tablet' ELSE generic END AS generic, brand,
      CASE WHEN part_id % 3 <> 0 OR dosage_form = 'KIT' THEN dosage_form END AS form, CASE WHEN part_id % 4 = 0 THEN 'TOPICAL' END AS route, CASE WHEN part_id % 3 = 1 THEN list_transform(string_split(generic, ' and '), lambda n: n || ' ' || CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' MG') END AS listed, part_id FROM v_products p),
    s AS (SELECT *, coalesce(form = 'KIT', false) AS kit, regexp_extract(generic, '^(.+) ([0-9]+) MG (.+)$', 1) AS n, regexp_extract(generic, '^(.+) ([0-9]+) MG (.+)$', 2) AS amount, nullif(regexp_extract(generic, '^(.+) ([0-9]+) MG (.+)$', 3), '') AS f FROM r),
    u AS (SELECT *, CASE WHEN kit THEN [] WHEN listed IS NOT NULL THEN listed WHEN n <> '' THEN [n || ' ' || amount || ' MG'] ELSE [] END AS i, coalesce(form, CASE WHEN NOT kit THEN f END) AS dosage_form,
      CASE WHEN kit THEN NULL WHEN contains(lower(coalesce(form, f)), 'inject') THEN 'INTRAVENOUS' WHEN contains(lower(coalesce(form, f)), 'oral') OR contains(lower(coalesce(form, f)), 'tablet') THEN 'ORAL' END AS routed FROM s)"""


@query(
    "product_sync",
    with_views(
        _RECORDS + """ SELECT product_ndc, dosage_form, coalesce(route, routed, '') AS route, array_to_string(i, '; ') AS ingredients, kit AS is_kit,
        array_to_string(list_filter([CASE WHEN NOT kit AND listed IS NULL AND n <> '' THEN 'ingredients' END, CASE WHEN form IS NULL AND NOT kit AND f IS NOT NULL THEN 'dosage_form' END, CASE WHEN route IS NULL AND routed IS NOT NULL THEN 'route' END], lambda x: x IS NOT NULL), ',') AS from_name FROM u""",
        "v_products",
    ).replace(") , r AS", "), r AS"),
)
def product_sync(spark: SparkSession, d: str) -> DataFrame:
    """Products as their records and, where those say nothing, their generic names have them."""
    p = S.synchronised(records(spark, d))
    names = F.transform("ingredients", lambda i: F.concat_ws(" ", i["name"], i["strength"], i["unit"]))
    return p.select("product_ndc", "dosage_form", F.array_join("route", ",").alias("route"), F.array_join(names, "; ").alias("ingredients"), "is_kit", "from_name")


@query(
    "ingredient_repair",
    with_views(
        _RECORDS + """, b AS (SELECT p.*, CASE p.part_id % 7 WHEN 0 THEN p.generic || ' 1 g' WHEN 1 THEN p.brand || '  ' END AS own FROM v_products p WHERE p.dosage_form <> 'KIT' AND p.part_id % 5 <> 0)
        SELECT b.product_ndc, CASE WHEN own IS NOT NULL THEN 'json' WHEN len(u.i) > 0 THEN 'record' END AS source, CASE WHEN own IS NOT NULL THEN own ELSE array_to_string(u.i, '; ') END AS ingredients FROM b JOIN u ON u.part_id = b.part_id""",
        "v_products",
    ).replace(") , r AS", "), r AS"),
)
def ingredient_repair(spark: SparkSession, d: str) -> DataFrame:
    """Ingredients of the products that have none, by their own JSON or their records; those that remain too."""
    i = F.col("part_id")
    one = lambda key, name, strength, unit: F.to_json(F.array(F.struct(name.alias(key), F.lit(strength).alias("strength"), F.lit(unit).alias("unit"))))
    own = F.when(i % 7 == 0, one("name", F.col("generic"), "1", "g")).when(i % 7 == 1, one("ingredient", F.col("brand"), None, " ")).when(i % 7 == 2, one("name", F.lit(" "), "1", "g"))
    p = V.products(spark, d).select("product_ndc", "dosage_form", "part_id", own.alias("active_ingredients"))
    fixed = S.repaired_ingredients(p, p.where(i % 5 == 0).select("product_ndc"), records(spark, d))
    return fixed.select("product_ndc", "source", F.array_join(F.transform("ingredients", lambda x: F.concat_ws(" ", x["name"], x["strength"], x["unit"])), "; ").alias("ingredients"))


def _signs(c: str) -> str:
    return f"list_transform([0, 1, 2, 3], lambda k: list_sum(list_transform(range(1, 17), lambda j: CASE WHEN {c}[k * 16 + j] > 0 THEN CAST(1 AS BIGINT) << (j - 1) ELSE 0 END)))"


@query(
    "visual_likeness",
    f"""WITH e AS (SELECT vec_id, embedding AS v, {_signs('embedding')} AS d FROM embeddings),
    p AS (SELECT a.vec_id AS id, b.vec_id AS other, a.v AS v, b.v AS w, a.d AS d, b.d AS f FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT *, list_avg(list_transform(v, lambda x: CAST(x AS DOUBLE))) AS mv, list_avg(list_transform(w, lambda x: CAST(x AS DOUBLE))) AS mw, list_transform(d, lambda x: list_transform(f, lambda y: bit_count(xor(x::BIGINT, y::BIGINT)))) AS h FROM p),
    n AS (SELECT *, list_transform(h, lambda r: list_position(r, list_min(r))) AS near, list_transform([1, 2, 3, 4], lambda j: list_position(list_transform(h, lambda r: r[j]), list_min(list_transform(h, lambda r: r[j])))) AS back FROM m),
    c AS (SELECT *, list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - mv) * (w[k] - mw))) AS vw, list_sum(list_transform(v, lambda x: (x - mv) * (x - mv))) AS vv, list_sum(list_transform(w, lambda x: (x - mw) * (x - mw))) AS ww FROM n)
    SELECT id, other, round((vw / sqrt(vv * ww) + 1) / 2, 5) AS histogram, len(list_filter([1, 2, 3, 4], lambda k: back[near[k]] = k AND h[k][near[k]] < 6)) / 4 AS descriptors FROM c""",
)
def visual_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next: as histograms, and cut into four descriptors of sixteen signs, how many match mutually with fewer than six differing bits."""
    bits = lambda k: F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.when(F.get("v", k * 16 + j - 1) > 0, F.pow(F.lit(2.0), j - 1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", "v", F.transform(F.sequence(F.lit(0), F.lit(3)), bits).alias("d"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("v").alias("w"), F.col("d").alias("f"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id"), "other", F.round(G.correlation_likeness(F.col("v"), F.col("w")), 5).alias("histogram"), G.mutual_matches(F.col("d"), F.col("f"), 6).alias("descriptors"))
