"""Queries that search the directory by name and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..operators import lookup as K
from ..storage import stored
from ..views import with_views
from .registry import query


def directory(spark: SparkSession, d: str) -> DataFrame:
    """entry, generic, brand, route, dosage_form, ingredients of every product; kits list no ingredients."""
    form = F.col("dosage_form")
    route = F.when(form.startswith("INJECTION"), "INTRAVENOUS").when(form == "TABLET", "ORAL")
    return V.products(spark, d).select(F.col("part_id").alias("entry"), "generic", "brand", route.alias("route"), "dosage_form", F.when(form != "KIT", F.split("generic", " and ")).alias("ingredients"), "product_ndc")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every concept's name asked as a generic name, brand names also as brands; combined names turned round and cut short, as generic and as brand; and
    every pair of name and dosage form."""
    c = stored(V.concepts(spark, d), "concepts")
    none, name = F.lit(None).cast("string"), F.col("name")
    ask = lambda rows, kind, generic=none, brand=none, form=none: rows.select(F.concat(F.lit(kind + ":"), "rxcui").alias("question"), generic.alias("generic"), brand.alias("brand"), none.alias("route"), form.alias("dosage_form"), F.lit(None).cast("array<string>").alias("ingredients"))
    combined = c.where((F.col("tty") == "IN") & name.contains(" and ")).withColumn("p", F.split("name", " and "))
    turned = F.array_join(F.reverse("p"), " AND ")
    cut = F.array_join(F.transform("p", lambda x: F.substring(x, 1, 5)), " and ")
    brands = c.where(F.col("tty") == "BN")
    forms = V.products(spark, d).select(F.concat_ws("/", "generic", "dosage_form").alias("rxcui"), "generic", "dosage_form").distinct()
    asked = [ask(c, "name", name), ask(brands, "brand", brand=name), ask(combined, "turned", turned), ask(combined, "cut", cut), ask(combined, "cut brand", brand=cut), ask(forms, "form", F.col("generic"), form=F.col("dosage_form"))]
    out = asked[0]
    for more in asked[1:]:
        out = out.unionByName(more)
    return out


def _says(column: str, phrase: str, open_: bool = False) -> str:
    said = f"array_to_string(regexp_extract_all(lower({phrase}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
    return f"contains({column}, ' ' || {said}{'' if open_ else " || ' '"})"


def _where(generic: str | None = None, brand: str | None = None, parts: str | None = None, open_: bool = False) -> str:
    tests = [f"(q.dosage_form IS NULL OR {_says('d.f', 'q.dosage_form')})"]
    tests += [f"{_says('d.g', generic)}"] if generic else []
    tests += [f"({brand} IS NULL OR {_says('d.b', brand)})"] if brand else []
    if parts:
        tests.append(f"len(list_filter({parts}, lambda x: len(list_filter(d.i, lambda y: {_says('y', 'x', open_)})) = 0)) = 0")
    return " AND ".join(tests)


_SPACED = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"
_PARTS = "regexp_split_to_array({}, '(?i) and ')"


def _tier(name: str, earlier: list[str], wanted: str, where: str, via: str) -> str:
    left = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {e} a WHERE a.question = q.question)" for e in earlier) or "true"
    return f"{name} AS (SELECT q.question, {via} AS matched_via, d.entry FROM (SELECT * FROM q WHERE {left} AND {wanted}) q JOIN d ON {where})"


_GENERIC_LOOKUP = (
    f""", d AS (SELECT part_id AS entry, generic, brand, {_SPACED.format('generic')} AS g, {_SPACED.format('brand')} AS b, {_SPACED.format('dosage_form')} AS f,
    CASE WHEN dosage_form <> 'KIT' THEN list_transform(string_split(generic, ' and '), lambda x: {_SPACED.format('x')}) ELSE [] END AS i FROM v_products),
    p AS (SELECT *, string_split(name, ' and ') AS p FROM v_concepts WHERE tty = 'IN' AND contains(name, ' and ')),
    q AS (SELECT 'name:' || rxcui AS question, name AS generic, NULL AS brand, NULL AS dosage_form FROM v_concepts
      UNION ALL SELECT 'brand:' || rxcui, NULL, name, NULL FROM v_concepts WHERE tty = 'BN'
      UNION ALL SELECT 'turned:' || rxcui, array_to_string(list_reverse(p), ' AND '), NULL, NULL FROM p
      UNION ALL SELECT 'cut:' || rxcui, array_to_string(list_transform(p, lambda x: x[1:5]), ' and '), NULL, NULL FROM p
      UNION ALL SELECT 'cut brand:' || rxcui, NULL, array_to_string(list_transform(p, lambda x: x[1:5]), ' and '), NULL FROM p
      UNION ALL SELECT DISTINCT 'form:' || generic || '/' || dosage_form, generic, NULL, dosage_form FROM v_products), """
    + ", ".join(
        [
            _tier("a1", [], "generic IS NOT NULL", _where("q.generic", "q.brand"), "'generic_name'"),
            _tier("a2", [], "generic IS NULL", _where(None, "q.brand"), "'brand_name'"),
            _tier("a3", ["a1", "a2"], f"len({_PARTS.format('generic')}) > 1", _where(None, "q.brand", _PARTS.format("q.generic")), "'generic_name_split'"),
            _tier("a4", ["a1", "a2", "a3"], f"len({_PARTS.format('generic')}) > 1", _where(None, "q.brand", _PARTS.format("q.generic"), True), "'generic_name_split_wildcard'"),
            _tier("a5", ["a1", "a2", "a3", "a4"], "generic IS NOT NULL AND brand IS NULL", _where(None, "q.generic"), "'generic_as_brand'"),
            _tier("a6", ["a2"], f"generic IS NULL AND len({_PARTS.format('brand')}) > 1", _where(None, None, _PARTS.format("q.brand"), True), "'brand_name_split_wildcard'"),
        ]
    )
    + f""", n AS (SELECT a.question, arg_min(d.generic, d.entry) AS first FROM (SELECT * FROM a2 UNION ALL SELECT * FROM a6) a JOIN d ON d.entry = a.entry GROUP BY 1),
    a7 AS (SELECT q.question, 'brand_name_narrowed' AS matched_via, d.entry FROM n JOIN q ON q.question = n.question JOIN d ON {_where('n.first', 'q.brand')}),
    a AS (SELECT * FROM a7 UNION ALL SELECT * FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5 UNION ALL SELECT * FROM a6) x WHERE question NOT IN (SELECT question FROM a7)),
    r AS (SELECT a.question, a.matched_via, a.entry, CASE WHEN q.generic IS NOT NULL THEN CASE WHEN lower(d.generic) = lower(q.generic) THEN 0 WHEN starts_with(lower(d.generic), lower(q.generic)) THEN 1 ELSE 2 END
      WHEN lower(d.brand) = lower(q.brand) THEN 0 WHEN starts_with(lower(d.brand), lower(q.brand)) THEN 1 ELSE 2 END AS rank FROM a JOIN q ON q.question = a.question JOIN d ON d.entry = a.entry)
    SELECT q.question, min(r.matched_via) AS matched_via, count(r.entry) AS n, count(CASE WHEN r.rank = 0 THEN 1 END) AS n_exact, arg_min(r.entry, r.rank * 1000000000000 + r.entry) AS best FROM q LEFT JOIN r ON r.question = q.question GROUP BY 1"""
)


@query("generic_lookup", with_views(_GENERIC_LOOKUP, "v_products", "v_concepts").replace(") , d AS", "), d AS"))
def generic_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How each question is answered, by how many products, and by which best of all; questions without answers too."""
    asked = stored(questions(spark, d), "questions")
    per = K.lookup_counts(asked, directory(spark, d))
    none = F.lit(0).cast("long")
    return asked.select("question").join(per, "question", "left").select("question", "matched_via", F.coalesce("n", none).alias("n"), F.coalesce("n_exact", none).alias("n_exact"), "best")


@query(
    "package_lookup",
    with_views(
        """, k AS (SELECT product_ndc || '-' || package_code AS package_ndc, product_ndc FROM v_packages), c AS (SELECT DISTINCT replace(package_ndc, '-', '') AS code FROM k UNION SELECT DISTINCT product_ndc FROM k),
        t AS (SELECT code, code AS key FROM c WHERE contains(code, '-') UNION SELECT code, x FROM (SELECT code, unnest([CASE WHEN code[1] = '0' THEN code[2:5] || '-' || code[6:9] || '-' || code[10:11] END, CASE WHEN code[6] = '0' THEN code[1:5] || '-' || code[7:9] || '-' || code[10:11] END,
          CASE WHEN code[10] = '0' THEN code[1:5] || '-' || code[6:9] || '-' || code[11] END, CASE WHEN code[1] <> '0' AND code[6] <> '0' AND code[10] <> '0' THEN code[1:5] || '-' || code[6:9] || '-' || code[10:11] END]) AS x FROM c WHERE NOT contains(code, '-')) WHERE x IS NOT NULL)
        SELECT t.code, count(DISTINCT k.package_ndc) AS n, count(DISTINCT CASE WHEN k.package_ndc = t.key THEN k.package_ndc END) AS n_packages FROM t JOIN k ON k.package_ndc = t.key OR k.product_ndc = t.key GROUP BY 1""",
        "v_packages",
    ).replace(") , k AS", "), k AS"),
)
def package_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Packages that printed digits and product codes lead to, and how many of them by their own code."""
    package = F.concat_ws("-", "product_ndc", "package_code")
    packages = V.packages(spark, d).select(package.alias("entry"), package.alias("package_ndc"), "product_ndc").distinct()
    codes = packages.select(F.replace("package_ndc", F.lit("-"), F.lit("")).alias("code")).unionByName(packages.select(F.col("product_ndc").alias("code")))
    found = K.lookup_packages(codes, packages)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("field") == "package_ndc").alias("n_packages"))
