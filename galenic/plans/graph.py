"""Queries over the concept graph and the facility tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..operators import catalog as C, graph as G, lookup as K
from ..views import with_views
from .registry import query

_RULES = "((s.tty = 'SCDC' AND rela = 'has_ingredient' AND t.tty = 'IN') OR (s.tty = 'SCD' AND rela = 'consists_of' AND t.tty = 'SCDC') OR (s.tty = 'IN' AND rela = 'has_tradename' AND t.tty = 'BN') OR (s.tty = 'SCD' AND rela = 'has_tradename' AND t.tty = 'SBD') OR (s.tty = 'SBD' AND rela = 'has_ingredient' AND t.tty = 'BN'))"


@query("graph_family", with_views(f"SELECT source, rela, target, s.tty AS s_tty, t.tty AS t_tty FROM v_edges JOIN v_concepts s ON s.rxcui = source JOIN v_concepts t ON t.rxcui = target WHERE s.suppress NOT IN ('Y', 'O', 'E') AND t.suppress NOT IN ('Y', 'O', 'E') AND source <> target AND {_RULES}", "v_concepts", "v_edges"))
def graph_family(spark: SparkSession, d: str) -> DataFrame:
    return G.family_edges(V.edges(spark, d), V.concepts(spark, d))


@query("semi_join_traversal", with_views("SELECT DISTINCT e.target AS rxcui, e.source AS near FROM v_edges e WHERE e.rela = 'has_ingredient' AND e.target IN (SELECT rxcui FROM v_concepts WHERE tty = 'IN') AND e.source IN (SELECT rxcui FROM v_concepts WHERE tty = 'SCDC')", "v_concepts", "v_edges"))
def semi_join_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Components of each ingredient: one hop against the edges."""
    c = V.concepts(spark, d)
    return G.neighbours(c.where(F.col("tty") == "IN"), V.edges(spark, d), c, "has_ingredient", outgoing=False, tty="SCDC")


@query(
    "brand_chain",
    with_views("SELECT c.source AS rxcui, string_agg(DISTINCT b.target, ' && ' ORDER BY b.target) AS brands FROM v_edges c JOIN v_edges i ON i.source = c.target AND i.rela = 'has_ingredient' JOIN v_edges b ON b.source = i.target AND b.rela = 'has_tradename' WHERE c.rela = 'consists_of' GROUP BY 1", "v_edges"),
)
def brand_chain(spark: SparkSession, d: str) -> DataFrame:
    """From drugs through components and ingredients to brand names."""
    e = V.edges(spark, d)
    hop = lambda rela, a, b: e.where(F.col("rela") == rela).select(F.col("source").alias(a), F.col("target").alias(b))
    chain = hop("consists_of", "rxcui", "scdc").join(hop("has_ingredient", "scdc", "ingredient"), "scdc").join(hop("has_tradename", "ingredient", "brand"), "ingredient")
    return chain.groupBy("rxcui").agg(F.array_join(F.array_sort(F.collect_set("brand")), " && ").alias("brands"))


@query(
    "degree_and_tty",
    with_views("SELECT c.rxcui, c.tty, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM v_concepts c LEFT JOIN (SELECT source, count(*) AS n FROM v_edges GROUP BY 1) o ON o.source = c.rxcui LEFT JOIN (SELECT target, count(*) AS n FROM v_edges GROUP BY 1) i ON i.target = c.rxcui", "v_concepts", "v_edges"),
)
def degree_and_tty(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(V.edges(spark, d), V.concepts(spark, d))


@query(
    "graph_chain_bfs",
    with_views(
        """, b AS (SELECT source AS a, target AS b FROM v_edges UNION SELECT target, source FROM v_edges), w AS (SELECT 'IN:vancomycin' AS rxcui, 0 AS depth UNION SELECT b.b, depth + 1 FROM w JOIN b ON b.a = w.rxcui WHERE depth < 3)
        SELECT rxcui, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""",
        "v_edges", recursive=True,
    ).replace(") , b AS", "), b AS"),
)
def graph_chain_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = V.concepts(spark, d).where(F.col("rxcui") == "IN:vancomycin")
    return G.walk(V.edges(spark, d), start, 3)


@query(
    "graph_bundle",
    with_views(
        """, e AS (SELECT source AS center, 'out' AS direction, rela, target AS near FROM v_edges UNION ALL SELECT target, 'in', rela, source FROM v_edges), l AS (SELECT near FROM e GROUP BY 1 HAVING count(*) = 1)
        SELECT center, direction, rela, tty, count(*) AS n, count(*) >= 6 AS collapsed, CASE WHEN count(*) < 6 THEN string_agg(e.near, '|' ORDER BY e.near) END AS members FROM e JOIN l ON l.near = e.near JOIN v_concepts c ON c.rxcui = e.near GROUP BY 1, 2, 3, 4""",
        "v_concepts", "v_edges",
    ).replace(") , e AS", "), e AS"),
)
def graph_bundle(spark: SparkSession, d: str) -> DataFrame:
    return G.bundled(V.edges(spark, d), V.concepts(spark, d))


@query(
    "branch_paging",
    with_views(
        """, r AS (SELECT source, rela, target, count(*) OVER (PARTITION BY target, rela) AS n, row_number() OVER (PARTITION BY target, rela ORDER BY source) AS rn FROM v_edges)
        SELECT target, rela, source, CAST(CASE WHEN n > 18 THEN 2 ELSE 0 END AS INTEGER) AS page FROM r WHERE rn > CASE WHEN n > 18 THEN 18 ELSE 0 END AND rn <= CASE WHEN n > 18 THEN 27 ELSE 9 END""",
        "v_edges",
    ).replace(") , r AS", "), r AS"),
)
def branch_paging(spark: SparkSession, d: str) -> DataFrame:
    """The third page of each branch, or the first where there is no third; the limit is the page."""
    return G.paged(V.edges(spark, d).select("target", "rela", "source"), ["target", "rela"], [F.col("source")], 2)


@query(
    "implied_specificity",
    with_views(
        """, w AS (SELECT DISTINCT tty, name, list_distinct(string_split(lower(name), ' ')) AS w FROM v_concepts WHERE tty IN ('IN', 'SCDC'))
        SELECT a.tty, a.name, count(b.name) AS parents FROM w a LEFT JOIN w b ON a.tty = b.tty AND len(b.w) < len(a.w) AND list_has_all(a.w, b.w) GROUP BY 1, 2""",
        "v_concepts",
    ).replace(") , w AS", "), w AS"),
)
def implied_specificity(spark: SparkSession, d: str) -> DataFrame:
    return G.implied_specificity(V.concepts(spark, d).where(F.col("tty").isin("IN", "SCDC")), "tty", "name")


@query(
    "role_inheritance",
    with_views(
        """, a AS (SELECT id, id AS ancestor, parent_id AS next FROM v_facilities UNION ALL SELECT a.id, f.id, f.parent_id FROM a JOIN v_facilities f ON f.id = a.next),
        g AS (SELECT DISTINCT user_id, facility_id FROM v_grants WHERE revoked_at IS NULL AND role = 'facility_admin')
        SELECT a.id AS facility_id, count(DISTINCT g.user_id) AS admins FROM a JOIN g ON g.facility_id = a.ancestor GROUP BY 1""",
        "v_facilities", "v_grants", recursive=True,
    ).replace(") , a AS", "), a AS"),
)
def role_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """How many administrators each facility has by grants on it or on a parent."""
    grants = V.grants(spark, d).where(F.col("revoked_at").isNull() & (F.col("role") == "facility_admin"))
    return G.role_counts(grants, G.ancestors(V.facilities(spark, d))).withColumnRenamed("users", "admins")


@query(
    "volume_groups",
    with_views("SELECT coalesce(s.sets, c.rxcui) AS grp, count(*) AS n FROM v_concepts c LEFT JOIN (SELECT source, string_agg(DISTINCT target, '|' ORDER BY target) AS sets FROM v_edges WHERE rela = 'consists_of' GROUP BY 1) s ON s.source = c.rxcui WHERE c.tty IN ('SCD', 'SBD') GROUP BY 1", "v_concepts", "v_edges"),
)
def volume_groups(spark: SparkSession, d: str) -> DataFrame:
    """Drugs that differ in volume or form only, by their component sets; one without components is by itself."""
    sets = V.edges(spark, d).where(F.col("rela") == "consists_of").groupBy(F.col("source").alias("rxcui")).agg(F.array_join(F.array_sort(F.collect_set("target")), "|").alias("sets"))
    c = V.concepts(spark, d).where(F.col("tty").isin("SCD", "SBD")).join(sets, "rxcui", "left")
    return c.groupBy(F.coalesce("sets", "rxcui").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "term_candidates",
    with_views(
        """, t AS (SELECT DISTINCT lower(name) AS term FROM v_concepts WHERE tty IN ('IN', 'BN') AND length(name) >= 4), m AS (SELECT t.term, p.product_ndc, p.part_id, row_number() OVER (PARTITION BY t.term ORDER BY p.product_ndc, p.part_id) AS rn FROM t JOIN v_products p ON contains(lower(p.brand || ' ' || p.generic), t.term))
        SELECT term, product_ndc FROM m WHERE rn <= 20""",
        "v_concepts", "v_products",
    ).replace(") , t AS", "), t AS"),
)
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Up to twenty products for each name that stands in theirs, inside a word or not; twenty is the list's length."""
    terms = V.concepts(spark, d).where(F.col("tty").isin("IN", "BN") & (F.length("name") >= 4)).select(F.lower("name").alias("term")).distinct()
    p = V.products(spark, d).withColumn("text", F.lower(F.concat_ws(" ", "brand", "generic")))
    hits = p.join(K.texts_with(p.select("text"), terms), "text")
    return G.paged(hits.select("term", "product_ndc", "part_id"), ["term"], [F.col("product_ndc"), F.col("part_id")], 0, 20).select("term", "product_ndc")


@query(
    "registry_name_lookup",
    with_views(
        "SELECT p.product_ndc, l.code AS by_code, n.code AS by_name FROM v_products p LEFT JOIN v_labelers l ON l.code = p.labeler_code LEFT JOIN (SELECT lower(s_name) AS key, min(lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS code FROM supplier GROUP BY 1) n ON n.key = lower('Supplier#' || lpad(CAST(p.part_id % 150 AS VARCHAR), 9, '0'))",
        "v_labelers", "v_products",
    ),
)
def registry_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A product's registered labeler by code, and one by lower-case name; of several with a name the first code counts."""
    by_code = V.labelers(spark, d).select(F.col("code").alias("labeler_code"), F.col("code").alias("by_code"))
    names = V.table(spark, d, "supplier").groupBy(F.lower("s_name").alias("key")).agg(F.min(F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("by_name"))
    p = V.products(spark, d).withColumn("key", F.lower(F.concat(F.lit("Supplier#"), F.lpad((F.col("part_id") % 150).cast("string"), 9, "0"))))
    return p.join(by_code, "labeler_code", "left").join(C.small(names), "key", "left").select("product_ndc", "by_code", "by_name")
