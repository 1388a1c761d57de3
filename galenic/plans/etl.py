"""Queries over ingest, repair, JSON, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import views as V
from ..functions import text as X
from ..operators import etl as E, markup as D
from ..streaming import events as S
from ..views import with_views
from .registry import query


@query(
    "ndc_enrichment",
    with_views(
        """SELECT p.product_ndc, l.name AS labeler, 'IN:' || p.generic AS rxcui, CASE WHEN c.suppress = 'N' THEN 'active' ELSE 'suppressed' END AS status, coalesce(s.n, 0) AS n_components FROM v_products p LEFT JOIN v_labelers l ON l.code = p.labeler_code
        LEFT JOIN v_concepts c ON c.rxcui = 'IN:' || p.generic LEFT JOIN (SELECT target, count(*) AS n FROM v_edges WHERE rela = 'has_ingredient' GROUP BY 1) s ON s.target = 'IN:' || p.generic""",
        "v_labelers", "v_concepts", "v_edges",
    ),
)
def ndc_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return E.enriched(V.products(spark, d), V.labelers(spark, d), V.concepts(spark, d), V.edges(spark, d))


@query(
    "kit_components",
    with_views(
        """, k AS (SELECT a.product_ndc, a.part_id, b.product_ndc AS one, c.product_ndc AS two FROM v_products a LEFT JOIN v_products b ON b.part_id = a.part_id + 1 LEFT JOIN v_products c ON c.part_id = a.part_id + 2 WHERE a.dosage_form = 'KIT')
        SELECT k.product_ndc, CAST(1 AS INTEGER) AS sequence, one AS component_ndc, p.generic AS name FROM k JOIN v_products p ON p.product_ndc = one
        UNION ALL SELECT k.product_ndc, CAST(CASE WHEN one IS NULL THEN 2 ELSE 3 END AS INTEGER), two, p.generic FROM k JOIN v_products p ON p.product_ndc = two""",
        "v_products",
    ).replace(") , k AS", "), k AS"),
)
def kit_components(spark: SparkSession, d: str) -> DataFrame:
    """A kit's description names itself, the next part, an unknown code and the part after that."""
    p = V.products(spark, d)
    at = lambda n, name: p.select((F.col("part_id") - n).alias("part_id"), F.col("product_ndc").alias(name))
    kits = p.where(F.col("dosage_form") == "KIT").join(at(1, "one"), "part_id", "left").join(at(2, "two"), "part_id", "left")
    text = F.concat_ws(" / ", F.concat("product_ndc", F.lit("-01 KIT")), F.concat(F.lit("1 VIAL ("), "one", F.lit("-02)")), F.lit("1 SWAB (99999-999-99)"), F.concat(F.lit("1 VIAL ("), "two", F.lit("-03)")), F.concat(F.lit("1 VIAL ("), "one", F.lit("-02)")))
    return E.kit_components(kits.select("product_ndc", text.alias("description")), p)


@query(
    "route_backfill",
    with_views(
        "SELECT product_ndc, CASE WHEN dosage_form LIKE '%INJECTION%' OR generic LIKE '%injection%' THEN 'INTRAVENOUS' ELSE 'ORAL' END AS routes FROM v_products WHERE part_id % 2 = 0 AND (dosage_form LIKE '%INJECTION%' OR generic LIKE '%injection%' OR dosage_form = 'TABLET')",
        "v_products",
    ),
)
def route_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Products without a route take those of their names' dose forms."""
    p = V.products(spark, d).withColumn("route", F.when(F.col("part_id") % 2 == 1, "ORAL"))
    names = p.select("product_ndc", F.concat_ws(" ", "generic", "dosage_form").alias("name"))
    return E.routes_backfilled(p, names)


@query(
    "product_upsert",
    with_views(
        "SELECT product_ndc, generic, CASE WHEN part_id % 5 = 0 THEN 'second ' || brand ELSE brand END AS brand FROM v_products UNION ALL SELECT 'X' || product_ndc, generic, 'second ' || brand FROM v_products WHERE part_id % 7 = 0",
        "v_products",
    ),
)
def product_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An import of changed and of new products, each twice; the last of a key counts."""
    p = V.products(spark, d).select("product_ndc", "generic", "brand", "part_id")
    changed = p.where(F.col("part_id") % 5 == 0).unionByName(p.where(F.col("part_id") % 7 == 0).withColumn("product_ndc", F.concat(F.lit("X"), "product_ndc")))
    twice = changed.select("product_ndc", "generic", "brand", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))
    new = twice.withColumn("brand", F.concat(F.when(F.col("line") == 2, "second ").otherwise("first "), "brand"))
    return E.upserted(p.select("product_ndc", "generic", "brand"), new, ["product_ndc"], F.col("line"))


@query(
    "grant_ledger",
    "SELECT grant_id, CASE event_type WHEN 'error' THEN 'revoked' WHEN 'signup' THEN 'granted' ELSE 'noted' END AS state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since, n_events FROM (SELECT user_id AS grant_id, event_type, ts, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def grant_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user's grant by the last of its events."""
    s = E.ledger_state(V.table(spark, d, "events").withColumnRenamed("user_id", "grant_id"))
    return s.select("grant_id", "state", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "n_events")


@query(
    "json_ingest",
    "SELECT event_type, count(*) AS n, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_keys, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
)
def json_ingest(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents to columns, by a given schema; what doesn't parse is null."""
    e = V.table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p.k").alias("n_keys"), F.sum("p.k").alias("total"))


@query("json_shapes", "SELECT 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events")
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are of each shape."""
    return V.table(spark, d, "events").groupBy(E.json_shape(F.col("props")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("anchor_freshness", "SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def anchor_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Users' anchors that are younger than ten days."""
    e = V.table(spark, d, "events").withColumn("attributes", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("anchored_at"))))
    return S.fresh(e, "anchored_at", "2024-01-30 00:00:00", 10).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("events_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = S.tumbling(V.table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "events_sessions",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = S.sessions(V.table(spark, d, "events"))
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("spl_blocks")
def spl_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of all pages, with the tags of their text."""
    b = D.html_blocks(V.table(spark, d, "pages"))
    return b.select("id", "ordinal", "section", "title", "kind", "text", F.array_join(D.tags(F.col("text")), ",").alias("tags"))


@query("spl_regions")
def spl_regions(spark: SparkSession, d: str) -> DataFrame:
    return D.regions(D.html_blocks(V.table(spark, d, "pages")))


@query("spl_plaintext")
def spl_plaintext(spark: SparkSession, d: str) -> DataFrame:
    t = D.plain_text(D.html_blocks(V.table(spark, d, "pages")))
    return t.select("id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(
    "text_search",
    "SELECT source, count(*) AS n, count(CASE WHEN contains(lower(text), 'license') THEN 1 END) AS n_license, count(CASE WHEN contains(lower(text), '100%') THEN 1 END) AS n_percent FROM documents GROUP BY 1",
)
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring search whatever the case; signs that patterns use are taken as they are."""
    docs = V.table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.contains_any_case(["text"], "License")).alias("n_license"), F.count_if(X.contains_any_case(["text"], "100%")).alias("n_percent"))


@query("display_strings", with_views("SELECT product_ndc, concat_ws(' ', generic, CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' ' || unit, lower(dosage_form)) AS described, CASE WHEN length(brand || ' / ' || generic) > 24 THEN rtrim((brand || ' / ' || generic)[1:23]) || '…' ELSE brand || ' / ' || generic END AS short, contains(lower(brand), lower(generic)) OR contains(lower(generic), lower(brand)) AS descriptive FROM v_products", "v_products"))
def display_strings(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" / ", "brand", "generic")
    return V.products(spark, d).select(
        "product_ndc", F.concat_ws(" ", "generic", F.concat_ws(" ", F.col("strength").cast("int").cast("string"), "unit"), F.lower("dosage_form")).alias("described"),
        X.short(name, 24).alias("short"), X.descriptive(F.col("brand"), F.col("generic")).alias("descriptive"),
    )


@query(
    "strength_relevance",
    with_views("SELECT c.rxcui, count(DISTINCT p.product_ndc) AS n FROM v_concepts c JOIN v_products p ON c.tty = 'SCDC' AND starts_with(c.name, p.generic || ' ') AND rtrim(regexp_extract(c.name, ' ([0-9]+) MG', 1), '0') = rtrim(CAST(CAST(p.strength AS INTEGER) AS VARCHAR), '0') AND regexp_extract(c.name, '^(.*) [0-9]+ MG', 1) = p.generic GROUP BY 1", "v_concepts", "v_products"),
)
def strength_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Components whose strength a product shares, zeros at the end not counting, as the numbers are compared as text."""
    c = V.concepts(spark, d).where(F.col("tty") == "SCDC").select("rxcui", F.regexp_extract("name", "^(.*) [0-9]+ MG", 1).alias("generic"), F.explode(X.mg_numbers(F.col("name"))).alias("mg"))
    p = V.products(spark, d).select("product_ndc", "generic", X.strength_number(F.col("strength").cast("int").cast("string")).alias("mg"))
    return c.join(p, ["generic", "mg"]).groupBy("rxcui").agg(F.count_distinct("product_ndc").alias("n"))
