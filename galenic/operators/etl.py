"""Ingest and repair: enrichment views, kit expansion, route backfill, the grant ledger, JSON islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rxname as R


def kit_components(kits: DataFrame, products: DataFrame) -> DataFrame:
    """product_ndc, sequence, component_ndc, name of each kit's components, by the distinct codes in its description in
    order; the kit's own code doesn't count, and one that doesn't resolve leaves a gap in the sequence. Segments may have more
    digits than a drug code's, as the numbers of a large directory do."""
    codes = F.array_distinct(F.transform(F.regexp_extract_all("description", F.lit(r"([0-9]{4,}-[0-9]{3,})-[0-9]{1,2}"), F.lit(1)), lambda c: c))
    own = F.filter(codes, lambda c: c != F.col("product_ndc"))
    each = kits.select("product_ndc", F.posexplode(own).alias("sequence", "component_ndc"))
    names = products.select(F.col("product_ndc").alias("component_ndc"), F.col("generic").alias("name"))
    return each.join(names, "component_ndc").select("product_ndc", (F.col("sequence") + 1).alias("sequence"), "component_ndc", "name")


def routes_backfilled(products: DataFrame, names: DataFrame) -> DataFrame:
    """product_ndc, routes: of products without a route the sorted distinct routes of their concepts' names."""
    r = names.select("product_ndc", R.route(F.col("name")).alias("route")).where(F.col("route").isNotNull())
    found = r.groupBy("product_ndc").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))
    return products.where(F.col("route").isNull() | (F.col("route") == "")).select("product_ndc").join(found, "product_ndc")


def enriched(products: DataFrame, labelers: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One wide row per product: labeler, ingredient concept and its status, component set. Each side is joined by its key
    once and stays null where it has nothing."""
    l = labelers.select(F.col("code").alias("labeler_code"), F.col("name").alias("labeler"))
    c = concepts.select("rxcui", "suppress")
    sets = edges.where(F.col("rela") == "has_ingredient").groupBy(F.col("target").alias("rxcui")).agg(F.count(F.lit(1)).alias("n_components"))
    p = products.withColumn("rxcui", F.concat(F.lit("IN:"), "generic"))
    out = p.join(l, "labeler_code", "left").join(c, "rxcui", "left").join(sets, "rxcui", "left")
    return out.select("product_ndc", "labeler", "rxcui", F.when(F.col("suppress") == "N", "active").otherwise("suppressed").alias("status"), F.coalesce("n_components", F.lit(0)).cast("long").alias("n_components"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The old table with new rows of a key in place of its own; of several new ones the last by order counts."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    last = new.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).select(*old.columns)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def ledger_state(events: DataFrame) -> DataFrame:
    """grant_id, state, since, n_events: what the last event of each grant says; the later id wins at one time."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    g = events.groupBy("grant_id").agg(last, F.count(F.lit(1)).alias("n_events"))
    state = F.when(F.col("last.event_type") == "error", "revoked").when(F.col("last.event_type") == "signup", "granted").otherwise("noted")
    return g.select("grant_id", state.alias("state"), F.col("last.ts").alias("since"), "n_events")


def json_shape(c: Column) -> Column:
    """A JSON document's shape as Spark describes it."""
    return F.schema_of_variant(F.try_parse_json(c))
