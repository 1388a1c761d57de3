"""Domain tables of a drug catalog, derived from the star-schema tables, and the same as SQL for DuckDB.

Parts play products, suppliers play labelers, line items play packages and order components, embeddings play
detections in images, events play role grants. Vocabularies come from two literal dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What a part's type says about dosage form, and what its noun says about the generic name.
DOSAGE_FORMS = {
    "ECONOMY": "INJECTION, SOLUTION",
    "LARGE": "INJECTION, SUSPENSION",
    "MEDIUM": "INJECTION, SOLUTION, CONCENTRATE",
    "PROMO": "KIT",
    "SMALL": "INJECTION, POWDER, LYOPHILIZED, FOR SOLUTION",
    "STANDARD": "TABLET",
}
GENERICS = {
    "anvil": "vancomycin",
    "bolt": "sodium chloride",
    "gear": "sterile water for injection",
    "gizmo": "heparin sodium",
    "plate": "loratadine",
    "ring": "potassium chloride",
    "rod": "zinc oxide sunscreen",
    "widget": "ceftazidime and avibactam",
}
BRANDED = ("cold", "hot", "large", "small")
SUFFIXES = (" Pharmaceuticals, Inc.", " Laboratories LLC", " Pharma USA", " (US) Corp.", " Div Holdings Inc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: Column, digits: int) -> Column:
    """With leading zeros; a longer number keeps all its digits, so that codes stay unique at every size."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, active"""
    s = table(spark, sf_dir, "supplier")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("s_suppkey") % 5).cast("int") + 1)
    return s.select(
        _padded(F.col("s_suppkey"), 5).alias("code"),
        F.concat("s_name", suffix).alias("name"),
        (F.col("s_acctbal") >= 0).alias("active"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_ndc, generic, brand, dosage_form, labeler_code, strength, unit, active; one row per part"""
    part = table(spark, sf_dir, "part")
    supplied = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("suppkey"))
    p = part.join(supplied, part.p_partkey == supplied.l_partkey, "left")
    words = F.split("p_name", " ")
    generic = _lookup(GENERICS, words[1])
    code = _padded(F.coalesce("suppkey", F.lit(0)), 5)
    p = p.select(
        F.concat(code, F.lit("-"), _padded(F.col("p_partkey"), 4)).alias("product_ndc"),
        generic.alias("generic"),
        F.when(words[0].isin(*BRANDED), F.initcap("p_name")).otherwise(generic).alias("brand"),
        _lookup(DOSAGE_FORMS, F.split("p_type", " ")[0]).alias("dosage_form"),
        code.alias("labeler_code"),
        F.col("p_size").cast("double").alias("strength"),
        F.lit("mg/mL").alias("unit"),
        (F.col("p_size") % 10 != 0).alias("active"),
        F.col("p_partkey").cast("long").alias("part_id"),
    )
    return p


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_ndc, package_code, description"""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    p = products(spark, sf_dir)
    joined = items.join(p, F.col("l_partkey") == F.col("part_id"))
    code = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    size, n = F.col("strength").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    ndc = F.concat_ws("-", "product_ndc", code)
    text = F.concat(size, F.lit(" mL in "), n, F.lit(" VIAL ("), ndc, F.lit(") / 1 CARTON in 1 CARTON"))
    return joined.select("product_ndc", code.alias("package_code"), text.alias("description"))


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_ndc, name, strength, unit; kits have none"""
    p = products(spark, sf_dir).where(F.col("dosage_form") != "KIT")
    return p.select("product_ndc", F.explode(F.split("generic", " and ")).alias("name"), F.col("strength").cast("int").cast("string").alias("strength"), F.lit("MG").alias("unit"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rxcui, tty, name, suppress; the id is made of level and name"""
    return _levels(products(spark, sf_dir)).select(F.explode("nodes").alias("n")).select("n.*").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, rela, target; distinct"""
    return _levels(products(spark, sf_dir)).select(F.explode("links").alias("e")).select("e.*").distinct()


def _levels(p: DataFrame) -> DataFrame:
    size = F.col("strength").cast("int").cast("string")
    p = p.select("generic", "brand", size.alias("size"), F.lower("dosage_form").alias("form"))
    scdc = F.concat("generic", F.lit(" "), "size", F.lit(" MG"))
    p = p.withColumn("scdc", scdc).withColumn("scd", F.concat("scdc", F.lit(" "), "form")).withColumn("sbd", F.concat("scd", F.lit(" ["), "brand", F.lit("]")))
    branded = F.col("brand") != F.col("generic")

    def node(tty: str, name: str) -> Column:
        return F.struct(F.concat(F.lit(f"{tty}:"), F.col(name)).alias("rxcui"), F.lit(tty).alias("tty"), F.col(name).alias("name"), F.when(F.length(F.col(name)) % 11 == 0, "O").otherwise("N").alias("suppress"))

    def link(a: str, a_name: str, rela: str, b: str, b_name: str) -> Column:
        return F.struct(F.concat(F.lit(f"{a}:"), F.col(a_name)).alias("source"), F.lit(rela).alias("rela"), F.concat(F.lit(f"{b}:"), F.col(b_name)).alias("target"))

    plain = F.array(node("IN", "generic"), node("SCDC", "scdc"), node("SCD", "scd"))
    own = F.array(node("BN", "brand"), node("SBD", "sbd"))
    links = F.array(link("SCDC", "scdc", "has_ingredient", "IN", "generic"), link("SCD", "scd", "consists_of", "SCDC", "scdc"))
    own_links = F.array(link("IN", "generic", "has_tradename", "BN", "brand"), link("SCD", "scd", "has_tradename", "SBD", "sbd"), link("SBD", "sbd", "has_ingredient", "BN", "brand"))
    return p.select(F.when(branded, F.concat(plain, own)).otherwise(plain).alias("nodes"), F.when(branded, F.concat(links, own_links)).otherwise(links).alias("links"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, image, pos, instance_id, class_label, score, x1, y1, x2, y2, mask_area, lot, ndc, exp, v; ten boxes to
    an image, five images to a run, image 0 is the reference"""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    x1, y1, w, h = i * 37 % 500, i * 53 % 380, 40 + i * 29 % 160, 50 + i * 31 % 150
    labels = F.array(*map(F.lit, ("bottle", "vial", "iv bag", "bag", "filter")))
    return e.select(
        F.expr("vec_id div 50").alias("run"),
        (F.expr("vec_id div 10") % 5).alias("image"),
        (i % 10).alias("pos"),
        i.alias("instance_id"),
        F.element_at(labels, (F.col("label") % 5).cast("int") + 1).alias("class_label"),
        ((i * 7919 % 1000) / 1000.0).alias("score"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"),
        (w * h * (50 + i % 50) / 100.0).cast("long").alias("mask_area"),
        F.when(i % 4 != 0, F.concat(F.lit("L"), (i % 7).cast("string"))).alias("lot"),
        F.when(i % 3 != 0, F.concat(F.lit("00"), (i % 11 + 100).cast("string"), F.lit("-0001-01"))).alias("ndc"),
        F.when(i % 5 != 0, F.concat(F.lit("0"), (i % 9 + 1).cast("string"), F.lit("/2026"))).alias("exp"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


def order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, pos, product_ndc, package_ndc, dosage_form, generic, quantity, strength, lot, exp; numbered within the order"""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    items = items.withColumn("pos", F.row_number().over(w))
    p = products(spark, sf_dir).select("part_id", "product_ndc", "dosage_form", "generic", "strength")
    return items.join(p, F.col("l_partkey") == F.col("part_id")).select(
        F.col("l_orderkey").cast("long").alias("order_id"), F.col("pos").cast("int").alias("pos"), "product_ndc",
        F.concat_ws("-", "product_ndc", F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("package_ndc"),
        "dosage_form", "generic", F.col("l_quantity").cast("double").alias("quantity"), "strength",
        F.concat("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd")).alias("lot"),
        F.date_format("l_shipdate", "MM/yyyy").alias("exp"),
    )


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop, pool, line_no, text: five label lines of each product as read four times, one of them corrupted"""
    p = products(spark, sf_dir)
    crop = F.col("part_id")
    size = F.col("strength").cast("int").cast("string")
    bad = crop % 4 == F.col("pool")
    pools = p.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pool"))
    year, month = (2024 + crop % 5).cast("string"), F.lpad((crop % 12 + 1).cast("string"), 2, "0")
    lot = F.concat(F.lit("A"), F.lpad((crop * 7919 % 100000).cast("string"), 5, "0"))
    ndc = F.concat_ws("-", "product_ndc", F.lit("01"))
    lines = F.array(
        F.concat(F.lit("NDC "), F.when(bad, F.translate(ndc, "01", "OI")).otherwise(ndc)),
        F.concat(F.lit("LOT "), F.when(bad, F.concat(lot, F.lit("X"))).otherwise(lot)),
        F.concat(F.lit("EXP "), month, F.lit("/"), F.when(bad, F.lit("2031")).otherwise(year)),
        F.col("generic"),
        F.concat(size, F.lit(" mg/mL"), F.when(crop % 3 == 0, F.lit(" single dose vial")).otherwise(F.lit(" store at room temperature"))),
    )
    return pools.select(crop.alias("crop"), "pool", F.posexplode(lines).alias("line_no", "text"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, organization_id: regions hold nations hold customers"""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("organization_id"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 101).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("organization_id"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("id"), (F.col("c_nationkey") + 101).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("organization_id"))
    return r.unionByName(n).unionByName(c)


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, role, facility_id, granted_at, revoked_at, expires_at: signups grant, errors of the same second user revoke"""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click"))
    i = F.col("event_id")
    return e.select(
        i.alias("id"), "user_id", F.when(i % 3 == 0, "facility_admin").otherwise("pharmacist").alias("role"),
        F.when(i % 10 == 0, i % 5 + 1).when(i % 10 < 4, i % 25 + 101).otherwise(i % 150 + 1000).alias("facility_id"),
        F.col("ts").alias("granted_at"),
        F.when(i % 7 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("revoked_at"),
        F.when(i % 2 == 0, F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
    )


_SQL = {
    "v_labelers": "SELECT lpad(CAST(s_suppkey AS VARCHAR), greatest(5, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0') AS code, s_name || CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END AS name, s_acctbal >= 0 AS active FROM supplier",
    "v_products": f"""SELECT lpad(CAST(coalesce(suppkey, 0) AS VARCHAR), greatest(5, length(CAST(coalesce(suppkey, 0) AS VARCHAR)))::INTEGER, '0') || '-' || lpad(CAST(p_partkey AS VARCHAR), greatest(4, length(CAST(p_partkey AS VARCHAR)))::INTEGER, '0') AS product_ndc,
        {_case(GENERICS, "split_part(p_name, ' ', 2)")} AS generic,
        CASE WHEN split_part(p_name, ' ', 1) IN {BRANDED} THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] ELSE {_case(GENERICS, "split_part(p_name, ' ', 2)")} END AS brand,
        {_case(DOSAGE_FORMS, "split_part(p_type, ' ', 1)")} AS dosage_form,
        lpad(CAST(coalesce(suppkey, 0) AS VARCHAR), greatest(5, length(CAST(coalesce(suppkey, 0) AS VARCHAR)))::INTEGER, '0') AS labeler_code, CAST(p_size AS DOUBLE) AS strength, 'mg/mL' AS unit, p_size % 10 <> 0 AS active, CAST(p_partkey AS BIGINT) AS part_id
        FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
    "v_packages": """SELECT product_ndc, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS package_code,
        CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' mL in ' || CAST(l_linenumber AS VARCHAR) || ' VIAL (' || product_ndc || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ') / 1 CARTON in 1 CARTON' AS description
        FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) JOIN v_products ON l_partkey = part_id""",
    "v_ingredients": "SELECT product_ndc, unnest(string_split(generic, ' and ')) AS name, CAST(CAST(strength AS INTEGER) AS VARCHAR) AS strength, 'MG' AS unit FROM v_products WHERE dosage_form <> 'KIT'",
    "v_levels": """SELECT generic, brand, scdc, scdc || ' ' || form AS scd, scdc || ' ' || form || ' [' || brand || ']' AS sbd, brand <> generic AS branded
        FROM (SELECT generic, brand, lower(dosage_form) AS form, generic || ' ' || CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' MG' AS scdc FROM v_products)""",
    "v_concepts": """SELECT DISTINCT tty || ':' || name AS rxcui, tty, name, CASE WHEN length(name) % 11 = 0 THEN 'O' ELSE 'N' END AS suppress FROM (
        SELECT 'IN' AS tty, generic AS name FROM v_levels UNION ALL SELECT 'SCDC', scdc FROM v_levels UNION ALL SELECT 'SCD', scd FROM v_levels
        UNION ALL SELECT 'BN', brand FROM v_levels WHERE branded UNION ALL SELECT 'SBD', sbd FROM v_levels WHERE branded)""",
    "v_edges": """SELECT DISTINCT * FROM (
        SELECT 'SCDC:' || scdc AS source, 'has_ingredient' AS rela, 'IN:' || generic AS target FROM v_levels
        UNION ALL SELECT 'SCD:' || scd, 'consists_of', 'SCDC:' || scdc FROM v_levels
        UNION ALL SELECT 'IN:' || generic, 'has_tradename', 'BN:' || brand FROM v_levels WHERE branded
        UNION ALL SELECT 'SCD:' || scd, 'has_tradename', 'SBD:' || sbd FROM v_levels WHERE branded
        UNION ALL SELECT 'SBD:' || sbd, 'has_ingredient', 'BN:' || brand FROM v_levels WHERE branded)""",
    "v_detections": """SELECT vec_id // 50 AS run, (vec_id // 10) % 5 AS image, vec_id % 10 AS pos, vec_id AS instance_id,
        CASE label % 5 WHEN 0 THEN 'bottle' WHEN 1 THEN 'vial' WHEN 2 THEN 'iv bag' WHEN 3 THEN 'bag' ELSE 'filter' END AS class_label,
        (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS score, vec_id * 37 % 500 AS x1, vec_id * 53 % 380 AS y1,
        vec_id * 37 % 500 + 40 + vec_id * 29 % 160 AS x2, vec_id * 53 % 380 + 50 + vec_id * 31 % 150 AS y2,
        ((40 + vec_id * 29 % 160) * (50 + vec_id * 31 % 150) * (50 + vec_id % 50)) // 100 AS mask_area,
        CASE WHEN vec_id % 4 <> 0 THEN 'L' || CAST(vec_id % 7 AS VARCHAR) END AS lot,
        CASE WHEN vec_id % 3 <> 0 THEN '00' || CAST(vec_id % 11 + 100 AS VARCHAR) || '-0001-01' END AS ndc,
        CASE WHEN vec_id % 5 <> 0 THEN '0' || CAST(vec_id % 9 + 1 AS VARCHAR) || '/2026' END AS exp, embedding AS v FROM embeddings""",
    "v_order_components": """SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(pos AS INTEGER) AS pos, product_ndc, product_ndc || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS package_ndc,
        dosage_form, generic, l_quantity AS quantity, strength, l_returnflag || l_linestatus || strftime(l_shipdate, '%Y%m%d') AS lot, strftime(l_shipdate, '%m/%Y') AS exp
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem)
        JOIN v_products ON l_partkey = part_id""",
    "v_ocr_lines": """SELECT crop, pool, line_no, CASE line_no
          WHEN 0 THEN 'NDC ' || CASE WHEN bad THEN translate(product_ndc || '-01', '01', 'OI') ELSE product_ndc || '-01' END
          WHEN 1 THEN 'LOT A' || lpad(CAST(crop * 7919 % 100000 AS VARCHAR), 5, '0') || CASE WHEN bad THEN 'X' ELSE '' END
          WHEN 2 THEN 'EXP ' || lpad(CAST(crop % 12 + 1 AS VARCHAR), 2, '0') || '/' || CASE WHEN bad THEN '2031' ELSE CAST(2024 + crop % 5 AS VARCHAR) END
          WHEN 3 THEN generic
          ELSE CAST(CAST(strength AS INTEGER) AS VARCHAR) || ' mg/mL' || CASE WHEN crop % 3 = 0 THEN ' single dose vial' ELSE ' store at room temperature' END END AS text
        FROM (SELECT *, part_id AS crop, part_id % 4 = pool AS bad FROM v_products, (SELECT unnest([0, 1, 2, 3]) AS pool)), (SELECT unnest([0, 1, 2, 3, 4]) AS line_no)""",
    "v_facilities": """SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(1 AS BIGINT) AS organization_id FROM region
        UNION ALL SELECT CAST(n_nationkey + 101 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), 1 FROM nation
        UNION ALL SELECT CAST(c_custkey + 1000 AS BIGINT), CAST(c_nationkey + 101 AS BIGINT), 1 FROM customer""",
    "v_grants": """SELECT event_id AS id, user_id, CASE WHEN event_id % 3 = 0 THEN 'facility_admin' ELSE 'pharmacist' END AS role,
        CASE WHEN event_id % 10 = 0 THEN event_id % 5 + 1 WHEN event_id % 10 < 4 THEN event_id % 25 + 101 ELSE event_id % 150 + 1000 END AS facility_id, ts AS granted_at,
        CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 DAY END AS revoked_at, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 20 DAY END AS expires_at
        FROM events WHERE event_type IN ('signup', 'click')""",
}
_NEEDS = {
    "v_packages": ["v_products"], "v_ingredients": ["v_products"], "v_levels": ["v_products"], "v_concepts": ["v_products", "v_levels"],
    "v_edges": ["v_products", "v_levels"], "v_order_components": ["v_products"], "v_ocr_lines": ["v_products"],
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """The SQL behind the named views' definitions. It may itself start with `WITH`-less further definitions ending in a comma."""
    names = list(dict.fromkeys(n for v in views for n in [*_NEEDS.get(v, []), v]))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({_SQL[n]})" for n in names) + " " + sql.strip()
