"""Readers of directory, package, labeler, map and registry files, and writers of JSON.

Files are read by Spark alone, so they may lie wherever Spark can read. Where the first or last row of a key counts, rows
carry their place: file, start of the block, and number within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PLACE = ("_file", "_block", "_row")


def sniffed(spark: SparkSession, path: str) -> str:
    """A tab if the header has more tabs than commas, else a comma."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    return "\t" if header.count("\t") >= max(1, header.count(",")) else ","


def delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, names in capitals without blanks around, blanks for missing values, with the rows' places."""
    raw = spark.read.option("sep", sep or sniffed(spark, path)).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    named = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().upper()) for c in raw.columns]
    return raw.select(*named, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def _one(rows: DataFrame, key: list[str], last: bool = False) -> DataFrame:
    order = [F.col(c).desc() if last else F.col(c) for c in PLACE]
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def required(rows: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows


def ndc_directory(spark: SparkSession, path: str, with_delisted: bool = False) -> DataFrame:
    """product_ndc, brand, generic, dosage_form, route, labeler and the parallel lists of substances, strengths and units as
    one array; of a product listed twice the first row counts; excluded rows and rows without a code don't."""
    r = required(delimited(spark, path), "PRODUCTNDC", "NONPROPRIETARYNAME")
    for c in ("PROPRIETARYNAME", "DOSAGEFORMNAME", "ROUTENAME", "LABELERNAME", "SUBSTANCENAME", "ACTIVE_NUMERATOR_STRENGTH", "ACTIVE_INGRED_UNIT", "NDC_EXCLUDE_FLAG"):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(""))
    r = r.where(F.col("PRODUCTNDC") != "")
    if not with_delisted:
        r = r.where(F.upper("NDC_EXCLUDE_FLAG") != "Y")
    r = _one(r, ["PRODUCTNDC"])
    parts = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    blank = lambda x: F.coalesce(x, F.lit(""))
    zipped = F.arrays_zip(parts("SUBSTANCENAME").alias("name"), parts("ACTIVE_NUMERATOR_STRENGTH").alias("strength"), parts("ACTIVE_INGRED_UNIT").alias("unit"))
    items = F.transform(zipped, lambda z: F.struct(blank(z["name"]).alias("name"), blank(z["strength"]).alias("strength"), blank(z["unit"]).alias("unit")))
    return r.select(
        F.col("PRODUCTNDC").alias("product_ndc"), F.col("PROPRIETARYNAME").alias("brand"), F.col("NONPROPRIETARYNAME").alias("generic"), F.col("DOSAGEFORMNAME").alias("dosage_form"),
        F.col("ROUTENAME").alias("route"), F.col("LABELERNAME").alias("labeler"), items.alias("ingredients"), display_strength(items).alias("strength"),
    )


def display_strength(items: Column) -> Column:
    """Strengths with units, ` / ` between, `/1` dropped; those that lack either are left out."""
    whole = F.filter(items, lambda x: (x["strength"] != "") & (x["unit"] != ""))
    return F.array_join(F.transform(whole, lambda x: F.regexp_replace(F.concat_ws(" ", x["strength"], x["unit"]), r"/1$", "")), " / ")


def package_file(spark: SparkSession, path: str, products: DataFrame) -> DataFrame:
    """product_ndc, package_code, description of packages whose product is there."""
    r = required(delimited(spark, path, "\t"), "PRODUCTNDC", "NDCPACKAGECODE", "PACKAGEDESCRIPTION")
    out = r.select(F.col("PRODUCTNDC").alias("product_ndc"), F.element_at(F.split("NDCPACKAGECODE", "-"), -1).alias("package_code"), F.col("PACKAGEDESCRIPTION").alias("description"))
    return out.join(products.select("product_ndc"), "product_ndc", "left_semi")


def setid_map(spark: SparkSession, path: str) -> DataFrame:
    """setid, entries (version, rxcui, tty, name; best first) of a map with bars between; of a key the latest version counts, the
    first row of equals; a version that is no number is 0."""
    r = required(delimited(spark, path, "|"), "SETID", "SPL_VERSION", "RXCUI", "RXSTRING", "RXTTY")
    r = r.where((F.col("SETID") != "") & (F.col("RXCUI") != "") & (F.col("RXTTY") != "")).withColumn("version", F.coalesce(F.col("SPL_VERSION").try_cast("int"), F.lit(0)))
    w = Window.partitionBy("SETID", "RXCUI", "RXTTY").orderBy(F.desc("version"), *PLACE)
    best = r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1)
    entry = F.struct((-F.col("version")).alias("minus"), F.col("RXTTY").alias("tty"), F.col("RXCUI").alias("rxcui"), F.col("RXSTRING").alias("name"))
    g = best.groupBy(F.col("SETID").alias("setid")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("setid", F.transform("e", lambda x: F.struct((-x["minus"]).alias("version"), x["rxcui"].alias("rxcui"), x["tty"].alias("tty"), x["name"].alias("name"))).alias("entries"))


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(codes, names) of lines `Name [alias, alias] : code, code`; other lines, blank ones and comments don't count. codes: code,
    name, the first line of a code; names: key in lower case, name."""
    p = r"^\s*([^#\[\]:]+?)\s*(?:\[([^\]]*)\])?\s*:\s*([0-9,\s]+?)\s*$"
    line = F.col("value")
    lines = spark.read.text(path).select(line, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    r = lines.where(~F.startswith(F.ltrim(line), F.lit("#")) & line.rlike(p)).select(F.regexp_extract(line, p, 1).alias("name"), F.regexp_extract(line, p, 2).alias("aliases"), F.regexp_extract(line, p, 3).alias("codes"), *PLACE)
    codes = r.select("name", F.explode(F.split("codes", ",")).alias("code"), *PLACE).withColumn("code", F.lpad(F.trim("code"), 5, "0")).where(F.trim("code") != "00000")
    aliases = F.filter(F.transform(F.concat(F.array("name"), F.split("aliases", ",")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    names = r.select("name", F.explode(aliases).alias("key"), *PLACE)
    return _one(codes, ["code"]).select("code", "name"), _one(names, ["key"]).select("key", "name")


LABELERS = "array<map<string,struct<codes:array<string>,full_name:string,active_ndc_product_count:int,has_active_ndc_products:boolean,active_rx_product_count:int,in_rxnorm:boolean>>>"


def labeler_list(spark: SparkSession, path: str) -> DataFrame:
    """code, name, full_name, in_rxnorm of a JSON array of one-key objects; a labeler has a row for each code, and of a code
    the last in order counts."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", LABELERS).alias("all"))
    each = docs.select(F.posexplode("all").alias("at", "m")).select("at", F.explode("m").alias("name", "v")).select("at", "name", "v.full_name", "v.in_rxnorm", F.explode("v.codes").alias("code"))
    last = each.groupBy("code").agg(F.max(F.struct("at", "name", "full_name", "in_rxnorm")).alias("l"))
    return last.select("code", "l.name", "l.full_name", "l.in_rxnorm")


def labeler_object(spark: SparkSession, path: str) -> DataFrame:
    """code, name of a JSON object from codes to {full_name or name}."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<name:string,full_name:string>>")).alias("code", "v"))
    return docs.select("code", F.coalesce("v.full_name", "v.name").alias("name"))


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every file decodes as that, else cp1252 unless it holds a byte that has no meaning there, else Latin-1."""
    content = spark.read.format("binaryFile").load(path).select("content")
    flags = content.agg(
        F.min(F.col("content").isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))).alias("utf8"),
        F.max(F.hex("content").rlike("^(?:..)*?(?:81|8D|8F|90|9D)")).alias("odd"),
    ).first()
    return "UTF-8" if flags.utf8 or flags.utf8 is None else "ISO-8859-1" if flags.odd else "windows-1252"


def strict_products(rows: DataFrame, today: str, types: tuple[str, ...]) -> DataFrame:
    """labeler, product_ndc of active human products; a date that doesn't parse is an error that names the file and row."""
    day = F.lit(today).cast("date")

    def date(c: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"bad {c} in "), F.col("_file"), F.lit(", row "), F.col("_row").cast("string")))
        parsed = F.try_to_date(F.col(c), "yyyyMMdd")
        return F.when(F.col(c) == "", F.lit(None).cast("date")).when(parsed.isNotNull(), parsed).otherwise(bad.cast("date"))

    r = rows.where(F.col("PRODUCTTYPENAME").isin(*types) & (F.upper("NDC_EXCLUDE_FLAG") != "Y"))
    ok = F.coalesce(date("STARTMARKETINGDATE") <= day, F.lit(True)) & F.coalesce(date("ENDMARKETINGDATE") >= day, F.lit(True)) & F.coalesce(date("LISTING_RECORD_CERTIFIED_THROUGH") >= day, F.lit(True))
    code = F.regexp_replace(F.split("PRODUCTNDC", "-")[0], "^0+(?=.)", "")
    return r.where(ok).select(code.alias("labeler"), F.col("PRODUCTNDC").alias("product_ndc")).distinct()


def write_json(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """JSON lines; the committer shows them all or none."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)
