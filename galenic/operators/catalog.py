"""Catalog reads: filters, searches, joins, counts and sets over products, labelers, packages and concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ndc as N, text as X

#: A side that is sent to all executors may have this many rows at most; beyond that Spark shuffles.
MOST_BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Marks a dimension for broadcasting if it is known to be small enough; looks at no more rows than the limit."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def resolve_ndc(printed: DataFrame, products: DataFrame, labelers: DataFrame) -> DataFrame:
    """For each printed code the first candidate that is a product, and the labeler by code, five digits then four.

    printed: ndc. Returns ndc, product_ndc, generic, labeler, strength; nulls where nothing is found.
    """
    keyed = printed.select("ndc").distinct()
    tried = keyed.select("ndc", F.posexplode(N.lookup_candidates(F.col("ndc"))).alias("try", "candidate"))
    hits = tried.join(products.select(F.col("product_ndc").alias("candidate"), "product_ndc", "generic", "strength", "unit"), "candidate")
    first = hits.groupBy("ndc").agg(F.min_by(F.struct("product_ndc", "generic", "strength", "unit"), "try").alias("hit"))
    code = F.split("ndc", "-")[0]
    named = keyed.select("ndc", code.alias("code"), F.when(F.length(code) == 5, F.substring(code, 1, 4)).alias("code4"))
    names = labelers.select("code", F.col("name").alias("labeler5"))
    shorter = labelers.select(F.col("code").alias("code4"), F.col("name").alias("labeler4"))
    named = named.join(names, "code", "left").join(shorter, "code4", "left")
    out = printed.join(first, "ndc", "left").join(named, "ndc", "left")
    return out.select(
        "ndc", F.col("hit.product_ndc").alias("product_ndc"), F.col("hit.generic").alias("generic"),
        F.coalesce("labeler5", "labeler4").alias("labeler"), F.concat_ws(" ", F.col("hit.strength").cast("int").cast("string"), "hit.unit").alias("strength"),
    )


def search_products(products: DataFrame, q: str = "", active: str | None = None, dosage_form: str | None = None, labeler: str | None = None, ndc: str | None = None) -> DataFrame:
    """The product list's filters; those that are not given, or given as neither yes nor no, let all rows pass."""
    tests: list[Column] = [X.contains_any_case(["product_ndc", "generic", "brand"], q)]
    wanted = X.flag(active)
    if wanted is not None:
        tests.append(F.col("active") == wanted)
    if dosage_form:
        tests.append(F.lower("dosage_form") == dosage_form.lower())
    if labeler:
        tests.append(F.col("labeler_code") == labeler)
    if ndc:
        tests.append(F.col("product_ndc") == ndc)
    return products.where(reduce(lambda a, b: a & b, tests))


def page(rows: DataFrame, order: list[Column], size: int = 50, number: int = 1) -> DataFrame:
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def active_on(rows: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows whose dates, where given, lie around the day."""
    d = F.lit(day).cast("date")
    return rows.where(F.coalesce(F.col(start).cast("date") <= d, F.lit(True)) & F.coalesce(F.col(end).cast("date") >= d, F.lit(True)))


#: Words of products that a hospital pharmacy doesn't stock. One pattern holds them all.
COSMETIC_WORDS = ("sunscreen", "lipstick", "shampoo", "deodorant", "moisturizer", "toothpaste", "mouthwash", "hand sanitizer", "antiperspirant", r"\w+caine")


def cosmetic(*columns: str) -> Column:
    pattern = "(?i)(" + "|".join(COSMETIC_WORDS) + ")"
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns])


def active_grants(grants: DataFrame, now: str) -> DataFrame:
    """Neither revoked nor past their expiry, which may be open."""
    t = F.lit(now).cast("timestamp")
    return grants.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= t)))


def nested_products(products: DataFrame, labelers: DataFrame, ingredients: DataFrame, packages: DataFrame) -> DataFrame:
    """A product with its labeler's name and its ingredients and packages as ordered texts."""
    i = ingredients.groupBy("product_ndc").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "strength", "unit"))), "; ").alias("ingredients"))
    p = packages.groupBy("product_ndc").agg(F.array_join(F.array_sort(F.collect_list("package_code")), ",").alias("packages"), F.count(F.lit(1)).alias("n_packages"))
    out = products.join(labelers.select(F.col("code").alias("labeler_code"), F.col("name").alias("labeler_name")), "labeler_code", "left")
    return out.join(i, "product_ndc", "left").join(p, "product_ndc", "left")


def without_ingredients(products: DataFrame, ingredients: DataFrame) -> DataFrame:
    return products.where("active").join(ingredients.select("product_ndc"), "product_ndc", "left_anti")


def possible_brands(products: DataFrame, ingredients: DataFrame) -> DataFrame:
    """product_ndc, brands: brand names, other than the generic one, of other products with the same ingredient set and
    dosage form. Products are gathered by that key, and the names within a key are distinct, so the
    join is of products with names, not of products with products."""
    names = ingredients.groupBy("product_ndc").agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("name")))), "|").alias("set"))
    keyed = products.join(names, "product_ndc").select("product_ndc", "set", "dosage_form", "generic", "brand")
    brand = F.when(F.lower("brand") != F.lower("generic"), F.col("brand"))
    per_brand = keyed.groupBy("set", "dosage_form", brand.alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("name").isNotNull())
    joined = keyed.join(per_brand, ["set", "dosage_form"])
    others = joined.where((F.col("n") > 1) | ~F.col("name").eqNullSafe(F.col("brand")))
    return others.groupBy("product_ndc").agg(F.array_join(F.array_sort(F.collect_set("name")), " && ").alias("brands"))


def labeler_activity(products: DataFrame) -> DataFrame:
    return products.groupBy("labeler_code").agg(F.count(F.lit(1)).alias("n_products"), F.count_if("active").alias("n_active"))


def deactivated_labelers(products: DataFrame) -> DataFrame:
    """Labelers that have products, none of them active."""
    return labeler_activity(products).where((F.col("n_products") > 0) & (F.col("n_active") == 0))


def leftmost_longest(texts: DataFrame, vocabulary: DataFrame, longest: int) -> DataFrame:
    """Of each text (id, text) the leftmost, then longest, phrase of the vocabulary (phrase, in lower case, of at most
    `longest` words): an equality join of the text's words with the phrases' first ones leads to the candidates, and the words behind decide."""
    w = texts.select("id", F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "").alias("w"))
    behind = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice(F.col("w"), i, F.lit(longest)))
    at = w.select("id", F.posexplode(F.when(F.size("w") > 0, behind)).alias("pos", "behind")).withColumn("word", F.get("behind", F.lit(0)))
    n = F.size(F.split("phrase", " "))
    phrases = vocabulary.select("phrase", n.alias("n"), F.substring_index("phrase", " ", 1).alias("word")).where(F.col("n") <= longest).distinct()
    hits = at.join(small(phrases), "word").where(F.array_join(F.slice("behind", F.lit(1), F.col("n")), " ") == F.col("phrase"))
    return hits.groupBy("id").agg(F.min(F.struct("pos", (-F.col("n")).alias("m"), "phrase")).alias("h")).select("id", F.col("h.phrase").alias("phrase"), F.col("h.pos").alias("pos"))


def rank_by_name(products: DataFrame, name: str) -> DataFrame:
    """0 for an exact generic name, 1 for a prefix, 2 for a part, which others aren't."""
    low = F.lower("generic")
    rank = F.when(low == name.lower(), 0).when(F.startswith(low, F.lit(name.lower())), 1).otherwise(2)
    return products.where(F.contains(low, F.lit(name.lower()))).withColumn("rank", rank)


def first_of_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def claim_states(claims: DataFrame, facilities: DataFrame, grants: DataFrame, now: str) -> DataFrame:
    """claim, state, n_admins of each claim (claim, user_id, facility_id, home_id, confirmed) on a facility that exists (id): already_claimed where an active grant makes
    someone its administrator, wrong_facility for a user at home elsewhere, success for a confirmed claim, confirm for one that isn't yet."""
    admins = active_grants(grants, now).where(F.col("role") == "facility_admin").groupBy("facility_id").agg(F.count_distinct("user_id").alias("n"))
    there = claims.join(facilities.select(F.col("id").alias("facility_id")).distinct(), "facility_id").join(admins, "facility_id", "left")
    elsewhere = F.col("home_id").isNotNull() & (F.col("home_id") != F.col("facility_id"))
    state = F.when(F.col("n") > 0, "already_claimed").when(elsewhere, "wrong_facility").when(F.coalesce("confirmed", F.lit(False)), "success").otherwise("confirm")
    return there.select("claim", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n_admins"))
