"""Search by name in a drug directory, by ever looser questions until one has an answer, and by package code.

A question's phrases must stand as whole words in the fields they name. Distinct names of the directory are indexed by word; of all words of
a question's phrases the one in fewest names leads to the candidates, and the phrases themselves decide on each. Entries are joined to the
names that were found at last, so a name that a third of all entries bear is looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ndc as N
from ..storage import stored

FIELDS = ("generic", "brand", "route", "dosage_form")
#: Letters by which words are indexed for phrases whose last word may be cut short.
STEM = 3
WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def spaced(c: Column) -> Column:
    """Those words between blanks, with one before and one after; a phrase of whole words is part of that."""
    return F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))


def split_names(c: Column) -> Column:
    """The names that `and` joins, whatever the case; null for a single one."""
    parts = F.filter(F.transform(F.split(c, r"(?i) and "), F.trim), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts)


def _conditions(**fields: Column) -> Column:
    """Array of (field, phrase, open) of the given phrases; a null or blank phrase asks nothing."""
    each = [F.array(F.struct(F.lit(f).alias("field"), c.alias("phrase"), F.lit(False).alias("open"))) for f, c in fields.items() if f != "ingredients"]
    return F.concat(*each)


def _of_ingredients(names: Column, open_: bool) -> Column:
    return F.transform(F.coalesce(names, _no_names()), lambda x: F.struct(F.lit("ingredient").alias("field"), x.alias("phrase"), F.lit(open_).alias("open")))


def _cleaned(conditions: Column) -> Column:
    spelt = F.transform(conditions, lambda c: F.struct(c["field"].alias("field"), F.array_join(words(F.coalesce(c["phrase"], F.lit(""))), " ").alias("phrase"), c["open"].alias("open")))
    return F.filter(spelt, lambda c: c["phrase"] != "")


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _spelt(directory: DataFrame) -> DataFrame:
    """The directory with its fields spaced, its ingredients' names as `ingredient`, and name_id, a digest of all of them."""
    said = {f: F.coalesce(spaced(F.col(f)), F.lit("")) for f in FIELDS} | {"ingredient": F.array_sort(F.transform(F.coalesce("ingredients", _no_names()), spaced))}
    return directory.withColumns(said).withColumn("name_id", F.sha2(F.to_json(F.struct(*FIELDS, "ingredient")), 256))


def directory_names(directory: DataFrame) -> DataFrame:
    """name_id and spaced fields of the distinct names of a directory (generic, brand, route, dosage_form, ingredients)."""
    return _spelt(directory).select("name_id", *FIELDS, "ingredient").dropDuplicates(["name_id"])


def name_index(names: DataFrame) -> DataFrame:
    """(field, word, name_id), and (field, "stem:" and a word's first letters, name_id)."""
    text = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS], F.struct(F.lit("ingredient").alias("field"), F.array_join("ingredient", " ").alias("text")))
    each = names.select("name_id", F.explode(text).alias("x")).select("name_id", "x.field", F.explode(F.array_distinct(F.split(F.trim("x.text"), " +"))).alias("word")).where("word != ''")
    stems = each.select("field", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(STEM), F.length("word"))), lambda n: F.concat(F.lit("stem:"), F.substring(F.col("word"), F.lit(1), n)))).alias("word"), "name_id")
    return each.select("field", "word", "name_id").unionByName(stems).distinct()


def _keys(c: Column) -> Column:
    """The index words of one condition: whole ones, and the last as its first letters if it may be cut short."""
    w = F.split(c["phrase"], " ")
    whole = F.when(c["open"], F.slice(w, 1, F.size(w) - 1)).otherwise(w)
    stem = F.concat(F.lit("stem:"), F.substring(F.element_at(w, -1), 1, STEM))
    return F.transform(F.when(c["open"], F.array_append(whole, stem)).otherwise(whole), lambda x: F.struct(c["field"].alias("field"), x.alias("word")))


def _holds(c: Column) -> Column:
    """Whether a name (its columns) meets a condition."""
    phrase = F.concat(F.lit(" "), c["phrase"], F.when(c["open"], F.lit("")).otherwise(F.lit(" ")))
    one = F.lit(False)
    for f in FIELDS:
        one = F.when(c["field"] == f, F.contains(F.col(f), phrase)).otherwise(one)
    return F.when(c["field"] == "ingredient", F.exists("ingredient", lambda x: F.contains(x, phrase))).otherwise(one)


def names_found(asked: DataFrame, names: DataFrame, index: DataFrame) -> DataFrame:
    """(question, name_id) of the names that meet all of a question's conditions. asked: question, conditions; without any it finds nothing."""
    asked = asked.select("question", _cleaned(F.col("conditions")).alias("conditions")).where(F.size("conditions") > 0)
    keys = asked.select("question", F.explode(F.flatten(F.transform("conditions", _keys))).alias("k")).select("question", "k.field", "k.word").distinct()
    held = index.groupBy("field", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(held, ["field", "word"], "left").groupBy("question").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "field", "word")).alias("k"))
    leads = rarest.where(F.col("k.n") > 0).select("question", "k.field", "k.word")
    near = leads.join(index, ["field", "word"]).select("question", "name_id")
    return near.join(asked, "question").join(names, "name_id").where(F.forall("conditions", _holds)).select("question", "name_id")


def looser_questions() -> list[tuple[Column, Column, Column]]:
    """The tiers in order: how a match is named, which questions it is for, and their conditions."""
    generic, brand = F.nullif(F.trim("generic"), F.lit("")), F.nullif(F.trim("brand"), F.lit(""))
    rest = {"route": F.col("route"), "dosage_form": F.col("dosage_form")}
    given = _of_ingredients(F.col("ingredients"), False)
    via = F.when(generic.isNotNull(), "generic_name").when(brand.isNotNull(), "brand_name").otherwise("other")
    parts, brand_parts = split_names(generic), split_names(brand)
    asked = lambda extra, **fields: F.concat(_conditions(**fields, **rest), extra)
    return [
        (via, F.lit(True), asked(given, generic=generic, brand=brand)),
        (F.lit("generic_name_split"), parts.isNotNull(), asked(_of_ingredients(parts, False), brand=brand)),
        (F.lit("generic_name_split_wildcard"), parts.isNotNull(), asked(_of_ingredients(parts, True), brand=brand)),
        (F.lit("generic_as_brand"), generic.isNotNull() & brand.isNull(), asked(given, brand=generic)),
        (F.lit("brand_name_split_wildcard"), generic.isNull() & brand_parts.isNotNull(), asked(_of_ingredients(brand_parts, True))),
    ]


def lookup_names(questions: DataFrame, directory: DataFrame, most_ingredients: int | None = None) -> DataFrame:
    """question, matched_via, entry, rank of every directory entry that answers a question.

    questions: question (unique), generic, brand, route, dosage_form, ingredients (array); nulls ask nothing. directory: entry, generic, brand,
    route, dosage_form, ingredients. The tiers are tried in order, each for those questions only that no earlier one has answered; matched_via names the
    tier that did. A brand's answers are narrowed to those that also bear the generic name of the first of them, by entry.
    rank is 0 where the name asked for is an answer's name, 1 where it begins with it, 2 else; most_ingredients leaves out
    entries with more. A question without answers has no rows. Entries with the same names all answer.
    """
    names = stored(directory_names(directory), "names")
    index = stored(name_index(names), "name-index")
    open_, answers = questions, None
    for via, wanted, conditions in looser_questions():
        asked = open_.where(wanted)
        if answers is not None and asked.isEmpty():
            continue
        asked = asked.withColumn("matched_via", via)
        hits = names_found(asked.select("question", conditions.alias("conditions")), names, index)
        hits = stored(hits.join(asked.select("question", "matched_via"), "question"), "tier")
        answers = hits if answers is None else answers.unionByName(hits)
        open_ = stored(open_.join(hits.select("question"), "question", "left_anti"), "unanswered")
        if open_.isEmpty():
            break

    own = directory.select("entry", *FIELDS, "ingredients", F.col("generic").alias("own_generic"), F.col("brand").alias("own_brand"))
    entries = _spelt(own).select("entry", "name_id", F.col("own_generic").alias("generic"), F.col("own_brand").alias("brand"), F.size("ingredient").alias("n_ingredients"))
    entries = stored(entries, "entries")
    first = entries.groupBy("name_id").agg(F.min(F.struct("entry", "generic")).alias("first"))
    brands = answers.where(F.col("matched_via").startswith("brand_name"))
    found = brands.join(first, "name_id").groupBy("question").agg(F.min("first").alias("first")).join(questions, "question")
    narrow = _conditions(brand=F.col("brand"), generic=F.col("first.generic"), route=F.col("route"), dosage_form=F.col("dosage_form"))
    asked = found.where(F.coalesce(F.trim("first.generic"), F.lit("")) != "").select("question", narrow.alias("conditions"))
    narrowed = stored(names_found(asked, names, index).withColumn("matched_via", F.lit("brand_name_narrowed")), "narrowed")
    answers = answers.join(narrowed.select("question").distinct(), "question", "left_anti").unionByName(narrowed.select("question", "name_id", "matched_via"))

    out = answers.join(entries, "name_id").join(questions.select("question", F.lower(F.trim("generic")).alias("g"), F.lower(F.trim("brand")).alias("b")), "question")
    if most_ingredients is not None:
        out = out.where(F.col("n_ingredients") <= most_ingredients)
    key = F.coalesce(F.nullif("g", F.lit("")), F.nullif("b", F.lit("")))
    pairs = [(F.nullif("g", F.lit("")), F.lower("generic")), (F.nullif("b", F.lit("")), F.lower("brand"))]
    rank = F.lit(2)
    for asked_name, name in reversed(pairs):
        rank = F.when(asked_name.isNotNull() & (name == key), 0).when(asked_name.isNotNull() & F.startswith(name, key), 1).otherwise(rank)
    return out.select("question", "matched_via", "entry", rank.alias("rank"))


def lookup_counts(questions: DataFrame, directory: DataFrame) -> DataFrame:
    """question, matched_via, n, n_exact, best of each question that lookup_names answers: how many entries, how many of rank 0, and the best and
    then smallest one. Entries that are alike in all but their number are looked up as one, so the work grows with the names."""
    kinds = directory.groupBy(*FIELDS, "ingredients").agg(F.min("entry").alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = stored(kinds.select(F.struct("first", "generic", "n").alias("entry"), *FIELDS, "ingredients"), "kinds")
    n = F.col("entry.n")
    hits = lookup_names(questions, kinds).groupBy("question")
    exact = F.sum(F.when(F.col("rank") == 0, n).otherwise(0)).alias("n_exact")
    return hits.agg(F.min("matched_via").alias("matched_via"), F.sum(n).alias("n"), exact, F.min(F.struct("rank", "entry.first")).alias("best")).withColumn("best", F.col("best.first"))


def texts_with(texts: DataFrame, terms: DataFrame, size: int = 4) -> DataFrame:
    """(text, term) of the distinct texts (text) that contain a term (term, of `size` characters or more; shorter ones find nothing), as
    any part of them. A term is looked for by the one of its pieces of `size` characters that fewest terms have."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))
    held = terms.where(F.length("term") >= size).select("term").distinct().select("term", F.explode(pieces(F.col("term"))).alias("piece"))
    n = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    keyed = held.join(n, "piece").groupBy("term").agg(F.min(F.struct("n", "piece")).alias("k")).select("term", "k.piece")
    each = texts.where(F.length("text") >= size).select("text").distinct().select("text", F.explode(pieces(F.col("text"))).alias("piece"))
    return each.join(keyed, "piece").where(F.contains("text", F.col("term"))).select("text", "term")


def lookup_packages(codes: DataFrame, directory: DataFrame) -> DataFrame:
    """code, entry, field: directory rows (entry, product_ndc, package_ndc) that a printed code names in any of its variants, as their package or product
    code; package where both do."""
    tried = codes.select("code").distinct().select("code", F.explode(F.coalesce(N.variants(F.trim("code")), _no_names())).alias("key"))
    listed = directory.select("entry", F.explode(F.array(F.struct(F.lit("package_ndc").alias("field"), F.col("package_ndc").alias("key")), F.struct(F.lit("product_ndc").alias("field"), F.col("product_ndc").alias("key")))).alias("k"))
    hits = tried.join(listed.select("entry", "k.field", "k.key").where(F.col("key").isNotNull()), "key")
    return hits.groupBy("code", "entry").agg(F.min("field").alias("field"))
