"""Label fields with a drug directory: names found in text by joins, votes over readings, and blanks filled from the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import label as L, ndc as N, text as X
from ..storage import stored
from .labels import numbered_lines, tally
from .lookup import spaced

#: How much a name found in a line counts, by field, and what comes from the directory; from where on a code is trusted.
NAME_PRIORS = {"mfg": 0.90, "brand": 0.95, "product": 0.90}
FILLED_PRIOR = 0.85
TRUSTED_CODE = 0.70


def vocabulary(directory: DataFrame, labelers: DataFrame) -> DataFrame:
    """field, phrase (spaced words), name: labelers' names without suffixes, brand names that say more than the generic one, and
    generic names. Of names of the same words the first counts."""
    brands = directory.where(~X.descriptive(F.col("brand"), F.col("generic"))).select(F.lit("brand").alias("field"), F.col("brand").alias("name"))
    names = brands.unionByName(directory.select(F.lit("product").alias("field"), F.col("generic").alias("name")))
    names = names.unionByName(labelers.select(F.lit("mfg").alias("field"), X.clean_labeler(F.col("name")).alias("name"))).distinct()
    return names.withColumn("phrase", spaced(F.col("name"))).where(F.trim("phrase") != "").groupBy("field", "phrase").agg(F.min("name").alias("name"))


def names_in(lines: DataFrame, names: DataFrame) -> DataFrame:
    """line, field, name: of each distinct line (line) the leftmost, then longest name of each field that stands in it as whole words.

    A name is looked for where the one of its words stands that fewest names have, so lines and names meet by equality and names that share a
    frequent word don't meet every line that has it. Names without words, null and blank lines find nothing.
    """
    words = names.select("field", "phrase", "name", F.explode(F.array_distinct(F.split(F.trim("phrase"), " "))).alias("word"))
    held = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = words.join(held, "word").groupBy("field", "phrase", "name").agg(F.min(F.struct("n", "word")).alias("k")).select("field", "phrase", "name", "k.word")
    text = lines.select("line").distinct().withColumn("text", spaced(F.col("line")))
    each = text.select("line", "text", F.explode(F.array_distinct(F.split(F.trim("text"), " "))).alias("word")).where("word != ''")
    hits = each.join(keyed, "word").where(F.contains("text", F.col("phrase")))
    best = hits.groupBy("line", "field").agg(F.min(F.struct(F.instr("text", F.col("phrase")).alias("pos"), (-F.length("phrase")).alias("m"), "name")).alias("h"))
    return best.select("line", "field", F.col("h.name").alias("name"))


def label_fields(lines: DataFrame, directory: DataFrame, labelers: DataFrame, trusted: float = TRUSTED_CODE, blank_codes: bool = False) -> DataFrame:
    """crop, field, value, confidence, source: what a label's readings and a directory say, one row for each field that is known.

    lines: crop, pool, line_no, text. directory: product_ndc, generic, brand, labeler_name, strength_text. labelers: code, name. Fields of label text and names of the directory
    are each voted on over readings (source `label`). A code of a confidence of `trusted` or more that the directory lists fills in
    brand (unless it merely describes), product, mfg and strength where the label has none (`directory`), and any code its labeler's name
    where there is still none (`labeler`). What is printed is never replaced. A directory that lists a code twice gives the smallest of each value. Blank lines and crops without
    any give nothing. With `blank_codes` a line that says NDC without a well-formed code votes for an empty one, at the label's prior.
    """
    lines = lines.where(F.trim("text") != "").select("crop", "pool", "line_no", F.trim("text").alias("text"))
    each = numbered_lines(lines)
    read = {f: extract(F.col("line")) for f, extract in L.EXTRACTORS.items()}
    if blank_codes:
        read["ndc"] = F.coalesce(read["ndc"], F.when(F.col("line").rlike(r"\bNDC\b"), F.struct(F.lit("").alias("value"), F.lit(0.95).alias("prior"))))
    simple = F.array(*[F.struct(F.lit(f).alias("field"), x.alias("f")) for f, x in read.items()])
    found = each.select("crop", "pool", "at", F.explode(simple).alias("x")).select("crop", "pool", "at", "x.field", "x.f")
    named = each.join(names_in(each, vocabulary(directory, labelers)), "line")
    prior = F.create_map(*[F.lit(x) for pair in NAME_PRIORS.items() for x in pair])[F.col("field")]
    named = named.select("crop", "pool", "at", "field", F.struct(F.col("name").alias("value"), prior.alias("prior")).alias("f"))
    printed = tally(found.unionByName(named), lines).select("crop", "field", "value", "confidence", F.lit("label").alias("source"))
    printed = stored(printed, "label-fields")

    codes = printed.where("field = 'ndc'").select("crop", F.col("value").alias("ndc"), "confidence")
    entry = [F.min(F.when(~X.descriptive(F.col("brand"), F.col("generic")), F.col("brand"))).alias("brand"), F.min("generic").alias("product"), F.min(X.clean_labeler(F.col("labeler_name"))).alias("mfg"), F.min("strength_text").alias("strength")]
    entries = directory.groupBy("product_ndc").agg(*entry)
    tried = codes.where(F.col("confidence") >= trusted).select("crop", F.posexplode(N.lookup_candidates(F.col("ndc"))).alias("try", "product_ndc"))
    first = tried.join(entries, "product_ndc").groupBy("crop").agg(F.min_by(F.struct("brand", "product", "mfg", "strength"), "try").alias("e"))
    said = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").alias("value")) for f in ("brand", "product", "mfg", "strength")])
    filled = first.select("crop", F.explode(said).alias("x")).select("crop", "x.field", "x.value", F.lit(FILLED_PRIOR).alias("confidence"), F.lit("directory").alias("source"), F.lit(1).alias("order"))
    by_code = labelers.groupBy("code").agg(F.min(X.clean_labeler(F.col("name"))).alias("value"))
    makers = codes.join(by_code, N.labeler_code(F.col("ndc")) == F.col("code")).select("crop", F.lit("mfg").alias("field"), "value", F.lit(FILLED_PRIOR).alias("confidence"), F.lit("labeler").alias("source"), F.lit(2).alias("order"))
    all_ = printed.withColumn("order", F.lit(0)).unionByName(filled).unionByName(makers).where(F.col("value").isNotNull())
    one = all_.groupBy("crop", "field").agg(F.min(F.struct("order", "value", "confidence", "source")).alias("x"))
    return one.select("crop", "field", "x.value", F.round("x.confidence", 3).alias("confidence"), "x.source")
