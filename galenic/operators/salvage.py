"""Fields of a label from its best readings: each field from the highest-ranked reading that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ndc as N, text as X
from .directory import names_in
from .lookup import spaced

#: Readings of a label that count, the best by score.
BEST_READINGS = 8
#: Products by what their label says, the first that is found counts.
PRODUCTS = (
    ("0.9% Sodium Chloride Injection, USP", r"0\.9\s*%|sodium\s+chlor[il]de"),
    ("Thiamine HCl Injection", r"th[il]am[il]ne"),
    ("Dextrose 5% Injection, USP", r"\bdextrose\b"),
    ("Lactated Ringer's Injection, USP", r"lactated\s+ringer"),
    ("Heparin Sodium Injection", r"\bhepar[il]n\b"),
    ("Potassium Chloride Injection", r"potass[il]um\s+chlor[il]de"),
    ("Magnesium Sulfate Injection", r"magnes[il]um\s+sulf"),
)
SIMPLE = ("product", "ndc", "lot", "expiration", "volume_ml", "strength")
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _after(text: Column, label: str, value: str) -> Column:
    """The first value that follows a label, with signs and blanks between them."""
    got = F.regexp_extract(text, rf"\b(?:{label})[\s:#.]*({value})", 1)
    return F.when(got != "", got)


def code(text: Column) -> Column:
    """A code labelled NDC, misread digits repaired: ten and eleven digits as 5-4-2, with a leading zero for ten; others as they stand."""
    digit = "[0-9OIlS]"
    raw = _after(text, "(?i:NDC)", rf"{digit}{{4,5}}[-\s]?{digit}{{3,4}}[-\s]?{digit}{{1,2}}(?![0-9A-Za-z])")
    fixed = F.translate(raw, "OIlS", "0115")
    d = F.regexp_replace(fixed, "[^0-9]", "")
    whole = F.lpad(d, 11, "0")
    return F.when(F.length(d).isin(10, 11), F.concat_ws("-", F.substring(whole, 1, 5), F.substring(whole, 6, 4), F.substring(whole, 10, 2))).otherwise(fixed)


def strength(text: Column) -> Column:
    """An amount in a volume (`5 mg/2 mL`), else an amount of mass alone (`5 mg`)."""
    per = rf"(?i)\b({NUMBER})\s*(mg|mcg|g|units?|u)\s*/\s*({NUMBER})\s*ml\b"
    part = lambda p, k: F.regexp_extract(text, p, k)
    alone = rf"(?i)\b({NUMBER})\s*(mg|mcg|g)\b"
    ratio = F.concat(part(per, 1), F.lit(" "), F.lower(part(per, 2)), F.lit("/"), part(per, 3), F.lit(" mL"))
    return F.when(part(per, 1) != "", ratio).when(part(alone, 1) != "", F.concat_ws(" ", part(alone, 1), F.lower(part(alone, 2))))


def product(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PRODUCTS):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def fields_of(text: Column) -> dict[str, Column]:
    """The fields of a reading's text; null where it has none. Dates follow EXP or a word that begins with it, lots LOT or Lot."""
    one = F.replace(text, F.lit("\n"), F.lit(" "))
    date = r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9]{1,2}[-/.][0-9]{2,4}(?:[-/.][0-9]{2,4})?|[A-Za-z]{3} ?[0-9]{2,4}"
    volume = F.regexp_extract(one, rf"\b({NUMBER})\s*m[lL]\b", 1)
    return {
        "product": product(one), "ndc": code(one), "lot": _after(one, r"(?:LOT|Lot)(?:\s*No)?", "[A-Z0-9]{4,12}(?![A-Z0-9])"),
        "expiration": _after(one, r"(?i:EXP(?:ires|iration)?(?:\.?\s*DATE)?)", date), "volume_ml": F.when(volume != "", volume), "strength": strength(one),
    }


def ranked(readings: DataFrame, best: int = BEST_READINGS) -> DataFrame:
    """Of each crop the readings (crop, reading, text, score) of the highest scores, those without words left out: with rank from 0. Of equal scores the smaller
    reading comes first."""
    order = Window.partitionBy("crop").orderBy(F.col("score").desc(), F.col("reading"))
    some = readings.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return some.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < best)


def salvaged(readings: DataFrame, labelers: DataFrame, best: int = BEST_READINGS) -> DataFrame:
    """crop, product, ndc, lot, expiration, volume_ml, strength, manufacturer, manufacturer_source: each from the best-ranked of a crop's readings
    that has it.

    A manufacturer comes from a code's labeler (source `ndc`) or, where that is unknown, from the first labeler's name in the text (`name`);
    a code's in any reading counts for more than a name in a better one. labelers: code, name. A crop whose readings have no words has nulls only.
    """
    top = ranked(readings, best).select("crop", "rank", "text", *[c.alias(f) for f, c in fields_of(F.col("text")).items()])
    makers = labelers.groupBy(F.col("code").alias("labeler")).agg(F.min(X.clean_labeler(F.col("name"))).alias("by_code"))
    words = labelers.select(F.lit("mfg").alias("field"), X.clean_labeler(F.col("name")).alias("name")).distinct()
    words = words.withColumn("phrase", spaced(F.col("name"))).where(F.trim("phrase") != "").groupBy("field", "phrase").agg(F.min("name").alias("name"))
    named = names_in(top.select(F.col("text").alias("line")), words).select(F.col("line").alias("text"), F.col("name").alias("by_name"))
    top = top.withColumn("labeler", N.labeler_code(F.col("ndc"))).join(makers, "labeler", "left").join(named, "text", "left")
    source = F.when(F.col("by_code").isNotNull(), 0).when(F.col("by_name").isNotNull(), 1)
    first = [F.min(F.when(F.col(f).isNotNull(), F.struct("rank", F.col(f).alias("value")))).alias(f) for f in SIMPLE]
    maker = F.min(F.when(source.isNotNull(), F.struct(source.alias("source"), "rank", F.coalesce("by_code", "by_name").alias("value")))).alias("maker")
    one = top.groupBy("crop").agg(*first, maker)
    crops = readings.select("crop").distinct().join(one, "crop", "left")
    return crops.select("crop", *[F.col(f"{f}.value").alias(f) for f in SIMPLE], F.col("maker.value").alias("manufacturer"), F.when(F.col("maker.source") == 0, "ndc").when(F.col("maker.source") == 1, "name").alias("manufacturer_source"))
