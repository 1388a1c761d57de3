"""The letters that labelled texts are written in, to tell texts in other alphabets, however short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Texts of each language that its letters are read from, and how many of them must have a letter.
TEXTS_OF_EACH, LEAST_TEXTS = 200, 2


def learned_letters(labelled: DataFrame, of_each: int = TEXTS_OF_EACH) -> str:
    """The letters, in lower case, that `LEAST_TEXTS` or more of a language's texts have, or its only text, of all rows (text, lang) with both.
    Read from the `of_each` texts of each language with the smallest hashes."""
    rows = labelled.select("text", "lang", F.xxhash64("text", F.monotonically_increasing_id()).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= of_each)
    letters = F.filter(F.array_distinct(F.split(F.lower("text"), "")), lambda c: c.rlike(r"^\p{L}$"))
    each = first.select("lang", F.explode(letters).alias("letter"), "k")
    texts = first.groupBy("lang").agg(F.least(F.count(F.lit(1)), F.lit(LEAST_TEXTS)).alias("wanted"))
    n = each.groupBy("lang", "letter").agg(F.count(F.lit(1)).alias("n")).join(texts, "lang")
    return "".join(sorted(r.letter for r in n.where(F.col("n") >= F.col("wanted")).select("letter").distinct().collect()))


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))


def foreign(text: Column, letters: str) -> Column:
    """Whether more than half of the text's letters are none of those; false without a letter."""
    own = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]", "")
    return F.length(F.translate(own, letters, "")) * 2 > F.length(own)
