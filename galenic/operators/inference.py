"""Rules on dosage forms and names: component roles, compounding steps, and what a labeler makes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Names of plain carriers and of sterile water.
CARRIERS = r"(?i)\b(sodium\s+chloride|normal\s+saline|dextrose|lactated\s+ringer|ringers?\s+lactate|ringer'?s?|0\.9\s*%?\s*nacl|d5w|d10w|d5ns|d5lr)\b"
WATER = r"(?i)\b(sterile\s+water|water\s+for\s+injection|bacteriostatic\s+water|swfi|swi)\b"


def role(form: Column, generic: Column) -> Column:
    """What part a component plays, by its dosage form, and by its name for water and carriers."""
    f, g = F.upper(F.coalesce(form, F.lit(""))), F.coalesce(generic, F.lit(""))
    has = lambda x: F.contains(f, F.lit(x))
    return (
        F.when(g.rlike(WATER), "swfi")
        .when(has("LYOPHI"), "lyophilized_powder")
        .when(has("POWDER") & has("INJECTION") & has("SUSPENSION"), "suspension")
        .when(has("POWDER") & has("INJECTION"), "powder_for_solution")
        .when(has("SUSPENSION") & has("INJECTION"), "suspension")
        .when(has("CONCENTRAT"), "concentrated_injection")
        .when(has("INJECTION") & g.rlike(CARRIERS), "iv_diluent")
        .when(has("INJECTION"), "ready_injection")
        .otherwise("unknown")
    )


def inferred_process(trays: DataFrame) -> DataFrame:
    """Of each tray (tray_id, pos, dosage_form, generic) the roles in order, and whether it takes reconstitution, dilution, repacking
    or combination. One grouping; the rules are flags over the counts of roles."""
    r = trays.select("tray_id", "pos", role(F.col("dosage_form"), F.col("generic")).alias("role"))
    count = lambda *roles: F.count_if(F.col("role").isin(*roles))
    g = r.groupBy("tray_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]), ",").alias("roles"),
        count("lyophilized_powder", "powder_for_solution").alias("powder"),
        count("swfi").alias("swfi"), count("iv_diluent").alias("iv"), count("concentrated_injection").alias("conc"),
        count("ready_injection").alias("ready"), count("suspension").alias("susp"), count("unknown").alias("unknown"),
    )
    some = lambda c: F.col(c) > 0
    one = F.col("n") == 1
    recon = F.when(one, some("powder")).otherwise(some("powder") & (some("swfi") | some("iv")))
    dilution = F.when(one, some("conc")).otherwise(some("iv") & (some("powder") | some("swfi") | some("conc") | some("ready")))
    repack = one & (some("ready") | some("susp"))
    drugs = F.col("n") - F.col("iv") - F.col("swfi") - F.col("unknown")
    combination = ~one & (drugs >= 2) & ~recon & ~dilution
    parts = F.concat_ws(" + ", F.when(recon, "Reconstitution"), F.when(dilution, "Dilution"))
    steps = F.concat_ws(",", F.when(recon, "reconstitution"), F.when(dilution, "dilution"), F.when(combination, "combination"), F.when(repack, "repack"))
    text = F.when(repack, "Repack-Only").when(parts != "", parts).when(combination, "Combination Admixture").otherwise("Unknown Process")
    return g.select("tray_id", "roles", steps.alias("steps"), recon.alias("needs_recon"), dilution.alias("needs_dilution"), repack.alias("repack_only"), text.alias("description"))


#: A small default vocabulary; a user passes lists of their own. Terms are found as parts of a name, not as words.
RX_TERMS = ("vancomycin", "heparin", "potassium chloride", "injection")
OTC_TERMS = ("loratadine", "sodium chloride", "zinc oxide", "water for injection")
COSMETIC_HINTS = ("sunscreen", "lotion", "cream")


def bucket(text: Column, rx: tuple[str, ...] = RX_TERMS, otc: tuple[str, ...] = OTC_TERMS, hints: tuple[str, ...] = COSMETIC_HINTS) -> Column:
    """rx, otc or unknown. If both are found it is rx, unless a cosmetic hint makes it otc."""
    n = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|g|ml|%|unt)\b", " ")
    n = F.trim(F.regexp_replace(F.regexp_replace(n, "[^a-z0-9 ]+", " "), r"\s+", " "))
    # an alternation is evaluated once over the text, however many terms there are
    some = lambda terms: n.rlike("(?:" + "|".join(re.escape(t.lower()) for t in terms) + ")")
    r, o, c = some(rx), some(otc), some(hints)
    return F.when(n == "", "unknown").when(r & o, F.when(c, "otc").otherwise("rx")).when(r, "rx").when(o | c, "otc").otherwise("unknown")


def classified_labelers(products: DataFrame, key: str, text: Column, order: Column, examples: int = 3) -> DataFrame:
    """Of each labeler counts and shares of buckets, a determination with its confidence, and its first examples of rx."""
    b = products.select(F.col(key), text.alias("text"), order.alias("o"), bucket(text).alias("bucket"))
    g = b.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if(F.col("bucket") == "rx").alias("rx_count"), F.count_if(F.col("bucket") == "otc").alias("otc_count"), F.count_if(F.col("bucket") == "unknown").alias("unknown_count"),
    )
    from pyspark.sql import Window

    first = b.where(F.col("bucket") == "rx").withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("o"))).where(F.col("rn") <= examples)
    texts = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), "; ").alias("rx_examples"))
    n = F.col("n_products")
    rx, otc, unknown = F.col("rx_count") / n, F.col("otc_count") / n, F.col("unknown_count") / n
    none = (rx + otc == 0) | (unknown > 0.8)
    share = F.when(~none, rx / (rx + otc))
    kind = F.when(none, "indeterminate").when(share >= 0.65, "clinical").when(share <= 0.30, "otc_cosmetic").otherwise("mixed")
    confidence = F.when(none, 0.0).when(share >= 0.65, share).when(share <= 0.30, 1 - share).otherwise(1 - F.abs(share - 0.5) * 2)
    return g.join(texts, key, "left").select(key, "n_products", "rx_count", "otc_count", "unknown_count", F.round(share, 3).alias("rx_share"), kind.alias("determination"), F.round(confidence, 3).alias("confidence"), "rx_examples")
