"""Label text of many readings: votes on fields, instructions, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import label as L
from ..functions.amounts import let


def pooled(lines: DataFrame) -> DataFrame:
    """crop, pool, lines: each reading's lines in order, as one array (a label has tens of lines)."""
    return lines.groupBy("crop", "pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """crop, pool, at, line: each reading's lines in order, then its pairs of lines."""
    return pooled(lines).select("crop", "pool", F.posexplode(L.with_adjacent(F.col("lines"))).alias("at", "line"))


def vote(lines: DataFrame, field: str) -> DataFrame:
    """crop, value, agreement, confidence of one field by `tally`, all rounded to three places."""
    candidates = F.transform(L.with_adjacent(F.col("lines")), L.EXTRACTORS[field])  # in the array, so that each line is read once
    found = pooled(lines).select("crop", "pool", F.lit(field).alias("field"), F.posexplode(candidates).alias("at", "f"))
    return tally(found, lines).select("crop", "value", F.round("agreement", 3).alias("agreement"), F.round("confidence", 3).alias("confidence"))


def tally(found: DataFrame, lines: DataFrame) -> DataFrame:
    """crop, field, value, prior, agreement, confidence: of each reading the candidate (crop, pool, field, at, f of value and prior) of
    the highest prior, the first of equals; of those the value most readings have, the first met of equals. Agreement is the
    share of all of the crop's readings, of `lines`, that have it; confidence its best prior times agreement, at most 1."""
    best = found.where(F.col("f").isNotNull()).groupBy("crop", "field", "pool").agg(F.max(F.struct(F.col("f.prior").alias("prior"), (-F.col("at")).alias("m"), F.col("f.value").alias("value"))).alias("b"))
    votes = best.groupBy("crop", "field", F.col("b.value").alias("value")).agg(F.count(F.lit(1)).alias("votes"), F.min("pool").alias("first"), F.max("b.prior").alias("prior"))
    pools = lines.groupBy("crop").agg(F.count_distinct("pool").alias("pools"))
    winner = votes.groupBy("crop", "field").agg(F.max(F.struct("votes", (-F.col("first")).alias("m"), "value", "prior")).alias("w")).join(pools, "crop")
    agreement = F.col("w.votes") / F.col("pools")
    return winner.select("crop", "field", F.col("w.value").alias("value"), F.col("w.prior").alias("prior"), agreement.alias("agreement"), F.least(F.lit(1.0), F.col("w.prior") * agreement).alias("confidence"))


def voted_instructions(lines: DataFrame) -> DataFrame:
    """crop, instructions, agreement: distinct directive lines in the order met, and the share of readings with one."""
    hits = lines.withColumn("f", L.instructions(F.col("text")))
    of_pool = hits.groupBy("crop", "pool").agg(F.max(F.col("f").isNotNull().cast("int")).alias("has"))
    share = of_pool.groupBy("crop").agg((F.sum("has") / F.count(F.lit(1))).alias("agreement"))
    first = hits.where(F.col("f").isNotNull()).groupBy("crop", F.col("f.value").alias("value")).agg(F.min(F.struct("pool", "line_no")).alias("at"))
    text = first.groupBy("crop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), " | ").alias("instructions"))
    return text.join(share, "crop").select("crop", "instructions", F.round("agreement", 3).alias("agreement"))


#: Groups of at most so many lots are compared as one array; of larger ones the lots meet by equal substrings.
GROUP_LOTS = 32


def distinguishing(lots: DataFrame, group: str = "order_id", lot: str = "lot", most: int = GROUP_LOTS) -> DataFrame:
    """For each distinct lot of a group its shortest, then leftmost substring that no other lot of the group has: start (from 0)
    and segment, and the lot with the segment in brackets; start -1 where there is none."""
    d = lots.select(group, lot).repartition(group).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    together = d.where(F.col("n") <= most).groupBy(group).agg(F.collect_list(F.struct(lot)).alias("lots"))
    each = together.select(group, F.explode(F.transform("lots", lambda x: F.struct(x[lot].alias(lot), _own_span(x[lot], F.col("lots"), lot).alias("b")))).alias("x"))
    each = each.select(group, F.col(f"x.{lot}").alias(lot), F.when(F.col(group).isNotNull(), F.col("x.b")).alias("b"))
    out = each.unionByName(_own_spans_of_many(d.where(F.col("n") > most).select(group, lot), group, lot))
    out = out.select(group, lot, "b", F.substring(F.col(lot), F.col("b.start") + 1, F.col("b.n")).alias("segment"))
    marked = F.when(F.col("b").isNull(), F.col(lot)).otherwise(
        F.concat(F.substring(F.col(lot), F.lit(1), F.col("b.start")), F.lit("["), F.col("segment"), F.lit("]"), F.substring(F.col(lot), F.col("b.start") + F.col("b.n") + 1, F.length(lot)))
    )
    return out.select(group, lot, F.coalesce("b.start", F.lit(-1)).alias("start"), "segment", marked.alias("marked"))


def _own_span(lot: Column, lots: Column, name: str) -> Column:
    """(n, start) of the shortest, then leftmost substring that none of the other lots has. Short lengths are tried one after another, in
    the others joined by NUL; substrings with NUL are looked for in one after another."""

    def among(others: Column) -> Column:
        within = lambda part: F.exists(lots, lambda o: o[name].isNotNull() & (o[name] != lot) & F.contains(o[name], part))
        elsewhere = lambda part: F.contains(others, part) & (~F.contains(part, F.lit("\0")) | within(part))
        starts = lambda n: F.filter(F.sequence(F.lit(0), F.length(lot) - n), lambda start: ~elsewhere(F.substring(lot, start + 1, n)))
        first = lambda n: let(F.get(starts(n), F.lit(0)), lambda start: F.when(start.isNotNull(), F.struct(n.alias("n"), start.alias("start"))))
        short = [F.when(F.length(lot) >= n, first(F.lit(n))) for n in (1, 2, 3)]
        longer = F.when(F.length(lot) > 3, F.get(F.array_compact(F.transform(F.sequence(F.lit(4), F.length(lot)), first)), F.lit(0)))
        return F.coalesce(*short, longer)

    return let(F.array_join(F.transform(F.filter(lots, lambda o: o[name] != lot), lambda o: o[name]), "\0"), among)


def _own_spans_of_many(d: DataFrame, group: str, lot: str) -> DataFrame:
    """group, lot, b of (n, start), by all substrings of all lots."""
    spans = d.where(F.length(lot) > 0).select(group, lot, F.explode(F.sequence(F.lit(1), F.length(lot))).alias("n")).select(group, lot, "n", F.explode(F.sequence(F.lit(0), F.length(lot) - F.col("n"))).alias("start"))
    first = spans.groupBy(group, F.substring(F.col(lot), F.col("start") + 1, F.col("n")).alias("segment")).agg(F.min(lot).alias("least"), F.max(lot).alias(lot), F.min(F.struct("n", "start")).alias("at"))
    best = first.where(F.col("least") == F.col(lot)).groupBy(group, lot).agg(F.min("at").alias("b"))
    return d.join(best, [group, lot], "left").select(group, lot, "b")
