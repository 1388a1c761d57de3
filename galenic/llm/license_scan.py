"""License scans: ordered signature rules behind a keyword gate, with interval-containment suppression.

Every step is a built-in expression over one row, so the scan has no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import text_of
from .license_rules import ANCHORS, Rule, rules as all_rules

#: What is no part of a word: ASCII other than digits and letters. Letters lose their case later, so both cases stay.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCORES = {3: 1.0, 2: 0.8, 1: 0.4}
MARK = "\u0001"


def _rule_array(rules: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.rank).alias("rank"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.base).alias("base"),
            )
            for r in rules
        ]
    )


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(low: Column, hit: Column) -> Column:
    """A rule's matches as intervals of word numbers. Each match gets a mark, and words that carry one are counted off."""
    marked = F.split(F.regexp_replace(low, hit["regex"], F.lit(f"{MARK}$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i - 1)), lambda i: i.isNotNull())
    each = F.transform(
        F.array(starts),
        lambda s: F.transform(
            hit["found"],
            lambda m, k: F.struct(
                s[k].alias("start"),
                (-(s[k] + _spaces(m))).alias("minus_end"),
                (-hit["priority"]).alias("minus_priority"),
                hit["rank"].alias("rank"),
                hit["label"].alias("label"),
                hit["base"].alias("base"),
            ),
        ),
    )
    return F.flatten(each)


def _unsuppressed(found: Column) -> Column:
    """Sweep over detections by start, longest and strongest first: one that lies inside an earlier one of
    at least its priority is suppressed. The sweep needs only the furthest end so far of each priority."""
    start = F.struct(
        F.lit(-1).alias("end3"), F.lit(-1).alias("end2"), F.lit(-1).alias("end1"),
        F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).cast("long").alias("n"),
    )

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["minus_end"], -d["minus_priority"]
        furthest = F.when(p == 3, acc["end3"]).when(p == 2, F.greatest(acc["end3"], acc["end2"])).otherwise(F.greatest(acc["end3"], acc["end2"], acc["end1"]))
        free = furthest < end
        return F.struct(
            F.when(p == 3, F.greatest(acc["end3"], end)).otherwise(acc["end3"]).alias("end3"),
            F.when(p == 2, F.greatest(acc["end2"], end)).otherwise(acc["end2"]).alias("end2"),
            F.when(p == 1, F.greatest(acc["end1"], end)).otherwise(acc["end1"]).alias("end1"),
            F.when(free & ~F.array_contains(acc["labels"], d["label"]), F.concat(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(free, F.greatest(acc["best"], p)).otherwise(acc["best"]).alias("best"),
            (acc["n"] + free.cast("long")).alias("n"),
        )

    return F.aggregate(found, start, step)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id, n_words, detections, labels and score.

    detections: every match of every rule as (start, end, label, priority, rank, base), words from 0, by start.
    labels: labels of the detections that no other suppresses, and of base rules; sorted.
    score: 1.0, 0.8 or 0.4 for the strongest unsuppressed detection's priority, 0.0 without one.

    A null or empty text has no words, no detections and score 0. Repeated rows each give a row; an empty
    table gives none. Columns other than id and text are not read. A text is scanned whole, however long.
    """
    gate = F.col("spaced").rlike(f"(?i) (?:{ANCHORS}) ")
    worded = docs.select(F.col(id_column).alias("id"), F.regexp_replace(text_of(text_column), SEPARATORS, " ").alias("joined"))
    worded = worded.select("id", F.concat(F.lit(" "), F.trim("joined"), F.lit(" ")).alias("spaced"))
    gated = worded.select(
        "id",
        F.when(F.col("spaced") == "  ", 0).otherwise(_spaces(F.col("spaced")) - 1).cast("long").alias("n_words"),
        F.when(gate, F.translate("spaced", UPPER, LOWER)).alias("low"),
    )
    low = F.col("low")
    ruled = F.when(low.isNotNull(), _rule_array(rules or all_rules())).otherwise(F.array().cast("array<struct<rank:int,label:string,keyword:string,regex:string,priority:int,base:boolean>>"))
    hits = F.transform(
        F.filter(ruled, lambda r: F.contains(low, r["keyword"])),
        lambda r: F.struct(r["rank"].alias("rank"), r["label"].alias("label"), r["regex"].alias("regex"), r["priority"].alias("priority"), r["base"].alias("base"), F.regexp_extract_all(low, r["regex"], F.lit(0)).alias("found")),
    )
    found = gated.select("id", "n_words", low, F.filter(hits, lambda h: F.size(h["found"]) > 0).alias("hits"))
    placed = found.select("id", "n_words", F.array_sort(F.flatten(F.transform("hits", lambda h: _places(low, h)))).alias("found"))
    swept = placed.select("id", "n_words", "found", _unsuppressed(F.col("found")).alias("kept"))
    return swept.select(
        F.col("id").alias(id_column),
        "n_words",
        F.transform(
            "found",
            lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"), d["rank"].alias("rank"), d["base"].alias("base")),
        ).alias("detections"),
        F.array_sort(F.array_union(F.col("kept.labels"), F.transform(F.filter("found", lambda d: d["base"]), lambda d: d["label"]))).alias("labels"),
        F.col("kept.n").alias("n_unsuppressed"),
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair]), F.col("kept.best")), F.lit(0.0)).cast(T.DoubleType()).alias("score"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The scan's contract row per document: counts and extremes of base detections, joined labels, score."""
    scanned = scan_licenses(docs).withColumn("base", F.filter("detections", lambda d: d["base"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("detections").cast("long").alias("n_detections"),
        "n_unsuppressed",
    )
