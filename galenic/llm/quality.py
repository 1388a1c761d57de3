"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, written

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which costs and rejections are estimated. It decides the order alone, never a verdict.
SAMPLE_ROWS = 400


class QualityRule(NamedTuple):
    """fails: true for a text to reject. It may use the columns that `measured` adds."""

    name: str
    fails: Column


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text and the base measures of each row, from built-in expressions over that row alone.

    n_repeat_words: windows of five words are compared by hash first; only a text in which two hashes
    agree compares the words themselves, by sorting. Both are linear or n log n in the text.
    """
    text = F.col("text")
    base = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    base = base.select("id", "text", F.trim(F.regexp_replace(text, WORD_BREAK, " ")).alias("joined"))
    base = base.select(
        "id", "text", "joined",
        F.when(F.col("joined") == "", F.array().cast("array<string>")).otherwise(F.split("joined", " ")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\n\u000b\u000c\r", "     "))) > 0).alias("lines"),
    )
    n = F.size("words")
    w = F.col("words")
    base = base.select(
        "id", "text", "words", "lines",
        n.cast("long").alias("n_words"),
        (F.length("joined") - F.greatest(n - 1, F.lit(0))).cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))).alias("hashes"),
    )
    kept = ["id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "words", "lines"]
    base = base.select(*kept, F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False)).alias("repeats"))
    windows = F.when(
        F.col("repeats"),
        F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, F.lit(5))).alias("window"), i.alias("at")))),
    )
    base = base.select(*kept, windows.alias("windows"))
    v, last = F.col("windows"), F.size("windows") - 1
    same = F.filter(
        F.transform(v, lambda x, i: F.when(((i > 0) & (F.get(v, i - 1)["window"] == x["window"])) | ((i < last) & (F.get(v, i + 1)["window"] == x["window"])), x["at"])),
        lambda at: at.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort(same),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, at: F.struct((at + 5).alias("end"), (acc["n"] + at + 5 - F.greatest(acc["end"], at)).alias("n")),
        lambda acc: acc["n"],
    )
    return base.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _share(part: Column, whole: Column, limit: float) -> Column:
    return F.coalesce(part > limit * whole, F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[QualityRule]:
    """Conservative rules for prose, none of them tied to a language: ordinary documents pass all. What base_failed rejects
    (few words, repeated words) is no rule again."""
    words, lines, n = F.col("words"), F.col("lines"), F.col("n_words")
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    return [
        QualityRule("symbols", _share(F.col("n_symbols"), n, 0.25)),
        QualityRule("duplicate_lines", _share(F.col("n_dup_lines"), F.size(lines), 0.3)),
        QualityRule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        QualityRule("few_letters", _share(F.lit(0.5) * F.col("word_chars"), F.length(letters), 1.0)),
        QualityRule("shouting", _share(F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")), F.length(letters), 0.7) & (n >= 10)),
        QualityRule("exclamations", _share(F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit(""))), n, 0.5)),
        QualityRule("ellipsis_lines", _share(F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")))), F.size(lines), 0.5)),
        QualityRule("bullet_lines", _share(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))), F.size(lines), 0.9)),
        QualityRule("one_word_over", _share(F.array_max(F.transform(words, lambda x: F.length(x))), F.lit(1000), 1.0)),
    ]


#: Times that a rule is evaluated on each row of the sample, so that its time stands out from a job's own, and the least time.
REPEATS = 50
LEAST_SECONDS = 0.002


def _seconds(df: DataFrame) -> tuple[float, int]:
    began = time.perf_counter()
    n = df.first()[0]
    return time.perf_counter() - began, n or 0


def ordered_rules(sample: DataFrame, rules: list[QualityRule]) -> list[tuple[QualityRule, float, float]]:
    """The rules with seconds and rejection rate on the sample (a bounded table of `measured` rows), most
    rejection per second first; ties keep the given order. A rule's seconds are those of evaluating it REPEATS times on
    every row, less those of going through as many rows without it. Timings vary from run to run and so may the order,
    but a document is kept exactly if no rule rejects it, whatever the order."""
    often = sample.coalesce(1).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    nothing = often.agg(F.sum(F.when(F.col("__again") > 0, 1)))
    rows = _seconds(nothing)[1]
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    own = min(_seconds(nothing)[0] for _ in range(3))
    out = []
    for rule in rules:
        took, rejected = _seconds(often.agg(F.sum(F.when(rule.fails & (F.col("__again") > 0), 1).otherwise(0))))
        out.append((rule, max(LEAST_SECONDS, took - own), rejected / rows))
    return sorted(out, key=lambda x: -x[2] / max(x[1], 1e-6))


def sampled(measures: DataFrame, n: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows of n, from a table of the shared folder: of those whose id and text hash below a limit that some twice as many
    are expected to meet, so that the rows in the one task that gathers them don't grow with n. Copies are drawn apart by their ids."""
    steps = 1 << 40
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(steps)) < F.lit(min(steps, steps * 2 * rows // max(1, n)))
    return written(measures.where(drawn).limit(rows), "quality-sample")


def quality_cascade(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[QualityRule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, the base measures, base_failed and kept.

    The cascade is one CASE expression, whose branches Spark evaluates in turn and only until one rejects.

    A null or empty text has 0 in all measures and fails. Repeated rows each give a row; an empty table
    gives none. Columns other than id and text are not read. Texts are measured whole. The result is a written table,
    so that a filter on it doesn't repeat the measures.
    """
    rules = default_rules() if rules is None else rules
    measures = measured(docs, id_column, text_column)
    order = [r for r, _, _ in ordered_rules(sampled(measures, docs.count(), sample_rows), rules)]
    verdict = F.when(base_failed(), F.lit(False))
    for rule in order:
        verdict = verdict.when(rule.fails, F.lit(False))
    judged = measures.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"),
    )
    return written(judged, "judged")
