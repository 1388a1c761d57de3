"""Amounts in the words of a text: a number and a unit of a table, as two words or one, with what stands under a stroke."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    """The parts between blanks, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_number(word: Column) -> Column:
    return word.try_cast("double").isNotNull() & (F.translate(word, "0123456789.", "") == "") & ~word.startswith(".") & ~word.endswith(".")


def _named(word: Column, units: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.lower(word))


def table(units: Iterable[str]) -> dict[str, str]:
    """Units that are called what they are, in capitals."""
    return {u.lower(): u.upper() for u in units}


def _number_before(word: Column) -> Column:
    """How many characters of the word are its leading number."""
    return F.length(word) - F.length(F.ltrim(word, F.lit("0123456789.")))


def unit_of(word: Column, units: dict[str, str], under: dict[str, str] | None = None) -> Column:
    """(unit, per_value, per_unit) of a word such as `mg`, `mg/mL` or `mg/5mL`; null if a unit isn't in its table. Of `per_value` there is none without a number."""
    def of(parts: Column) -> Column:
        below = F.get(parts, F.lit(1))
        digits = _number_before(below)
        per = _named(F.substring(below, digits + 1, F.length(below)), under or units)
        both = F.struct(_named(parts[0], units).alias("unit"), F.when(digits > 0, F.substring(below, F.lit(1), digits)).alias("per_value"), per.alias("per_unit"))
        return let(both, lambda u: F.when(u["unit"].isNotNull() & (below.isNull() | u["per_unit"].isNotNull()) & (F.size(parts) <= 2), u))

    return let(F.split(word, "/"), of)


def amounts(words: Column, units: dict[str, str], under: dict[str, str] | None = None) -> Column:
    """The amounts in order: at (from 0), width (words), value, u (of `unit_of`)."""

    def here(word: Column, i: Column) -> Column:
        following = F.get(words, i + 1)
        digits = _number_before(word)
        number, rest = F.substring(word, F.lit(1), digits), F.substring(word, digits + 1, F.length(word))
        found = lambda width, u: let(u, lambda x: F.when(x.isNotNull(), F.struct(i.alias("at"), F.lit(width).alias("width"), number.alias("value"), x.alias("u"))))
        return F.when((digits > 0) & is_number(number), F.when(rest != "", found(1, unit_of(rest, units, under))).otherwise(found(2, unit_of(following, units, under))))

    return F.filter(F.transform(words, here), lambda a: a.isNotNull())


def before(words: Column, amount: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), F.greatest(amount["at"], F.lit(0))), " ")


def after(words: Column, amount: Column) -> Column:
    return F.array_join(F.slice(words, amount["at"] + amount["width"] + 1, F.greatest(F.size(words), F.lit(1))), " ")
