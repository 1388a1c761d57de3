"""Units and amounts: conversion, and bridges between mass, volume, substance, charge and activity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Dimension and scale of each unit symbol; aliases stand for a symbol.
UNITS = {
    "g": ("mass", 1.0), "mg": ("mass", 1e-3), "mcg": ("mass", 1e-6), "ng": ("mass", 1e-9), "kg": ("mass", 1e3),
    "L": ("volume", 1.0), "mL": ("volume", 1e-3),
    "mol": ("substance", 1.0), "mmol": ("substance", 1e-3),
    "Eq": ("charge", 1.0), "mEq": ("charge", 1e-3),
    "s": ("time", 1.0), "min": ("time", 60.0), "hr": ("time", 3600.0), "day": ("time", 86400.0),
    "each": ("count", 1.0), "units": ("activity", 1.0), "%": ("1", 0.01), "": ("1", 1.0),
}
ALIASES = {"ug": "mcg", "µg": "mcg", "l": "L", "ml": "mL", "ML": "mL", "cc": "mL", "sec": "s", "h": "hr", "hour": "hr", "ea": "each", "unit_count": "each", "u": "units", "U": "units", "unit": "units", "1": ""}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


_SCALES = {k: s for k, (_, s) in UNITS.items()} | {a: UNITS[k][1] for a, k in ALIASES.items()}
_DIMENSIONS = {k: d for k, (d, _) in UNITS.items()} | {a: UNITS[k][0] for a, k in ALIASES.items()}


def scale(unit: Column) -> Column:
    """Of a unit or a ratio of two, to its base; null if unknown."""
    p = F.split(unit, "/")
    one = F.try_element_at(_map(_SCALES), p[0])
    return F.when(F.size(p) == 1, one).when(F.size(p) == 2, one / F.try_element_at(_map(_SCALES), F.get(p, F.lit(1))))


def dimension(unit: Column) -> Column:
    p = F.split(unit, "/")
    one = F.try_element_at(_map(_DIMENSIONS), p[0])
    two = F.try_element_at(_map(_DIMENSIONS), F.get(p, F.lit(1)))
    return F.when(F.size(p) == 1, one).when(F.size(p) == 2, F.when(one == two, "1").otherwise(F.concat(one, F.lit("/"), two)))


def converted(value: Column, unit: Column, to: Column) -> Column:
    """Null where a unit is unknown or the dimensions differ."""
    return F.when(dimension(unit) == dimension(to), value * scale(unit) / scale(to))


def parsed(c: Column) -> Column:
    """(value, unit) of a text such as `20 mEq` or `1.5e-3 g/L`."""
    found = r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(\S*)\s*$"
    number = F.regexp_extract(c, found, 1)
    return F.struct(F.when(number != "", number.try_cast("double")).alias("value"), F.when(number != "", F.regexp_extract(c, found, 2)).alias("unit"))


def bridged(value: Column, unit: Column, to: Column, molar_mass: Column, valence: Column, potency: Column, density: Column) -> Column:
    """An amount of a substance in another unit, by way of grams and moles: molar mass in g/mol, valence in Eq/mol,
    potency in units/g, density in g/L. Null where a factor on the way is missing."""
    base = value * scale(unit)
    frm, into = dimension(unit), dimension(to)
    z = F.abs(valence)
    moles = F.when(frm == "substance", base).when(frm == "charge", base / z)
    grams = F.when(frm == "mass", base).when(frm == "volume", base * density).when(frm == "activity", base / potency).otherwise(moles * molar_mass)
    of_moles = F.coalesce(moles, grams / molar_mass)
    out = (
        F.when(frm == into, base)
        .when(into == "mass", grams)
        .when(into == "volume", grams / density)
        .when(into == "activity", grams * potency)
        .when(into == "substance", of_moles)
        .when(into == "charge", of_moles * z)
    )
    return out / scale(to)


def base_value(value: Column, unit: Column) -> Column:
    return value * scale(unit)


def base_key(value: Column, unit: Column) -> Column:
    """Equal amounts in whatever units have one key: dimension and base value to twelve places."""
    return F.struct(dimension(unit).alias("dimension"), F.round(base_value(value, unit), 12).alias("value"))


def added(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """The sum in the left unit; null for different dimensions."""
    return value + converted(other, other_unit, unit)


def subtracted(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    return value - converted(other, other_unit, unit)


def multiplied(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """(value, unit) of a product, whose unit is both."""
    return F.struct((value * other).alias("value"), F.concat(unit, F.lit("·"), other_unit).alias("unit"))


def divided(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """(value, unit) of a ratio; null for a zero divisor."""
    return F.struct(F.try_divide(value, other).alias("value"), F.concat(unit, F.lit("/"), other_unit).alias("unit"))


#: Amounts on base values that differ less are equal.
TOLERANCE = 1e-12


def equal(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """Null for different dimensions, as for `less`."""
    return F.when(dimension(unit) == dimension(other_unit), same(base_value(value, unit), base_value(other, other_unit)))


def less(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    return F.when(dimension(unit) == dimension(other_unit), base_value(value, unit) < base_value(other, other_unit))


def final_concentration(strength: Column, final_volume: Column, diluent_volume: Column) -> Column:
    """Strength over final volume; where only the diluent's volume is known, strength over their ratio, as the rule is written."""
    return F.when(final_volume.isNotNull(), strength / final_volume).when(diluent_volume.isNotNull(), strength / (strength / diluent_volume))


def same(a: Column, b: Column) -> Column:
    return F.abs(a - b) < TOLERANCE
