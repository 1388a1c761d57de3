"""Drug codes as column expressions: variants, candidates and parts of NDCs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _cut(d: Column, *lengths: int) -> Column:
    parts, at = [], 1
    for n in lengths:
        parts.append(F.substring(d, at, n))
        at += n
    return F.concat_ws("-", *parts)


def _ordered(*options: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*options)))


def variants(ndc: Column) -> Column:
    """Hyphenated forms under which a package or product code may be listed, best first: the code itself if it has
    hyphens, then by its digits 10 (4-4-2, 5-3-2, 5-4-1), 11 (one leading zero dropped from each segment that has one;
    5-4-2 if none does and the code has no hyphens), 8 (5-3, 4-4) or 9 (5-4). Null without digits."""
    d = digits(ndc)
    n = F.length(d)
    own = F.when(F.contains(ndc, F.lit("-")), F.trim(ndc))
    a, b, c = F.substring(d, 1, 5), F.substring(d, 6, 4), F.substring(d, 10, 2)
    zero = [F.startswith(x, F.lit("0")) for x in (a, b, c)]
    dropped = [
        F.when(zero[0], F.concat_ws("-", F.substring(d, 2, 4), b, c)),
        F.when(zero[1], F.concat_ws("-", a, F.substring(d, 7, 3), c)),
        F.when(zero[2], F.concat_ws("-", a, b, F.substring(d, 11, 1))),
        F.when(~zero[0] & ~zero[1] & ~zero[2] & own.isNull(), F.concat_ws("-", a, b, c)),
    ]
    return (
        F.when(n == 0, F.lit(None).cast("array<string>"))
        .when(n == 10, _ordered(own, _cut(d, 4, 4, 2), _cut(d, 5, 3, 2), _cut(d, 5, 4, 1)))
        .when(n == 11, _ordered(own, *dropped))
        .when(n == 8, _ordered(own, _cut(d, 5, 3), _cut(d, 4, 4)))
        .when(n == 9, _ordered(own, _cut(d, 5, 4)))
        .otherwise(_ordered(own))
    )


def product_candidates(ndc: Column) -> Column:
    """Product codes that a code of any form may belong to, best first."""
    parts = F.split(F.trim(ndc), "-")
    d = digits(ndc)
    n = F.length(d)
    return (
        F.when(F.size(parts) == 2, _ordered(F.trim(ndc)))
        .when(F.size(parts) == 3, _ordered(F.concat_ws("-", parts[0], parts[1])))
        .when(n == 11, _ordered(_cut(d, 5, 4)))
        .when(n == 10, _ordered(_cut(d, 4, 4), _cut(d, 5, 3), _cut(d, 5, 4)))
        .when(n == 9, _ordered(_cut(d, 5, 4)))
        .when(n == 8, _ordered(_cut(d, 4, 4), _cut(d, 5, 3)))
        .when(n == 7, _ordered(_cut(d, 4, 3)))
        .otherwise(F.array().cast("array<string>"))
    )


def lookup_candidates(ndc: Column) -> Column:
    """Product keys to try for a printed package code: of three segments the first two; of 11 digits 5-4; of 10 digits
    4-4, 5-3 and 5-4. A code of two segments has none."""
    parts = F.split(F.trim(ndc), "-")
    d = digits(ndc)
    n = F.length(d)
    return (
        F.when(F.size(parts) == 3, _ordered(F.concat_ws("-", parts[0], parts[1])))
        .when(n == 11, _ordered(_cut(d, 5, 4)))
        .when(n == 10, _ordered(_cut(d, 4, 4), _cut(d, 5, 3), _cut(d, 5, 4)))
        .otherwise(F.array().cast("array<string>"))
    )


def labeler_code(ndc: Column) -> Column:
    """The first segment; without hyphens the first five digits, or four if there are only those."""
    d = digits(ndc)
    return F.when(F.contains(ndc, F.lit("-")), F.split(F.trim(ndc), "-")[0]).when(F.length(d) >= 5, F.substring(d, 1, 5)).when(F.length(d) == 4, d)


def canonical_labeler(code: Column) -> Column:
    """Without leading zeros, `0` if nothing is left."""
    stripped = F.regexp_replace(code, "^0+", "")
    return F.when(stripped == "", "0").otherwise(stripped)


def padded_labeler(code: Column) -> Column:
    """Five digits: padded with zeros on the left, cut on the right."""
    d = digits(code)
    return F.when(F.length(d) > 5, F.substring(d, 1, 5)).otherwise(F.lpad(d, 5, "0"))


def is_valid(ndc: Column) -> Column:
    """4-4-2, 5-3-2, 5-4-1, 5-4-2, or 10 or 11 digits."""
    return ndc.rlike(r"^(?:[0-9]{4}-[0-9]{4}-[0-9]{2}|[0-9]{5}-[0-9]{3}-[0-9]{2}|[0-9]{5}-[0-9]{4}-[0-9]{1,2}|[0-9]{10,11})$")


def package_ndc(product: Column, package: Column) -> Column:
    return F.concat_ws("-", product, package)
