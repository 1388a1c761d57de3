"""Text normalisation and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Corporate suffixes that a labeler's name may end in.
CORPORATE_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "lp", "llp", "plc", "usa", "us", "pharmaceuticals", "pharmaceutical", "pharma", "laboratories", "labs", "holdings", "div")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    """Lower case, no brackets, dashes as blanks, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\[\](){}]", " "), r"[-_/]", " "))


def digits_repaired(c: Column) -> Column:
    """Letters that are misread digits: O, o, Q, D as 0; I, l and the bar as 1."""
    return F.translate(c, "OoQDIl|", "0000111")


def digits_repaired_widely(c: Column) -> Column:
    """As digits_repaired, and S as 5, B as 8, Z as 2."""
    return F.translate(digits_repaired(c), "SBZ", "582")


def lot_repaired(c: Column) -> Column:
    """Repairs a lot code only if it has no other letters and at least as many digits as doubtful letters."""
    doubtful = F.length(F.regexp_replace(c, "[^OoQDIl|]", ""))
    certain = F.length(F.regexp_replace(c, "[^0-9]", ""))
    other = F.length(F.regexp_replace(c, "[^A-Za-z|]", "")) - doubtful
    return F.when((doubtful > 0) & (other == 0) & (certain >= doubtful), digits_repaired(c)).otherwise(c)


def clean_labeler(c: Column) -> Column:
    """Without parentheses and trailing corporate suffixes; never empty."""
    suffixes = r"(?i)(?:[\s,.]+(?:" + "|".join(CORPORATE_SUFFIXES) + r")(?![^\s,.]))+[\s,.]*$"
    out = squeeze(F.regexp_replace(c, r"\([^)]*\)", " "))
    out = F.regexp_replace(F.regexp_replace(out, suffixes, ""), r"[\s,.;]+$", "")
    return F.when(out == "", squeeze(c)).otherwise(out)


def tokens(c: Column, stopwords: tuple[str, ...] = ("the", "and", "for", "of")) -> Column:
    """Distinct lower-case words of letters and digits, longer than one, without stopwords; sorted."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def strength_number(c: Column) -> Column:
    """A number without trailing zeros and point; of an integer the zeros go as well, so that 100, 10 and 1 are alike."""
    return F.regexp_replace(F.regexp_replace(c, r"0+$", ""), r"\.$", "")


def mg_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"([0-9.]+)\s*MG"), F.lit(1)), strength_number)


def short(c: Column, limit: int = 46) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def descriptive(brand: Column, generic: Column) -> Column:
    """A brand name that merely describes: it and the generic name contain one another."""
    b, g = normal(brand), normal(generic)
    return F.contains(b, g) | F.contains(g, b)


def lucene_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r'([\\+\-&|!(){}\[\]^"~*?:/])', r"\\$1")


def contains_any_case(columns: list[str], text: str) -> Column:
    """True where one of the columns contains the text, whatever the case; a blank text matches all."""
    if not text.strip():
        return F.lit(True)
    pattern = text.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return out


def flag(text: str | None) -> bool | None:
    """A yes-or-no parameter; anything else counts as not given."""
    low = (text or "").strip().lower()
    return True if low in ("1", "true", "yes", "on") else False if low in ("0", "false", "no", "off") else None
