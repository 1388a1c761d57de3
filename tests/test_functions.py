"""Scalar expressions by example."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from galenic.functions import geometry as G, label as L, ndc as N, rxname as R, text as X, units as U


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(x,) for x in inputs], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y")).collect()]


def test_ndc_variants(spark):
    got = values(spark, N.variants, ["1234567890", "01234-5678-90", "12345678901", "00123456789", "12345678", "123456789", "abc"])
    assert got == [
        ["1234-5678-90", "12345-678-90", "12345-6789-0"],
        ["01234-5678-90", "1234-5678-90"],
        ["12345-6789-1"],
        ["0123-4567-89"],
        ["12345-678", "1234-5678"],
        ["12345-6789"],
        None,
    ]


def test_lookup_candidates(spark):
    assert values(spark, N.lookup_candidates, ["1-2-3", "12345678901", "1234567890", "12345-678"]) == [["1-2"], ["12345-6789"], ["1234-5678", "12345-678", "12345-6789"], []]
    assert values(spark, N.product_candidates, ["12345-678", "1234567"]) == [["12345-678"], ["1234-567"]]


def test_labeler_codes(spark):
    assert values(spark, N.labeler_code, ["0123-45", "12345678", "1234", "12"]) == ["0123", "12345", "1234", None]
    assert values(spark, N.canonical_labeler, ["0012", "000"]) == ["12", "0"]
    assert values(spark, N.padded_labeler, ["12", "123456"]) == ["00012", "12345"]


def test_misread_digits_and_lots(spark):
    assert values(spark, X.digits_repaired, ["OoQDIl|"]) == ["0000111"]
    assert values(spark, X.digits_repaired_widely, ["SBZ"]) == ["582"]
    assert values(spark, X.lot_repaired, ["1O23", "AO12", "OO1"]) == ["1023", "AO12", "OO1"]


@pytest.mark.parametrize("name, cleaned", [("Acme Pharmaceuticals, Inc.", "Acme"), ("Zed (US) Corp.", "Zed"), ("Inc", "Inc"), ("Foo Div Holdings Inc", "Foo")])
def test_labeler_names(spark, name, cleaned):
    assert values(spark, X.clean_labeler, [name]) == [cleaned]


def test_one_more_suffix_pass_changes_nothing(spark):
    names = ["A Co Inc LLC Ltd", "B Pharma USA", "C Laboratories, LLC."]
    once = values(spark, X.clean_labeler, names)
    assert values(spark, X.clean_labeler, once) == once


def test_trailing_zeros_of_integers_go_as_well(spark):
    assert values(spark, X.strength_number, ["100", "10", "1", "2.50", "3.0"]) == ["1", "1", "1", "2.5", "3"]


def test_search_takes_signs_as_they_are(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "t string")
    assert df.where(X.contains_any_case(["t"], "0%")).count() == 1
    assert df.where(X.contains_any_case(["t"], "  ")).count() == 3


def test_ndc_on_labels(spark):
    got = values(spark, L.ndc, ["NDC 12345-678-90", "12345-678-90 x", "NDC 1234567890", "NDC 12345678901", "1234567890", "NDC I2345-678-9O", "no"])
    assert [tuple(x) if x else None for x in got] == [("12345-678-90", 0.95), ("12345-678-90", 0.70), ("12345-678-90", 0.85), ("12345-6789-01", 0.85), None, ("12345-678-90", 0.95), None]


def test_lot_on_labels(spark):
    got = values(spark, L.lot, ["LOT A1234", "BN: 77O1", "ABC123 x", "1234567890", "HELLO", "lot"])
    assert [tuple(x) if x else None for x in got] == [("A1234", 0.95), ("7701", 0.95), ("ABC123", 0.35), ("1234567890", 0.40), None, None]


def test_months_with_letters_like_digits_are_not_found(spark):
    got = values(spark, L.exp, ["EXP 01/2026", "EXP JAN 2026", "EXP OCT 2026", "EXP NOV 2026", "EXP DEC 2026", "use by 2026-01-31"])
    assert [x[0] if x else None for x in got] == ["01/2026", "JAN 2026", None, None, None, "2026-01-31"]


def test_strengths(spark):
    got = values(spark, L.strength, ["500 mg", "10 mg/mL", "5 U x", "7 ug", "0.9% Sodium", "none"])
    assert [tuple(x) if x else None for x in got] == [("500 mg", 0.9), ("10 mg", 0.7), ("5 units", 0.9), ("7 mcg", 0.9), None, None]


def test_phrases(spark):
    assert [x[0] if x else None for x in values(spark, L.mdv, ["multi-dose vial", "Single use", "x"])] == ["MDV", "SDV", None]
    assert [x[0] if x else None for x in values(spark, L.instructions, ["Rx Only", "x"])] == ["Rx Only", None]


def test_gs1(spark):
    assert values(spark, L.gs1_lines, ["(01)00312345678906(17)261231(10)ABC123", "123"]) == [["NDC 03123-4567-89", "EXP 12/2026", "LOT ABC123"], ["BARCODE 123"]]


def test_packages(spark):
    got = values(spark, L.package_levels, ["10 mL in 1 VIAL (1-2-3) / 25 VIAL in 1 TRAY", "odd"])
    assert [tuple(x) for x in got[0]] == [(10.0, "mL", 1, "VIAL", "1-2-3"), (25.0, "VIAL", 1, "TRAY", None)] and got[1] is None


FORMS = ("Oral Tablet", "Extended Release Oral Tablet", "Injection", "Injectable Solution")


def test_names(spark):
    got = values(spark, lambda c: R.parsed(c, FORMS), ["24 HR metformin hydrochloride 500 MG Extended Release Oral Tablet [Glucophage]", "acetaminophen 325 MG / codeine 30 MG Oral Tablet", "heparin 100 UNT/ML Injectable Solution", "water"])
    assert (got[0].brand, got[0].qualifier, got[0].dose_form) == ("Glucophage", "24 HR", "Extended Release Oral Tablet")
    assert [tuple(c) for c in got[0].components] == [("metformin hydrochloride", "500", "MG", None, None)]
    assert [tuple(c)[:3] for c in got[1].components] == [("acetaminophen", "325", "MG"), ("codeine", "30", "MG")]
    assert [tuple(c) for c in got[2].components] == [("heparin", "100", "UNT", None, "ML")]
    assert [tuple(c) for c in got[3].components] == [("water", None, None, None, None)]


def test_packs_and_volumes(spark):
    got = values(spark, R.pack_components, ["{ 2 (a 5 MG) / 3 (b 7 MG) } Pack [Z]", "a"])
    assert [tuple(c) for c in got[0]] == [("2", "a 5 MG"), ("3", "b 7 MG")] and got[1] is None
    got = values(spark, R.quantified, ["10 ML drug 5 MG/ML Injection", "drug"])
    assert tuple(got[0]) == ("10", "ML", "drug 5 MG/ML Injection") and got[1] is None


def test_strict_names(spark):
    got = values(spark, R.strict_failure, ["a 5 MG / b 7 MG Tablet", "a", "a (b) 5 MG", "a 5 MG 7 MG", "a 5 MG x / b 7 MG"])
    assert got == [None, "no strength", "brackets", "several strengths", "text between segments"]


def convert(spark, value, unit, to, **factors):
    f = {k: F.lit(factors.get(k)).cast("double") for k in ("molar_mass", "valence", "potency", "density")}
    return spark.range(1).select(U.bridged(F.lit(value).cast("double"), F.lit(unit), F.lit(to), **f)).first()[0]


def test_chemistry_goldens(spark):
    kcl = {"molar_mass": 74.55, "valence": 1.0}
    assert convert(spark, 20, "mEq", "mmol", **kcl) == pytest.approx(20)
    assert convert(spark, 20, "mEq", "mg", **kcl) == pytest.approx(1491)
    assert convert(spark, 20, "mEq", "mg") is None
    assert convert(spark, 2, "mL", "g", density=1020.0) == pytest.approx(2.04)


@settings(max_examples=20, deadline=None)
@given(value=st.floats(1e-3, 1e6), pair=st.sampled_from([("mg", "kg"), ("mL", "L"), ("mEq", "Eq"), ("mg/mL", "g/L"), ("min", "day"), ("ug", "mcg")]))
def test_units_there_and_back(spark, value, pair):
    v, (a, b) = F.lit(value), map(F.lit, pair)
    a, b = F.lit(pair[0]), F.lit(pair[1])
    assert spark.range(1).select(U.converted(U.converted(v, a, b), b, a)).first()[0] == pytest.approx(value, rel=1e-12)


def test_units_of_other_dimensions(spark):
    assert spark.range(1).select(U.converted(F.lit(1.0), F.lit("mg"), F.lit("mL"))).first()[0] is None
    assert [tuple(x) for x in values(spark, U.parsed, ["1.5e-3 g/L", "x"])] == [(0.0015, "g/L"), (None, None)]


def test_boxes(spark):
    a, b = [F.lit(x) for x in (0, 0, 10, 10)], [F.lit(x) for x in (5, 0, 15, 10)]
    r = spark.range(1).select(G.iou(a, b), G.iou(b, a), G.iou(a, [F.lit(x) for x in (20, 0, 30, 10)])).first()
    assert r[0] == r[1] == pytest.approx(1 / 3) and r[2] == 0


def test_ocr_normalise_sees_the_end_of_a_text(spark, tmp_path):
    from galenic.plans.catalogue import QUERIES

    text = "Lorem  ipsum\t" * 20 + "LOT O1Ql|"
    spark.createDataFrame([(1, text), (2, text + "O"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["ocr_normalise"](spark, str(tmp_path)).collect()}
    folded, repaired = "lorem ipsum " * 20 + "lot o1ql|", text.translate(str.maketrans("OoQDIl|", "0000111"))
    assert (got[1].folded_md5, got[1].n_folded) == (hashlib.md5(folded.encode()).hexdigest(), len(folded))
    assert (got[1].repaired_md5, got[1].n_repaired, got[1].n) == (hashlib.md5(repaired.encode()).hexdigest(), len(repaired), len(folded))
    assert got[2].folded_md5 != got[1].folded_md5 and got[2].repaired_md5 != got[1].repaired_md5 and got[3].folded_md5 is None
