"""Search by name and code, names and fields in label text, salvage, box suppression, dead letters."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from galenic.operators import directory as D, graph as G, lookup as K, markup as M, salvage as S, suppress as B
from galenic.views import packages, products

ENTRIES = "entry long, generic string, brand string, route string, dosage_form string, ingredients array<string>"
QUESTIONS = "question string, generic string, brand string, route string, dosage_form string, ingredients array<string>"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        (1, "Heparin Sodium", "Heparin", "INTRAVENOUS", "INJECTION, SOLUTION", ["heparin sodium"]),
        (2, "heparin sodium and dextrose", "Hep-D", "INTRAVENOUS", "INJECTION", ["heparin sodium", "dextrose"]),
        (3, "piperacillin/tazobactam", "Zosyn", "INTRAVENOUS", "INJECTION", ["piperacillin sodium", "tazobactam sodium"]),
        (4, "water", None, None, "INJECTION", None),
        (5, "loratadine", "Zosyn", "ORAL", "TABLET", ["loratadine"]),
        (6, None, None, None, None, None),
        (7, "Heparin Sodium", "Heparin", "INTRAVENOUS", "INJECTION, SOLUTION", ["heparin sodium"]),
    ]
    return spark.createDataFrame(rows, ENTRIES)


def ask(spark, *rows, **more):
    return spark.createDataFrame([(q, g, b, r, f, i) for q, g, b, r, f, i in rows], QUESTIONS)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.question, (r.matched_via, {}))[1][r.entry] = r.rank
    return out


def test_tiers_in_order(spark, entries):
    asked = ask(
        spark,
        ("exact", "heparin sodium", None, None, None, None),
        ("part of a word", "hepar", None, None, None, None),
        ("with form", "Heparin  sodium", None, None, "solution", None),
        ("split", "tazobactam and piperacillin", None, None, None, None),
        ("cut", "tazobac AND piperacillin sod", None, None, None, None),
        ("as brand", "hep-d", None, None, None, None),
        ("brand", None, "zosyn", None, None, None),
        ("brand, oral", None, "zosyn", "oral", None, None),
        ("no such brand", None, "nothing", None, None, None),
        ("cut brand", None, "piper and tazo", None, None, None),
        ("by ingredient", None, None, None, None, ["dextrose"]),
        ("nothing asked", " ", "", None, None, []),
        ("signs", "hepa.*", None, None, None, None),
    )
    got = found(K.lookup_names(asked, entries))
    assert got == {
        "exact": ("generic_name", {1: 0, 7: 0, 2: 1}),
        "with form": ("generic_name", {1: 2, 7: 2}),
        "split": ("generic_name_split", {3: 2}),
        "cut": ("generic_name_split_wildcard", {3: 2}),
        "as brand": ("generic_as_brand", {2: 2}),
        "brand": ("brand_name_narrowed", {3: 0}),
        "brand, oral": ("brand_name_narrowed", {5: 0}),
        "cut brand": ("brand_name_split_wildcard", {3: 2}),
        "by ingredient": ("other", {2: 2}),
    }


def test_most_ingredients_and_empty_tables(spark, entries):
    asked = ask(spark, ("exact", "heparin sodium", None, None, None, None))
    assert found(K.lookup_names(asked, entries, most_ingredients=1)) == {"exact": ("generic_name", {1: 0, 7: 0})}
    assert K.lookup_names(asked, entries.limit(0)).count() == 0
    assert K.lookup_names(asked.limit(0), entries).count() == 0


def test_later_tiers_ask_only_what_is_open(spark, entries, monkeypatch):
    asked, sizes = ask(spark, ("exact", "heparin sodium and dextrose", None, None, None, None), ("open", "nothing and dextrose", None, None, None, None)), []
    real = K.names_found
    monkeypatch.setattr(K, "names_found", lambda q, *a: (sizes.append({r.question for r in q.collect()}), real(q, *a))[1])
    K.lookup_names(asked, entries).collect()
    assert sizes[0] == {"exact", "open"} and all("exact" not in s for s in sizes[1:])


def test_packages_by_variants(spark):
    listed = spark.createDataFrame([(1, "0409-4887", "0409-4887-10"), (2, "0409-4888", None), (3, None, "12345-678-90")], "entry long, product_ndc string, package_ndc string")
    codes = spark.createDataFrame([("00409488710",), ("0409-4888",), ("0409488710",), ("x",), (None,), ("1234567890",)], "code string")
    got = {(r.code, r.entry, r.field) for r in K.lookup_packages(codes, listed).collect()}
    assert got == {("00409488710", 1, "package_ndc"), ("0409488710", 1, "package_ndc"), ("0409-4888", 2, "product_ndc"), ("1234567890", 3, "package_ndc")}


def test_texts_with_terms_inside_words(spark):
    texts = spark.createDataFrame([("acetaminophen/codeine",), ("code",), (None,), ("",)], "text string")
    terms = spark.createDataFrame([("acetaminophen",), ("codeine",), ("code",), ("ine",), ("phen/cod",)], "term string")
    assert {(r.text, r.term) for r in K.texts_with(texts, terms).collect()} == {("acetaminophen/codeine", t) for t in ("acetaminophen", "codeine", "code", "phen/cod")} | {("code", "code")}


def test_names_are_the_leftmost_then_longest(spark):
    names = spark.createDataFrame([("product", " sodium ", "Sodium"), ("product", " sodium chloride ", "Sodium Chloride"), ("product", " chloride ", "Chloride"), ("mfg", " acme ", "Acme")], "field string, phrase string, name string")
    lines = spark.createDataFrame([("ACME: sodium-chloride 0.9%",), ("chloride, sodium",), ("sodiumchloride",), (None,), (" ",)], "line string")
    got = {(r.line, r.field, r["name"]) for r in D.names_in(lines, names).collect()}
    assert got == {("ACME: sodium-chloride 0.9%", "product", "Sodium Chloride"), ("ACME: sodium-chloride 0.9%", "mfg", "Acme"), ("chloride, sodium", "product", "Chloride")}


def label(spark, *pools):
    return spark.createDataFrame([(1, p, n, t) for p, lines in enumerate(pools) for n, t in enumerate(lines)], "crop long, pool int, line_no int, text string")


@pytest.fixture(scope="module")
def listed(spark):
    rows = [("0009-0224", "ceftazidime and avibactam", "Avycaz", "Pfizer Laboratories LLC", "2.5 g"), ("0264-7800", "sodium chloride", "Sodium Chloride", "B. Braun Medical Inc.", "0.9 %")]
    return spark.createDataFrame(rows, "product_ndc string, generic string, brand string, labeler_name string, strength_text string"), spark.createDataFrame([("0009", "Pfizer Inc"), ("0264", "B. Braun Medical Inc."), ("0641", "Hikma Pharmaceuticals USA Inc.")], "code string, name string")


def fields(spark, listed, *pools):
    return {r.field: (r.value, r.confidence, r.source) for r in D.label_fields(label(spark, *pools), *listed).collect()}


def test_a_bare_code_fills_all_blanks(spark, listed):
    got = fields(spark, listed, ["NDC 0009-0224-20"])
    assert got == {"ndc": ("0009-0224-20", 0.95, "label"), "brand": ("Avycaz", 0.85, "directory"), "product": ("ceftazidime and avibactam", 0.85, "directory"), "mfg": ("Pfizer", 0.85, "directory"), "strength": ("2.5 g", 0.85, "directory")}


def test_what_is_printed_stays_and_descriptive_brands_are_left_out(spark, listed):
    got = fields(spark, listed, ["B BRAUN MEDICAL", "NDC 0264-7800-10", "LOT 2JD588", "10 mg"])
    assert got["strength"] == ("10 mg", 0.9, "label") and got["mfg"] == ("B. Braun Medical", 0.9, "label") and "brand" not in got and got["product"][2] == "directory"


def test_unlisted_codes_give_the_labeler_only(spark, listed):
    got = fields(spark, listed, ["NDC 0641-2440-45"])
    assert got["mfg"] == ("Hikma", 0.85, "labeler") and set(got) == {"ndc", "mfg"}


def test_an_untrusted_code_fills_nothing_but_the_labeler(spark, listed):
    """Read by one of two readings its confidence is half."""
    got = fields(spark, listed, ["NDC 0009-0224-20"], ["no code here"])
    assert got["ndc"][1] == 0.475 and got["mfg"] == ("Pfizer", 0.85, "labeler") and "product" not in got


def test_ties_go_to_the_first_reading_and_names_may_break(spark, listed):
    got = fields(spark, listed, ["LOT A1111", "sodium", "chloride"], ["LOT B2222", "AVYCAZ"], [" ", None])
    assert got["lot"][0] == "A1111" and got["product"][0] == "sodium chloride" and got["brand"] == ("Avycaz", 0.475, "label")


def test_salvage_takes_the_first_that_has_a_field(spark):
    rows = [(1, 0, "LOT AB12 B Braun", 90.0), (1, 1, "NDC 0264-78O0-10 LOT ZZ99 EXP 07/27", 50.0), (1, 2, "Heparin 5 mg / 2 mL", 50.0), (1, 3, "  ", 99.0), (1, 4, None, 99.0), (2, 0, None, 1.0)]
    rows += [(3, k, f"LOT L{k:03d} 250 mL", float(k)) for k in range(12)]
    readings = spark.createDataFrame(rows, "crop long, reading int, text string, score double")
    labelers = spark.createDataFrame([("00264", "Other Maker"), ("9", "B Braun Inc")], "code string, name string")
    got = {r.crop: r for r in S.salvaged(readings, labelers).collect()}
    one = got[1]
    assert (one.lot, one.ndc, one.expiration, one.product, one.strength, one.volume_ml) == ("AB12", "00264-7800-10", "07/27", "Heparin Sodium Injection", "5 mg/2 mL", "2")
    assert (one.manufacturer, one.manufacturer_source) == ("Other Maker", "ndc")  # though a better reading names another
    assert all(got[2][f] is None for f in ("lot", "ndc", "manufacturer"))
    assert got[3].lot == "L011" and S.ranked(readings).where("crop = 3").count() == S.BEST_READINGS


def plain_suppression(boxes, overlap, contained, larger):
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    kept = []
    for b in sorted(boxes, key=lambda b: (area(b), b[0])):
        for a in kept:
            shared = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
            if shared and (area(b) > larger * area(a) and shared / max(1, area(a)) >= contained or shared / (area(a) + area(b) - shared) >= overlap):
                break
        else:
            kept.append(b)
    return {b[0] for b in kept}


@pytest.mark.parametrize("overlap, contained, larger", [(0.10, 0.75, 1.5), (0.30, 0.85, 1.5), (0.5, 0.5, 3.0)])
def test_suppression_is_that_of_one_box_after_the_other(spark, overlap, contained, larger):
    rng = np.random.default_rng(6)
    rows = []
    for image in range(4):
        for k in range((3, 40, 120, 300)[image]):
            x, y = rng.integers(0, 900, 2)
            w, h = rng.integers(1, 260, 2) if k % 7 else (50, 50)
            rows.append((image, k, int(x), int(y), int(x + w), int(y + h)))
    rows.append((9, 0, 5, 5, 5, 5))  # without extent
    df = spark.createDataFrame(rows, "image long, id long, x1 long, y1 long, x2 long, y2 long")
    got = {}
    for r in B.suppressed(df, ["image"], "id", overlap, contained, larger).collect():
        got.setdefault(r.image, set()).add(r.id)
    for image in {r[0] for r in rows}:
        assert got[image] == plain_suppression([r[1:] for r in rows if r[0] == image], overlap, contained, larger)
    assert B.suppressed(df.limit(0), ["image"], "id").count() == 0


def test_gates_and_padding(spark):
    df = spark.createDataFrame([(1, 0, 0, 100, 100, 9000), (2, 0, 0, 30, 100, 3000), (3, 0, 0, 1000, 1000, 990000), (4, 5, 5, 60, 60, 10)], "id long, x1 int, y1 int, x2 int, y2 int, mask_area long")
    w = F.lit(1000)
    kept = B.gated(df, w, w, 0.004, 0.75, 40)
    assert [r.id for r in kept.collect()] == [1]
    assert [tuple(r)[1:5] for r in B.padded(kept, w, w, 10).collect()] == [(0, 0, 110, 110)]


def test_broken_labels_land_beside(spark, tmp_path):
    good = "<doc><section><code code='1'/><title>A</title><text>x</text><section><code code='2'/><text>y</text></section></section></doc>"
    rows = [("a", good), ("b", "<doc><section>"), ("c", None), ("d", " "), ("e", "<doc/>")]
    labels = spark.createDataFrame(rows, "setid string, xml string")
    assert {r.id for r in M.failed_documents(labels).collect()} == {"b", "c", "d"}
    assert [(r.path, r.title) for r in M.xml_sections(labels).orderBy("ordinal").collect()] == [("1", "A"), ("1/2", "A")]
    for _ in range(2):  # a second run replaces the first
        n = M.write_sections(labels, str(tmp_path / "out")).first()
        assert (n.documents, n.sections, n.failed) == (2, 2, 3)
    written = spark.read.text(str(tmp_path / "out" / "labels")).collect()
    assert {json.loads(r.value)["id"] for r in written} == {"a", "e"}
    assert {r.id for r in spark.read.json(str(tmp_path / "out" / "failed")).collect()} == {"b", "c", "d"}


def test_a_hub_of_many_leaves_is_only_counted(spark):
    edges = spark.createDataFrame([("hub", "r", f"leaf{k}") for k in range(50)] + [("few", "r", f"x{k}") for k in range(2)], "source string, rela string, target string")
    concepts = spark.createDataFrame([(f"leaf{k}", "IN") for k in range(50)] + [("x0", "IN"), ("x1", "IN")], "rxcui string, tty string")
    got = {r.center: (r.n, r.collapsed, r.members) for r in G.bundled(edges, concepts).collect()}
    assert got == {"hub": (50, True, None), "few": (2, False, "x0|x1")}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_product_codes_are_unique(spark, sf):
    p = products(spark, sf)
    assert p.count() == p.select("product_ndc").distinct().count()
    assert packages(spark, sf).groupBy("product_ndc", "package_code").count().where("count > 1").isEmpty()
