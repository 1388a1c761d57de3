"""Synchronised products, repairs, publishing of several tables, and likeness of pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galenic.functions import geometry as G
from galenic.operators import sync as S
from galenic.sources import versions as W

RECORDS = f"product_ndc string, generic string, brand string, dosage_form string, route array<string>, labeler_name string, ingredients {S.INGREDIENTS}"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("1-1", "vancomycin 5 MG Oral Tablet", "V", None, None, "Acme Inc.", None),
        ("1-2", "heparin", "H", "INJECTION", ["IV"], "Acme LLC", [("heparin ", "5", "U"), (" ", "1", "g"), (None, None, None)]),
        ("1-3", "vancomycin 5 MG Kit", "K", "Kit", None, None, [("vancomycin", "5", "MG")]),
        ("2-4", None, None, " ", [], None, []),
        ("2-5", "a", "B", "GEL", None, "Z", None),
        ("2-5", "b", "A", "TABLET", None, "Z", None),
    ]
    return spark.createDataFrame(rows, RECORDS)


def test_records_and_what_their_names_say(records):
    got = {r.product_ndc: r for r in S.synchronised(records).collect()}
    one = got["1-1"]
    assert (one.dosage_form, one.route, one.from_name, one.labeler) == ("Oral Tablet", ["ORAL"], "ingredients,dosage_form,route", "Acme")
    assert [tuple(i) for i in one.ingredients] == [("vancomycin", "5", "MG")]
    assert [tuple(i) for i in got["1-2"].ingredients] == [("heparin", "5", "U")] and got["1-2"].route == ["IV"] and got["1-2"].from_name == ""
    assert got["1-3"].is_kit and got["1-3"].ingredients == [] and got["1-3"].from_name == ""
    assert (got["2-4"].dosage_form, got["2-4"].route, got["2-4"].ingredients) == (None, [], [])
    assert got["2-5"].generic == "a" and len(got) == 5
    assert S.synchronised(records.limit(0)).count() == 0


def test_repair_by_json_then_by_record(spark, records):
    products = spark.createDataFrame(
        [("1-1", None, "[]"), ("1-2", "INJECTION", '[{"ingredient": "heparin", "strength": "1"}]'), ("1-3", "KIT", None), ("2-4", None, "not json"), ("9-9", None, '[{"name": " "}]'), ("8-8", "GEL", None)],
        "product_ndc string, dosage_form string, active_ingredients string",
    )
    have = spark.createDataFrame([("8-8",)], "product_ndc string")
    got = {r.product_ndc: (r.source, [tuple(i) for i in r.ingredients]) for r in S.repaired_ingredients(products, have, records).collect()}
    assert got == {"1-1": ("record", [("vancomycin", "5", "MG")]), "1-2": ("json", [("heparin", "1", "")]), "2-4": (None, []), "9-9": (None, [])}


def test_a_failure_between_tables_leaves_the_old_version(spark, records, tmp_path):
    folder = str(tmp_path / "published")
    assert W.current(spark, folder) == {}
    first = S.entity_tables(S.synchronised(records))
    assert W.publish(spark, folder, first, "v1") == {"products": (0, 5), "labelers": (0, 2), "ingredients": (0, 2)}
    reader = W.read_table(spark, folder, "products")

    broken = {"products": first["products"].limit(2), "labelers": first["labelers"].withColumn("name", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception, match="lost"):
        W.publish(spark, folder, broken, "v2")
    assert {v for v, _, _ in W.current(spark, folder).values()} == {"v1"} and W.read_table(spark, folder, "products").count() == 5

    fine = {"products": first["products"].limit(2), "labelers": first["labelers"].limit(1)}
    assert W.publish(spark, folder, fine, "v2") == {"products": (5, 2), "labelers": (2, 1)}
    assert W.publish(spark, folder, fine, "v2") == {"products": (2, 2), "labelers": (1, 1)}  # once more changes nothing
    assert len(W.manifests(spark, folder)) == 2 and W.read_table(spark, folder, "ingredients").count() == 2 and reader.count() == 5
    with pytest.raises(KeyError):
        W.read_table(spark, folder, "nothing")


def test_an_unfinished_manifest_does_not_count(spark, records, tmp_path):
    folder = str(tmp_path / "published")
    W.publish(spark, folder, {"t": records.select("product_ndc")}, "v1")
    (tmp_path / "published" / "manifests" / "000000001").mkdir()
    assert len(W.manifests(spark, folder)) == 1
    W.publish(spark, folder, {"t": records.select("product_ndc").limit(1)}, "v2")
    assert W.read_table(spark, folder, "t").count() == 1


def plain_matches(a, b, limit):
    if not a or not b:
        return 0.0
    d = np.array([[bin((x ^ y) & (1 << 64) - 1).count("1") for y in b] for x in a])
    return sum(d[:, d[i].argmin()].argmin() == i and d[i].min() < limit for i in range(len(a))) / min(len(a), len(b))


def test_likeness_of_pictures(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 9, 8).astype(float).tolist(), rng.integers(0, 9, 8).astype(float).tolist(), [int(x) for x in rng.integers(0, 1 << 8, rng.integers(0, 6))], [int(x) for x in rng.integers(0, 1 << 8, rng.integers(0, 6))]) for _ in range(60)]
    rows += [([1.0, 1.0], [2.0, 2.0], None, [1]), ([], [1.0], [1], None), (None, None, [], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, d array<long>, e array<long>")
    got = df.select(G.correlation_likeness(F.col("a"), F.col("b")).alias("h"), G.mutual_matches(F.col("d"), F.col("e"), 3).alias("m")).collect()
    for (a, b, d, e), r in zip(rows[:60], got, strict=False):
        assert r.h == pytest.approx((np.corrcoef(a, b)[0, 1] + 1) / 2)
        assert r.m == pytest.approx(plain_matches(d, e, 3))
    assert [(r.h, r.m) for r in got[60:]] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
