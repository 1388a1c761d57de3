"""Steps whose work once grew faster than their input: each row is read, moved or looked up once."""

import pytest
from pyspark.sql import functions as F

from galenic.functions import label as L
from galenic.operators import lookup as K, matching as M
from galenic.plans.catalogue import QUERIES


def test_lot_splits_a_line_once(spark):
    df = spark.createDataFrame([("LOT A1234O",), ("lot: 12345O",), ("EXP 03/2026 B123456",), ("BATCHES",), ("1234567890",), ("LOT",), ("",), (None,)], "t string").repartition(1)
    got = df.select(L.lot(F.col("t")).alias("f"))
    assert [r.f and tuple(r.f) for r in got.collect()] == [("A1234O", 0.95), ("123450", 0.95), ("B123456", 0.35), None, ("1234567890", 0.40), None, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_counts_of_a_lookup_are_those_of_its_entries(spark):
    kinds = [("vancomycin", "Vanco", "VIAL"), ("vancomycin", None, "VIAL"), ("zinc and iron", "Zin", "TABLET")]
    entries = spark.createDataFrame([(10 * i + k, g, b, None, f, g.split(" and ")) for k, (g, b, f) in enumerate(kinds) for i in range(5)] + [(3, "Vancomycin", "VANCO", None, "VIAL", ["vancomycin"])], "entry long, generic string, brand string, route string, dosage_form string, ingredients array<string>")
    values = "('a', 'vancomycin', NULL), ('b', NULL, 'vanco'), ('c', 'iron and zinc', NULL), ('d', 'vanco', NULL), ('e', 'nothing', NULL)"
    asked = spark.sql(f"SELECT q.*, CAST(NULL AS string) AS route, CAST(NULL AS string) AS dosage_form, CAST(NULL AS array<string>) AS ingredients FROM VALUES {values} AS q(question, generic, brand)")
    each = K.lookup_names(asked, entries).groupBy("question").agg(F.min("matched_via"), F.count(F.lit(1)), F.count_if(F.col("rank") == 0), F.min(F.struct("rank", "entry"))["entry"])
    counts = K.lookup_counts(asked, entries).select("question", "matched_via", "n", "n_exact", "best")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, each.collect())) != []


def test_found_components_of_odd_orders(spark):
    expected = spark.createDataFrame([(1, 1, "p", "p-1", "x", "e"), (1, 2, "p", "p-2", "y", None), (1, 3, "q", None, "z", "e"), (None, 1, "p", "p-1", "x", "e"), (1, None, "p", "p-1", "x", "e"), (2, 1, "p", "p-1", "x", "e")], "order_id long, pos int, product_ndc string, package_ndc string, lot string, exp string")
    found = spark.createDataFrame([(1, 5, "p", "w", "e"), (1, 4, "p-2", None, "e"), (1, 6, "p-1", "x", "e"), (1, 7, None, "z", "e"), (None, 1, "p", "x", "e"), (3, 1, "p", "x", "e")], "order_id long, pos int, ndc string, lot string, exp string")
    got = {(r.order_id, r.pos): (r.found, r.lot_match, r.exp_match, r.discrepant) for r in M.verified(expected, found).collect()}
    none = (False, None, None, True)
    assert got == {(1, 1): (True, False, True, True), (1, 2): (True, None, None, False), (1, 3): none, (None, 1): none, (1, None): none, (2, 1): none}


@pytest.mark.parametrize("name", ["order_verification", "order_run"])
def test_components_of_orders_are_made_and_moved_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(order_id") <= 1
