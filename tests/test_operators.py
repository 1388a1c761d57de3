"""Operators by scenario."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from galenic.operators import catalog as C, etl as E, graph as G, inference as I, labels as L, markup as D, matching as M
from galenic.streaming import events as S


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_the_best_one(n, m, seed):
    score = np.random.default_rng(seed).integers(0, 9, (n, m)) / 8
    pairs = M.best_assignment(score)
    assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    rows, columns = (range(n), range(m)) if n <= m else (range(m), range(n))
    s = score if n <= m else score.T
    assert sum(score[r, c] for r, c in pairs) == pytest.approx(max(sum(s[r, c] for r, c in zip(rows, p)) for p in itertools.permutations(columns, len(rows))))


def boxes(spark, rows):
    schema = "run long, image long, pos long, instance_id long, lot string, ndc string, exp string, v array<double>"
    return spark.createDataFrame(rows, schema)


def unit(k):
    return [1.0 if i == k else 0.0 for i in range(8)]


def statuses(spark, rows, force):
    return sorted(r.status for r in M.assigned(M.pair_scores(boxes(spark, rows)), force=force).collect())


def test_weak_pairs_are_rejected_unless_forced(spark):
    rows = [(1, 0, 0, 1, None, None, None, unit(0)), (1, 0, 1, 2, None, None, None, unit(1)), (1, 1, 0, 3, None, None, None, unit(2)), (1, 1, 1, 4, None, None, None, unit(3))]
    assert statuses(spark, rows, False) == ["out_of_inventory"] * 2
    assert statuses(spark, rows, True) == ["forced"] * 2


def test_more_boxes_than_slots(spark):
    rows = [(1, 0, 0, 1, None, None, None, unit(0))] + [(1, 1, i, 2 + i, None, None, None, unit(1 + i)) for i in range(3)]
    assert statuses(spark, rows, True) == ["excess", "excess", "forced"]


def test_strong_pairs_are_alike_in_both_modes(spark):
    rows = [(1, 0, i, 1 + i, f"L{i}", f"0000{i}-1-1", None, unit(i)) for i in range(2)] + [(1, 1, i, 11 + i, f"L{i}", f"0000{i}-1-1", None, unit(i)) for i in range(2)]
    for force in (False, True):
        got = M.assigned(M.pair_scores(boxes(spark, rows)), force=force).collect()
        assert {(r.sub_id, r.slot, r.status) for r in got} == {(11, 0, "assigned"), (12, 1, "assigned")}


def test_merging_takes_over_missing_fields(spark):
    schema = "run long, image long, pos long, instance_id long, class_label string, score double, x1 long, y1 long, x2 long, y2 long, lot string, ndc string, exp string, v array<double>"
    rows = [(1, 0, 0, 1, "vial", 0.9, 0, 0, 100, 100, None, None, None, None), (1, 0, 1, 2, "filter", 0.99, 2, 0, 100, 100, "L1", None, None, None), (1, 0, 2, 3, "vial", 0.5, 300, 0, 400, 100, None, None, None, None)]
    got = {r.instance_id: (r.lot, r.absorbed) for r in M.merged(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("L1", "2"), 3: (None, "")}


def test_siblings(spark):
    schema = "run long, image long, pos long, instance_id long, x1 long, y1 long, x2 long, y2 long, mask_area long, lot string, ndc string, exp string"
    rows = [(1, 0, 0, 1, 0, 0, 10, 20, 200, "L", "N", None), (1, 0, 1, 2, 0, 0, 10, 20, 190, None, None, None), (1, 0, 2, 3, 0, 0, 10, 20, 180, "M", None, None), (1, 0, 3, 4, 0, 0, 40, 80, 3200, None, None, None), (1, 1, 0, 5, 0, 0, 10, 20, 200, None, None, None)]
    got = {r.instance_id: (r.lot, r.ndc, r.filled) for r in M.siblings_filled(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("L", "N", ""), 2: ("L", "N", "lot,ndc"), 3: ("M", "N", "ndc"), 4: (None, None, ""), 5: (None, None, "")}


@pytest.mark.parametrize("confidence, wrong", [(0.95, 0), (0.713, 1), (0.475, 2), (0.238, 3)])
def test_votes_of_four_readings(spark, confidence, wrong):
    texts = ["LOT AB1234"] * (4 - wrong) + ["nothing"] * wrong
    lines = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)], "crop long, pool int, line_no int, text string")
    r = L.vote(lines, "lot").first()
    assert r.value == "AB1234" and r.confidence == pytest.approx(confidence, abs=0.0011)


def test_label_and_value_on_two_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, "LOT"), (1, 0, 1, "AB1234")], "crop long, pool int, line_no int, text string")
    assert L.vote(lines, "lot").first().confidence == 0.95


def test_lots(spark):
    lots = spark.createDataFrame([(1, "AB12"), (1, "AB13"), (2, "X"), (2, "XY"), (3, "Q")], "order_id long, lot string")
    got = {(r.order_id, r.lot): (r.start, r.marked) for r in L.distinguishing(lots).collect()}
    assert got == {(1, "AB12"): (3, "AB1[2]"), (1, "AB13"): (3, "AB1[3]"), (2, "X"): (-1, "X"), (2, "XY"): (1, "X[Y]"), (3, "Q"): (0, "[Q]")}


@pytest.mark.parametrize("most", [0, 2, 32])
def test_lots_of_small_and_large_groups(spark, most):
    lots = [(1, "AB12"), (1, "AB13"), (2, "X"), (2, "XY"), (3, "Q"), (3, ""), (3, None), (4, "ABCDEF"), (4, "ABCDxBCDEFx"), (4, "ABCDyBCDEFy"), (4, "yABCDE"), (4, "xx"), (4, "yy"), (None, "Z"), (None, "W"), *[(5, f"L{i}") for i in range(40)], (6, "a\0b"), (6, "a"), (6, "b"), (6, "xa\0")]
    got = {(r.order_id, r.lot): r.marked for r in L.distinguishing(spark.createDataFrame([*lots, *lots], "order_id long, lot string"), most=most).collect()}

    def marked(g, lot):
        others = [x for h, x in lots if h == g and x and x != lot]
        spans = [(n, i) for n in range(1, len(lot or "") + 1) for i in range(len(lot) - n + 1) if g is not None and not any(lot[i : i + n] in x for x in others)]
        n, i = min(spans, default=(0, 0))
        return f"{lot[:i]}[{lot[i : i + n]}]{lot[i + n :]}" if n else lot

    assert got == {(g, lot): marked(g, lot) for g, lot in lots} and len(got[4, "ABCDEF"]) == 8


def shuffled(spark):
    """How many rows the session's stages have shuffled so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lots_of_ordinary_groups_make_no_row_for_each_substring(spark):
    lots = spark.range(4000).selectExpr("id div 4 AS order_id", "concat('RF1996', id) AS lot")
    before = shuffled(spark)
    assert len(L.distinguishing(lots).collect()) == 4000
    assert shuffled(spark) - before <= 3 * 4000


@pytest.mark.parametrize(
    "tray, steps, description",
    [
        ([("INJECTION, POWDER, LYOPHILIZED, FOR SOLUTION", "drug"), ("INJECTION", "sterile water")], "reconstitution", "Reconstitution"),
        ([("INJECTION, POWDER, FOR SOLUTION", "drug"), ("INJECTION, SOLUTION", "sodium chloride")], "reconstitution,dilution", "Reconstitution + Dilution"),
        ([("INJECTION, SOLUTION", "drug"), ("INJECTION, SOLUTION", "dextrose")], "dilution", "Dilution"),
        ([("INJECTION, SOLUTION", "drug")], "repack", "Repack-Only"),
        ([("INJECTION, SOLUTION, CONCENTRATE", "drug")], "dilution", "Dilution"),
        ([("INJECTION, POWDER, FOR SOLUTION", "a"), ("INJECTION, POWDER, FOR SOLUTION", "b")], "combination", "Combination Admixture"),
        ([("POWDER", "a")], "", "Unknown Process"),
        ([("INJECTION, SUSPENSION", "a"), ("TABLET", "b")], "", "Unknown Process"),
    ],
)
def test_processes(spark, tray, steps, description):
    rows = spark.createDataFrame([(1, i, f, g) for i, (f, g) in enumerate(tray)], "tray_id long, pos int, dosage_form string, generic string")
    r = I.inferred_process(rows).first()
    assert (r.steps, r.description) == (steps, description)


def test_buckets(spark):
    df = spark.createDataFrame([("Vancomycin 5 mg",), ("loratadine heparin",), ("heparin zinc oxide lotion",), ("body lotion",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(I.bucket(F.col("t"))).collect()] == ["rx", "rx", "otc", "otc", "unknown", "unknown"]


def test_graph_family_and_walk(spark):
    concepts = spark.createDataFrame([("i", "IN", "N"), ("c", "SCDC", "N"), ("d", "SCD", "N"), ("x", "SCDF", "N"), ("o", "SCDC", "O")], "rxcui string, tty string, suppress string")
    edges = spark.createDataFrame([("c", "has_ingredient", "i"), ("c", "has_ingredient", "i"), ("d", "consists_of", "c"), ("x", "isa", "i"), ("o", "has_ingredient", "i"), ("i", "has_ingredient", "i")], "source string, rela string, target string")
    assert {(r.source, r.target) for r in G.family_edges(edges, concepts).collect()} == {("c", "i"), ("d", "c")}
    walked = {r.rxcui: r.depth for r in G.walk(edges, concepts.where("rxcui = 'd'"), 2).collect()}
    assert walked == {"d": 0, "c": 1, "i": 2}


def test_roles_hold_below_the_place_of_the_grant(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    up = {(r.id, r.ancestor) for r in G.ancestors(tree).collect()}
    assert up == {(1, 1), (2, 2), (2, 1), (3, 3), (3, 2), (3, 1), (4, 4)}


def test_users_of_a_place_and_above_are_counted_without_pairs(spark):
    chain = [(1, None), (2, 1), (3, 2), (4, 2), (5, 3), (10, 11), (11, 12), (12, 10), (13, 10), (20, 1), (20, 6), (21, 20), (6, None)]  # a cycle, and a fork at 20
    tree = spark.createDataFrame(chain, "id long, parent_id long")
    given = [("a", 1), ("a", 3), ("b", 2), ("b", 5), ("b", 4), ("c", 5), ("c", 5), ("d", 11), ("d", 12), ("d", 13), ("e", 12), ("a", 6), ("f", 21), (None, 6), (None, 3), ("g", 99)]
    grants = spark.createDataFrame(given, "user_id string, facility_id long")
    up = {(r.id, r.ancestor) for r in G.ancestors(tree).collect()}
    want = {i: len({u for u, f in given if u and (i, f) in up}) for i in {i for i, _ in chain} if any((i, f) in up for _, f in given)}
    assert {r.facility_id: r.users for r in G.role_counts(grants, G.ancestors(tree)).collect()} == want
    wide = spark.range(1, 1001).selectExpr("id", "nullif(least(id - 1, 1), 0) AS parent_id")
    many = spark.range(1000).selectExpr("id AS user_id", "1L AS facility_id")
    before = shuffled(spark)
    assert {r.users for r in G.role_counts(many, G.ancestors(wide)).collect()} == {1000}
    assert shuffled(spark) - before < 100_000  # a million pairs


def test_active_grants(spark):
    g = spark.sql("SELECT * FROM VALUES (1, NULL, NULL), (2, TIMESTAMP'2020-01-01', NULL), (3, NULL, TIMESTAMP'2020-01-01'), (4, NULL, TIMESTAMP'2030-01-01') AS t(id, revoked_at, expires_at)")
    assert {r.id for r in C.active_grants(g, "2024-01-01").collect()} == {1, 4}


def test_first_candidate_wins(spark):
    products = spark.createDataFrame([("1234-5678", "a", 1.0, "mg"), ("12345-678", "b", 2.0, "mg")], "product_ndc string, generic string, strength double, unit string")
    labelers = spark.createDataFrame([("1234", "four")], "code string, name string")
    printed = spark.createDataFrame([("1234567890",), ("12345-678-90",), ("9",)], "ndc string")
    got = {r.ndc: (r.generic, r.labeler) for r in C.resolve_ndc(printed, products, labelers).collect()}
    assert got == {"1234567890": ("a", None), "12345-678-90": ("b", "four"), "9": (None, None)}


def test_leftmost_then_longest_phrase_by_one_scan(spark):
    texts = [(1, "So, of The mit-license"), (2, "mit"), (3, "a mit license, under mit"), (4, ""), (5, None), (6, "... --"), (7, "licenses of"), (8, "x y z mit license b c")]
    phrases = ["of the", "of", "mit license", "mit license b", "under mit license c", "y  z", "", None]
    found = C.leftmost_longest(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in phrases], "phrase string"), 3)
    assert {r.id: (r.phrase, r.pos) for r in found.collect()} == {1: ("of the", 1), 3: ("mit license", 1), 7: ("of", 1), 8: ("mit license b", 3)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 1)], "k string, v int, line int")
    assert {tuple(r) for r in E.upserted(old, new, ["k"], F.col("line")).collect()} == {("a", 6), ("b", 2), ("c", 7)}


SPL = """<document xmlns="urn:hl7-org:v3"><component><structuredBody><component><section><code code="34068-7"/><title>2 Dosage</title><text>Use it.</text>
<component><section><code code="x"/><text>Reconstitute with water; refrigerated vials.</text></section></component></section></component>
<component><section><code code="42229-5"/><title>Other</title><text>Keep dry.</text></section></component></structuredBody></component></document>"""


def test_ancestors_have_no_depth_limit(spark):
    chain = [(i, i + 1 if i < 12 else None) for i in range(1, 13)]
    tree = spark.createDataFrame([*chain, (20, 21), (21, 22), (22, 20), (30, 30), (31, 20)], "id long, parent_id long")
    up = {(r.id, r.ancestor, r.depth) for r in G.ancestors(tree).collect()}
    assert {x for x in up if x[0] < 20} == {(i, j, j - i) for i in range(1, 13) for j in range(i, 13)}
    assert sorted(x for x in up if x[0] >= 20) == [(20, 20, 0), (20, 21, 1), (20, 22, 2), (21, 20, 2), (21, 21, 0), (21, 22, 1), (22, 20, 1), (22, 21, 2), (22, 22, 0), (30, 30, 0), (31, 20, 1), (31, 21, 2), (31, 22, 3), (31, 31, 0)]


def test_label_sections(spark):
    s = D.xml_sections(spark.createDataFrame([("a", SPL)], "setid string, xml string"))
    got = [(r.path, r.title, r.tags) for r in s.select("ordinal", "path", "title", D.tags(F.col("text"), F.col("path")).alias("tags")).orderBy("ordinal").collect()]
    # stems match at a word's end only: neither "Reconstitute" nor "refrigerated" does, and the codes above decide
    assert got == [("34068-7", "2 Dosage", ["preparation"]), ("34068-7/x", "2 Dosage", ["preparation"]), ("42229-5", "Other", ["storage"])]


def test_page_blocks(spark):
    html = "<nav><p>menu</p></nav><article><h1>T</h1><p>1. do<br>it</p><ul><li>a</li></ul><script>x</script><b>Head</b><p>Note: b</p></article>"
    got = [(r.section, r.title, r.kind, r.text) for r in D.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ordinal").collect()]
    assert got == [("nav", "", "body", "menu"), ("article", "T", "title", "T"), ("article", "T", "numbered_step", "1. do it"), ("article", "T", "list_item", "a"), ("article", "T", "subheading", "Head"), ("article", "T", "note", "Note: b")]


def test_pages_come_in_batches_of_bounded_bytes(spark):
    sizes = D.html_blocks(spark.range(400).selectExpr("id AS page_id", "concat('<p>', repeat('text ', 20000), id, '</p>') AS html").coalesce(1))
    assert sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg({"n": "max"}).first()[0] <= 50
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "-1"


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(source))
    q = S.tumbling(S.event_stream(spark, str(source), 1)).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = S.tumbling(spark.read.parquet(str(source)))
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, batch.collect()))


def test_changes_cascade(spark, tmp_path):
    changes = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("b", True, 1)], "code string, active boolean, ts int")
    changes.write.parquet(str(tmp_path / "in"))
    products = spark.createDataFrame([("p", "a", True), ("q", "b", True), ("r", "c", True)], "ndc string, code string, active boolean")
    seen = {}
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    S.cascade(stream, products, "code", lambda df, n: seen.update({r.ndc: r.active for r in df.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == {"p": False, "q": True}


def test_ingested_records_of_odd_documents(spark):
    from galenic.operators import ingest

    docs = [(1, '[{"ingredient": "a", "strength": "1", "unit": "MG"}, {"name": "a", "strength": "2", "unit": "G"}, {"name": "b"}]'), (2, None), (3, "not json"), (4, "[]")]
    got = ingest.ingredient_rows(spark.createDataFrame(docs, "id long, json string"), "id").collect()
    assert {tuple(r) for r in got} == {(1, "a", "2", "G"), (1, "b", None, None)}
    lists = [(1, '{"X": {"codes": ["1", "2"]}}'), (2, '{"Y": {"codes": ["2"]}, "Z": {"codes": null}}'), (3, None), (4, '{"W": null}')]
    index = ingest.labeler_index(spark.createDataFrame(lists, "pos long, json string"))
    assert {tuple(r) for r in index.collect()} == {("1", "X"), ("2", "Y")}
    ids = spark.createDataFrame([("12",), ("x1",), ("",), (None,)], "rxcui string")
    assert [r[0] for r in ids.select(ingest.row_number_of(F.col("rxcui"))).collect()] == [12, None, None, None]
    boxes = [(0, 0, "vial", 0, None, "n"), (0, 0, "vial", 1, "L", None), (0, 1, "vial", 0, "L", "m"), (0, 1, "bag", 1, "L", "n")]
    shared = ingest.shared_fields(ingest.merged_classes(spark.createDataFrame([(*b, None) for b in boxes], "run long, image long, class_label string, pos long, lot string, ndc string, exp string")))
    assert [tuple(r) for r in shared.collect()] == [(0, 1, "vial", "lot", "lot")]
