"""Product codes of parts from number 10,000 on have more digits than a drug code; queries give what their SQL gives there too."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

from galenic.functions import records as P
from galenic.plans.catalogue import ORACLE, QUERIES

NAMES = ["field_extract", "kit_component_links", "kit_components", "ndc_product_candidates", "ndc_variants", "package_texts", "label_fields"]


@pytest.fixture(scope="module")
def long_codes(sf_dir, tmp_path_factory):
    """The tables with part numbers around 10,000."""
    d = str(tmp_path_factory.mktemp("long-codes"))
    for f in os.listdir(sf_dir):
        key = {"part.parquet": "p_partkey", "lineitem.parquet": "l_partkey"}.get(f)
        columns = f"* REPLACE ({key} + 9900 AS {key})" if key else "*"
        duckdb.sql(f"COPY (SELECT {columns} FROM '{sf_dir}/{f}') TO '{d}/{f}'")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql_for_long_codes(spark, long_codes, name):
    con = duckdb.connect()
    for f in os.listdir(long_codes):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{long_codes}/{f}'")
    assert rows(QUERIES[name](spark, long_codes).toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_component_strings_are_taken_apart_once(spark):
    df = spark.createDataFrame([("VIAL, FUROSEMIDE 100mg/10mL, #2",), ("ns 50 ML IVPB",), ("",), (None,), ("#3, bag",)], "t string").repartition(1)
    c = df.select(P.component(F.col("t")).alias("c")).select("c.*")
    assert {tuple(r) for r in c.collect()} >= {("VIAL", "FUROSEMIDE", "100mg/10mL", 2), (None, "sodium chloride", "50 ML", 1), ("BAG", "", None, 3)}
    assert c._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
