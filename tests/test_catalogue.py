"""Every query runs; where there is SQL, DuckDB gives the same rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from galenic import views
from galenic.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.queries()) >= set(QUERIES)


def test_whole_queries_leave_nothing_out(spark, sf_dir):
    admins = {r.facility_id: r.admins for r in QUERIES["role_inheritance"](spark, sf_dir).collect()}
    parents = {r.id: r.parent_id for r in views.facilities(spark, sf_dir).collect()}
    assert any(admins[k] > admins.get(parents[k], 0) for k in admins if k > 1000)  # by grants on a customer itself
    concepts = QUERIES["strict_rxname"](spark, sf_dir).where("tty IN ('SCD', 'SBD')").agg({"n": "sum"}).first()[0]
    assert QUERIES["quantified_forms"](spark, sf_dir).select("base_rxcui").distinct().count() == concepts
