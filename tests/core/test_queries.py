import os

import duckdb
import pytest

from glimmer.plans.queries import ORACLE_SQL, QUERIES
from glimmer.sources import testdata

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    c = duckdb.connect()
    for table in ("events", "part"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(df.select(*names).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_serving_derives_the_cells_once(spark):
    """Curves and figures come from one derivation of the cells; the tiers' boundary reads the times alone, and where the tier isn't asked for, not even those."""
    for name in ("curve_dense", "kpi_peak_avg", "hour_grain", "concurrency_now", "tier_cold", "tier_hot", "cells_session_aware", "dropdown_platform"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "events.parquet" in line]
        whole = [line for line in scans if not line.endswith(("ReadSchema: struct<ts:timestamp_ntz>", "ReadSchema: struct<>"))]
        assert len(whole) == 1 and len(scans) <= 2, (name, scans)
        assert ("THEN cold ELSE hot" in plan) == (name == "concurrency_now"), name
    for name in ("dropdown_platform", "dropdown_category", "dropdown_content"):
        assert "Window" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_rows_are_there_to_be_dropped(spark):
    kept, all_of = QUERIES["intervals_retained"](spark, "/root/testdata/sf0.01").count(), QUERIES["session_intervals"](spark, "/root/testdata/sf0.01").select("video_session_id").distinct().count()
    assert 0 < kept < all_of


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_reconciliations_are_not_empty_and_agree(spark):
    for name in [n for n in QUERIES if n.startswith(("reconcile_", "compare_peaks"))]:
        df = QUERIES[name](spark, SF)
        if "agree" in df.columns:
            rows = df.select("agree").collect()
            assert rows and all(r["agree"] for r in rows), name


@pytest.mark.parametrize("name", ["video_type", "category"])
def test_dropdowns_of_a_large_catalogue_are_whole(spark, monkeypatch, name):
    """The SQL has no limit: of 1500 values in the catalogue, watched or not, none is missing; and they come in order."""
    catalogue = spark.range(1500).selectExpr("id AS content_id", "'t' || id AS title", "'v' || id AS video_type", "'c' || id AS category")
    monkeypatch.setattr(testdata, "content", lambda spark, sf_dir: catalogue)
    monkeypatch.setattr(testdata, "landing", lambda spark, sf_dir: None)
    assert [r[0] for r in QUERIES[f"dropdown_{name}"](spark, "").collect()] == sorted(f"{name[0]}{i}" for i in range(1500))
