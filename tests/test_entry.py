"""The driver contract."""

import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from assayline.plans import closed_forms

SF = "/root/testdata/sf0.001"
NAMES = ["calibration_1var", "metrics_by_group", "pre_msc_sg", "outer_split_native", "population_audit", "crs_scores", "mad_outliers", "one_se_select", "feature_combined", "knn_join", "ridge_one_se", "kennard_stone", "mccv_whole_table", "crs_sensitivity", "observed_progress", "digest_orders", "validator_report"] + [f"fixed_{m}" for m in closed_forms.MODELS]


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    importlib.reload(entry)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)

    def norm(v):
        return float(f"{v:.8g}") if isinstance(v, float) else v

    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert a == b
