"""The six seeded fixture data sets described in FIXTURES.md §1.

Point ``QUARRY_FIXTURE_DIR`` at a folder holding them as CSV files; they are
read as data through our own reader.  Skipped when the folder is not given.
"""

import os

import pytest

from quarry.operators import cas
from quarry.operators import profile as P
from quarry.sources.readers import load_dataset

DATA = os.environ.get("QUARRY_FIXTURE_DIR", "")
pytestmark = pytest.mark.skipif(not (DATA and os.path.isdir(DATA)),
                                reason="QUARRY_FIXTURE_DIR not set")


def _load(spark, name):
    return load_dataset(spark, f"{DATA}/{name}.csv")


def _prof(df):
    return {r["column"]: r for r in P.profile_table(df).collect()}


def test_iris_high_null_column(spark):
    df = _load(spark, "iris_raw")
    p = _prof(df)
    assert p["sepal_width"]["row_count"] == 150
    assert (p["sepal_width"]["null_count"], p["sepal_width"]["null_pct"]) == (8, 5.33)
    assert p["species"]["unique_count"] == 3
    high = [r["column"] for r in P.high_null_columns(P.profile_table(df)).collect()]
    assert high == ["sepal_width"]


def test_training_metrics_latest_values(spark):
    df = _load(spark, "training_metrics")
    assert P.metric_columns(df) == ["accuracy", "val_accuracy", "loss", "val_loss", "f1_score"]
    latest = {r["metric"]: r["latest"] for r in P.custom_metrics(df, "epoch").collect()}
    assert latest == {"accuracy": 0.9414, "val_accuracy": 0.9098, "loss": -0.0019,
                      "val_loss": 0.0165, "f1_score": 0.9027}


def test_sales_nulls_categories_and_bool(spark):
    df = _load(spark, "sales_q1")
    assert dict(df.dtypes)["is_returned"] == "boolean"
    p = _prof(df)
    assert p["order_id"]["unique_count"] == 500
    assert (p["product"]["unique_count"], p["region"]["unique_count"]) == (5, 4)
    assert (p["customer_age"]["null_count"], p["customer_age"]["null_pct"]) == (15, 3.0)
    assert {r["column"] for r in P.histogram(df).collect()} >= {"is_returned", "quantity"}


def test_churn_nulls_and_metric_columns(spark):
    df = _load(spark, "churn_dataset")
    p = _prof(df)
    assert (p["satisfaction_score"]["null_count"], p["satisfaction_score"]["null_pct"]) == (10, 3.33)
    assert P.metric_columns(df) == ["satisfaction_score", "auc_score"]


def test_identical_uploads_share_one_blob(spark):
    files = cas.hash_files(spark, f"{DATA}/iris_raw*.csv").collect()
    assert len(files) == 2 and len({r["blob_hash"] for r in files}) == 1
