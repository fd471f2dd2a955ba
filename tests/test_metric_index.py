"""Typed metric columns: the same answers as the JSON rule, older files, and predicates that reach the scan."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.metricql import metric_predicate, metrics_map
from quarry.operators import metric_index as M

METRICS = [{"acc": 0.9, "loss": 0.05}, {"acc": {"latest": 0.4, "max": 1.0}}, {"acc": {"max": 1.0}}, {"acc": "0.95"}, {"acc": "high"}, {"acc": None},
           {"acc": True}, {"Acc": 0.99}, {"acc": [1]}, {"loss": "1d"}, {"loss": -2}, {"acc": 1e-3, "loss": {"latest": "x"}}, {}, None, {"odd name": 3, "acc": 0}]
CONDITIONS = ["acc > 0.5", "acc >= 0", "acc == 0", "loss < 0.1", "loss <= 0", "acc > 0.5, loss < 0.1", "acc > 0.8 OR loss < 0", "unknown < 1", "unknown > 1",
              "Acc > 0.5", "nonsense", "acc > 1.2.3", "acc < 1, nonsense OR loss > 5", None, " "]


def records(spark, metrics, start=0):
    rows = [(start + i, json.dumps({"file_name": f"f{i}.csv", "file_type": "csv", "row_count": i, "column_count": 2, "custom_metrics": m})) for i, m in enumerate(metrics)]
    rows.append((start + 100, json.dumps({"file_name": "x"})))
    return spark.createDataFrame(rows, "id long, stats string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def by_json(df, expr):
    return df.where(metric_predicate(expr, metrics_map(F.col("stats")), parsed=True))


@pytest.mark.parametrize("names", [None, ["acc"], []])
def test_index_answers_like_the_json_rule(spark, tmp_folder, names):
    df = records(spark, METRICS)
    M.append_metadata(df, tmp_folder + "/i", names=names)
    index = M.read_metadata(spark, tmp_folder + "/i")
    for expr in CONDITIONS:
        assert ids(index.where(M.metric_condition(index, expr))) == ids(by_json(df, expr)), expr
    one = index.where("id = 3").first()
    assert (one.file_name, one.row_count, one.column_count) == ("f3.csv", 3, 2)


def test_files_written_before_a_metric_was_known(spark, tmp_folder):
    old, new = records(spark, [{"acc": 0.2}, {}]), records(spark, [{"acc": 0.7, "f1": 0.5}, {"f1": "bad"}], start=1000)
    for part in (old, new):
        M.append_metadata(part, tmp_folder + "/i")
    index, both = M.read_metadata(spark, tmp_folder + "/i"), old.unionByName(new)
    for expr in ("f1 < 1", "f1 >= 0.5", "f1 == 0", "acc > 0.1, f1 <= 0", "f1 > 0.1 OR acc < 0.5"):
        assert ids(index.where(M.metric_condition(index, expr))) == ids(by_json(both, expr)), expr


def test_predicates_reach_the_scan(spark, tmp_folder):
    M.append_metadata(records(spark, METRICS), tmp_folder + "/i")
    index = M.read_metadata(spark, tmp_folder + "/i")
    for expr, wanted in (("acc > 0.5", "GreaterThan(metric_acc_"), ("loss < 0.1", "LessThan(metric_loss_"), ("acc > 0.8 OR loss > 3", "Or(GreaterThan(metric_acc_")):
        plan = index.where(M.metric_condition(index, expr)).select("id")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [", 1)[1].split("], ReadSchema")[0]
        assert wanted in pushed and "stats" not in plan.split("ReadSchema: ", 1)[1]


def test_frequent_names_are_bounded(spark):
    df = records(spark, [{f"m{i}": 1, "common": 2, "not a name": 3} for i in range(40)])
    assert M.frequent_names(df, 3) == ["common", "m0", "m1"]
