"""Stored profile documents, their long form, metric merging and the incremental profile of arriving files."""

import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarry.operators import documents as D
from quarry.operators import profile as P
from quarry.sources import sinks as K
from quarry.streaming import incremental as ST

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def events(spark):
    """All column kinds: integral, real with NaN and null, text, boolean, time, decimal, nested, and repeated rows."""
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("value", "score")
    ev = (ev.withColumn("is_f1", F.col("event_id") % 3 == 0).withColumn("part", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
          .withColumn("cost", F.col("score").cast("decimal(20,4)")).withColumn("tags", F.array("event_type")).withColumn("none", F.lit(None).cast("double")))
    return ev.where("event_id < 300").unionByName(ev.where("event_id < 5"))


def test_document_returns_to_the_long_form(spark, events, tmp_folder):
    path = f"{tmp_folder}/index"
    supplied = '{"score": 0.5, "lr": 0.1, "note": {"max": 3}, "list": [1]}'
    K.index_append(D.profile_document(events, "ev.parquet", "parquet", "event_id", supplied), path)
    K.index_append(D.profile_document(events.limit(0), "none.csv", "csv"), path)
    index = D.read_index(spark, path)
    doc = index.where("file_name = 'ev.parquet'")
    assert rows_of(D.long_profile(doc)) == rows_of(P.profile_table(events))
    assert rows_of(D.long_histogram(doc)) == rows_of(P.histogram(events))
    assert rows_of(D.long_top_values(doc)) == rows_of(P.top_values(events))
    one = doc.first()
    assert one.duplicate_rows == P.duplicate_rows(events).first()[0] == 5
    assert one.columns_schema == dict(events.dtypes) and one.column_count == len(events.columns)
    metrics = [(r.metric, r.source, r.value) for r in one.custom_metrics]
    assert metrics == [("score", "external", "0.5"), ("is_f1", "detected", None), ("lr", "external", "0.1"), ("note", "external", '{"max":3}'), ("list", "external", "[1]")]
    assert " Score: 0.5. Recorded 'is_f1' peak: 1.0. Lr: 0.1. Recorded 'note' peak: 3." in one.summary
    text = json.loads(one.stats)
    assert text["row_count"] == 305 and [c["column"] for c in text["statistics"]] == events.columns
    empty = index.where("file_name = 'none.csv'").first()
    assert empty.row_count == 0 and len(empty.statistics) == len(events.columns) and empty.distributions == [] and empty.file_type == "csv"


def test_merge_metrics_without_supplied_ones(spark):
    detected = spark.createDataFrame([("loss", 1.0, 2.0, 1.5, 0)], "metric string, latest double, max double, mean double, position int")
    assert [tuple(r)[:2] for r in D.merge_metrics(detected, None).select("metric", "source").collect()] == [("loss", "detected")]
    assert D.merge_metrics(detected.limit(0), '{"a": 1}').count() == 1


def test_incremental_profile(spark, events, tmp_folder):
    base, incoming, index = tmp_folder, f"{tmp_folder}/in", f"{tmp_folder}/index"

    def arrive(name, df):
        df.coalesce(1).write.parquet(f"{base}/{name}-made")
        os.makedirs(incoming, exist_ok=True)
        shutil.copy(glob.glob(f"{base}/{name}-made/*.parquet")[0], f"{incoming}/{name}.parquet")

    def run():
        return ST.incremental_profile(ST.file_stream(spark, incoming, "*.parquet", events.schema), index, external_metrics='{"lr": 0.1}')
    arrive("one", events.where("event_id % 2 = 0"))
    assert run().count() == 1
    arrive("two", events.where("event_id % 2 = 1"))
    arrive("three", events.where("event_id < 100"))
    found = run()
    assert found.count() == 3 and run().count() == 3  # a run without new files adds nothing
    for name in ("one", "two", "three"):
        df = spark.read.parquet(f"{incoming}/{name}.parquet")
        doc = found.where(F.col("file_name") == f"{name}.parquet")
        assert rows_of(D.long_profile(doc)) == rows_of(P.profile_table(df))
        assert rows_of(D.long_histogram(doc)) == rows_of(P.histogram(df))
        assert rows_of(D.long_top_values(doc)) == rows_of(P.top_values(df))
        one = doc.first()
        assert one.duplicate_rows == P.duplicate_rows(df).first()[0]
        detected = {tuple(r)[:4] for r in P.custom_metrics(df).collect()}
        assert {(m.metric, m.latest, m.max, m.mean) for m in one.custom_metrics if m.source == "detected"} == detected
        assert [m.metric for m in one.custom_metrics if m.source == "external"] == ["lr"]


def test_states_of_files_add_up(spark, events):
    """The profile of several files together, from their states alone."""
    from quarry.functions.clean import column_specs

    whole = P.value_counts(*P._data_specs(events, []), [], include_nulls=True)
    parts = [P.value_counts(*P._data_specs(events.where(c), []), [], include_nulls=True) for c in ("event_id % 3 = 0", "event_id % 3 > 0")]
    merged = parts[0].unionByName(parts[1]).groupBy("cidx", "l", "d", "s").agg(F.sum("cnt").alias("cnt"))
    specs = column_specs(events)
    assert rows_of(P.profile_of_counts(merged, specs)[0]) == rows_of(P.profile_of_counts(whole, specs)[0]) == rows_of(P.profile_table(events))
