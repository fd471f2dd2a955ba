"""Readers: dispatch, CSV missing tokens and type inference, JSON arrays."""

import json
import os

import pytest

from quarry.sources import readers as R


def test_dispatch_and_errors():
    assert R.resolve_type("x/data.PQ") == "pq"
    assert R.resolve_type("blob", "CSV") == "csv"
    assert R.resolve_type("a.json", ".parquet") == "parquet"
    with pytest.raises(ValueError):
        R.resolve_type("a.txt")


def test_csv_tokens_and_types(spark, tmp_folder):
    p = os.path.join(tmp_folder, "t.csv")
    with open(p, "w") as fh:
        fh.write("a,b,c,d,e\n1,1.5,True,x,2024-01-01 00:00:00\nNA,n/a,False,NULL,\n3,2,true,y,2024-01-02 10:00:00\n")
    assert dict(R.load_dataset(spark, p).dtypes)["e"] == "string"  # times stay text unless asked for
    df = R.scan_csv(spark, p, times=True)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "timestamp_ntz"}
    rows = df.orderBy("e").collect()
    assert rows[0]["a"] is None and rows[0]["b"] is None and rows[0]["d"] is None


def test_json_array_and_lines(spark, tmp_folder):
    recs = [{"sensor_id": "s1", "temperature": 20.5}, {"sensor_id": "s2", "temperature": None}]
    arr = os.path.join(tmp_folder, "a.json")
    with open(arr, "w") as fh:
        json.dump(recs, fh, indent=2)
    lines = os.path.join(tmp_folder, "l.json")
    with open(lines, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    for p in (arr, lines):
        df = R.load_dataset(spark, p)
        assert sorted(r["sensor_id"] for r in df.collect()) == ["s1", "s2"]


def test_preview_rows_orders_and_limits(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = [r["o_orderkey"] for r in R.preview_rows(o, ["o_orderkey"], 5).collect()]
    assert got == sorted(got) and len(got) == 5


def test_export_version_round_trip(spark, tmp_folder):
    from quarry.sources.sinks import export_version
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderkey", "o_orderstatus", "o_totalprice")
    for t in ("csv", "json", "parquet"):
        path = export_version(o, os.path.join(tmp_folder, t), t)
        back = R.load_dataset(spark, path, t)
        assert sorted(tuple(r) for r in back.select(*o.columns).collect()) == \
            sorted(tuple(r) for r in o.collect())
    with pytest.raises(ValueError):
        export_version(o, os.path.join(tmp_folder, "x"), "xlsx")


def test_file_order_defaults(spark):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from quarry.operators import profile as P
    path = "/root/testdata/sf0.001/events.parquet"
    want = pq.read_table(path).to_pandas()
    got = [r["event_id"] for r in R.preview_rows(spark.read.parquet(path), n=5).collect()]
    assert got == want["event_id"].head(5).tolist()
    ev = spark.read.parquet(path).select(F.col("value").alias("score"))
    m = P.custom_metrics(ev).collect()[0]
    assert m["latest"] == round(float(want["value"].dropna().iloc[-1]), 6)
    with pytest.raises(ValueError):
        R.preview_rows(spark.createDataFrame([(1,)], "a int"))


def test_iso_text_is_zone_free(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from quarry.functions.text import iso
    vals = [datetime(1999, 10, 3), datetime(2024, 1, 1, 0, 0, 7, 100000), datetime(2020, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(v.isoformat(),) for v in vals], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")  # midnight gap on 1999-10-03
        assert [r[0] for r in df.select(iso(F.col("ts"))).collect()] == [v.isoformat() for v in vals]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_csv_quotes_suffixes_and_malformed_rows(spark, tmp_folder):
    path = f"{tmp_folder}/q.csv"
    with open(path, "w") as f:
        f.write('a,b,c\n"x ""quoted"" word, x",10d,2020-01\n"two\nlines",20f,2020-02\n,NA,\n')
    rows = [tuple(r) for r in R.scan_csv(spark, path, multiline=True).collect()]
    assert rows == [('x "quoted" word, x', "10d", "2020-01"), ("two\nlines", "20f", "2020-02"), (None, None, None)]
    for k, bad in enumerate(("1,2,3,4\n", '"open,2,3\n')):
        with open(f"{tmp_folder}/bad{k}.csv", "w") as f:
            f.write("a,b,c\n" + bad)
        with pytest.raises(Exception, match="malformed CSV row"):
            R.scan_csv(spark, f"{tmp_folder}/bad{k}.csv").collect()


def test_json_folder_of_mixed_kinds_raises(spark, tmp_folder):
    for name, text in (("a.json", '{"x": 1}\n{"x": 2}\n'), ("b.json", '[{"x": 3},\n {"x": 4}]')):
        with open(f"{tmp_folder}/{name}", "w") as f:
            f.write(text)
    assert R.scan_json(spark, f"{tmp_folder}/a.json").count() == R.scan_json(spark, f"{tmp_folder}/b.json").count() == 2
    with pytest.raises(ValueError, match="mixes"):
        R.scan_json(spark, tmp_folder)
