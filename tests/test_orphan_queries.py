"""The orphan queries hold blobs against every tree entry, also those of late shipments."""

import datetime

import pytest

import __spark_entry__ as entry


@pytest.fixture()
def tables(spark, tmp_folder):
    late = datetime.datetime(1998, 1, 1)
    lines = [(1, 1, 1, 1, "N", "O", late), (2, 2, 1, 1, "R", "F", datetime.datetime(1994, 1, 1)), (2, 3, 1, 2, "A", "F", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, "
                                 "l_shipdate timestamp_ntz").write.parquet(f"{tmp_folder}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "p_partkey long, p_size int").write.parquet(f"{tmp_folder}/part.parquet")
    spark.createDataFrame([(1, "abc")], "doc_id long, text string").write.parquet(f"{tmp_folder}/documents.parquet")
    return tmp_folder


def test_only_blobs_without_any_entry_are_orphans(spark, tables):
    q = entry.queries()
    for name in ("orphan_blobs", "orphans"):
        assert sorted(r["size_bytes"] for r in q[name](spark, tables).collect()) == [3, 400000], name
    assert tuple(q["gc_summary"](spark, tables).collect()[0]) == (2, 400003)
