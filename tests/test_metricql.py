"""Metric predicate rules."""

import pytest

from quarry.functions.metricql import metric_predicate, parse


def _match(spark, expr, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, m string")
    return [r["ok"] for r in df.select("i", metric_predicate(expr, df.m).alias("ok")).orderBy("i").collect()]


def test_missing_is_zero_and_dict_uses_latest(spark):
    docs = ['{"loss":{"latest":0.05}}', "{}", '{"model":"x"}']
    assert _match(spark, "loss < 0.1", docs) == [True, True, True]


def test_text_metric_never_matches(spark):
    assert _match(spark, "model > 0", ['{"model":"x"}']) == [False]


def test_and_of_conditions(spark):
    assert _match(spark, "a > 0.5, a < 0.9", ['{"a":1}', '{"a":0.7}']) == [False, True]


def test_or_groups(spark):
    assert _match(spark, "a > 5 OR b < 1", ['{"a":1,"b":0}', '{"a":1,"b":3}']) == [True, False]


def test_unreadable_condition_is_skipped_and_numbers_stop_at_letters():
    assert parse("a > -1") == [[]]
    assert parse("a < 1e-3") == [[("a", "<", 1.0)]]
    assert parse("a >= 2") == [[("a", ">=", 2.0)]]
    assert parse("a > 1.2.3") == [[("a", ">", None)]]


def test_strict_raises_on_unreadable_condition():
    with pytest.raises(ValueError):
        parse("a ~ 1", strict=True)


def test_dict_without_latest_and_null(spark):
    assert _match(spark, "a < 1", ['{"a":{"max":5}}', '{"a":null}', '{"a":"0.5"}']) == [True, False, True]


def test_strict_reads_signed_and_scientific_numbers():
    assert parse("a > -1, b <= 1e-3", strict=True) == [[("a", ">", -1.0), ("b", "<=", 0.001)]]
    with pytest.raises(ValueError):
        parse("a > 1.2.3", strict=True)
