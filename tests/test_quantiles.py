"""Bracketed quantiles on shapes that defeat bins of equal width, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhour.operators import dedupe, profile


def check(spark, values, probs, accuracy):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    got = {r.prob: r.q for r in profile.exact_quantiles(df, "x", probs, accuracy=accuracy).collect()}
    for p in probs:
        want = np.quantile(values, p)
        assert abs(got[p] - want) <= 1e-9 * max(1.0, abs(want)), p


@pytest.mark.parametrize("accuracy", [50, 300, 10000])
def test_shapes_that_bins_cannot_tell_apart(spark, accuracy):
    rng = np.random.default_rng(1)
    probs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.500001, 0.99, 1.0]
    # all values in a thousandth of the range, and one far away
    check(spark, np.append(5.0 + rng.random(4000) / 1000, 1e6), probs, accuracy)
    check(spark, np.repeat([1.0, 2.0, 3.0], [3000, 10, 1000]), probs, accuracy)
    check(spark, rng.integers(0, 5, 3001).astype(float), probs, accuracy)
    check(spark, np.array([7.0]), probs, accuracy)


def test_groups_of_all_sizes_with_nulls_and_nan(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=5000), None: rng.random(900), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.prob): r.q for r in profile.exact_quantiles(df, "x", [0.1, 0.9], ("g",), accuracy=100).collect()}
    assert set(got) == {(g, p) for g in groups for p in (0.1, 0.9)}
    assert all(abs(got[g, p] - np.quantile(vs, p)) < 1e-12 for g, vs in groups.items() for p in (0.1, 0.9))
    assert profile.exact_quantiles(df.limit(0), "x", [0.5], ("g",)).count() == 0
    assert profile.exact_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_only_the_brackets_are_put_in_order(spark):
    df = spark.range(200000).select(((F.col("id") * 7919) % 200003).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    out = profile.exact_quantiles(df, "x", [0.5], ("g",), accuracy=1000)
    counted = [r for r in out.collect()]
    assert len(counted) == 2
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (") == 2  # the input twice


@pytest.mark.parametrize("wide", [False, True])
def test_a_large_group_meets_its_brackets_in_many_tasks(spark, monkeypatch, wide):
    """Where the brackets are not broadcast, rows of one group used to be sorted by one task."""
    df = spark.range(60000).select(((F.col("id") * 7919) % 60013).cast("double").alias("x"), F.when(F.col("id") < 0, "b").otherwise("a").alias("g"))
    values = np.arange(60000) * 7919 % 60013
    joined, join = [], profile.join_groups
    monkeypatch.setattr(profile, "join_groups", lambda *a: joined.append(join(*a)) or joined[-1])
    monkeypatch.setattr(profile, "ACCURACY", 1000)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        if wide:
            (row,) = profile.describe(df, ["x"], {"q": 0.3}).collect()
            assert row.n == 60000
        else:
            (row,) = profile.exact_quantiles(df, "x", [0.3], ("g",), accuracy=1000).collect()
        assert abs(row.q - np.quantile(values, 0.3)) < 1e-9
        per_task = [r["count"] for r in joined[0].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 60000 and max(per_task) < 20000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_outliers_of_all_columns_in_one_pass(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=800), rng.lognormal(size=800)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, 3.0, None)], "a double, b double, c double")
    got = {r.column_name: r for r in profile.iqr_outliers(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"}
    for name, values in (("a", a), ("b", np.append(b, 3.0))):
        q1, q3 = np.quantile(values, [0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        assert abs(got[name].q1 - q1) < 1e-9 and got[name].n_outliers == int(((values < q1 - reach) | (values > q3 + reach)).sum())


def test_one_row_per_key_needs_no_sort(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") % 50).alias("ts"), F.col("id").alias("event_id"), (F.col("id") / 3).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"),
    )
    for pick, last in ((dedupe.keep_last, True), (dedupe.keep_first, False)):
        out = pick(df, ["k"], ["ts", "event_id"])
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        rows = {}
        for r in sorted(df.collect(), key=lambda r: (r.ts, r.event_id), reverse=not last):
            rows[r.k] = tuple(r)
        assert {r.k: tuple(r) for r in out.collect()} == rows


def test_order_keys_sort_like_the_columns(spark):
    at = [None, "0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    ids = [None, -(2**63) + 1, -1, 0, 5, 2**63 - 1]
    rows = [(t, i) for t in at for i in ids]
    df = spark.createDataFrame(rows, "t string, i long").select(F.col("t").cast("timestamp").alias("ts"), "i")
    keyed = df.withColumn("o", dedupe._order_key(df, ["ts", "i"]))
    text = [F.col("ts").cast("string").alias("ts"), "i"]
    plain = df.orderBy(F.asc_nulls_first("ts"), F.asc_nulls_first("i")).select(*text).collect()
    assert keyed.orderBy("o").select(*text).collect() == plain
