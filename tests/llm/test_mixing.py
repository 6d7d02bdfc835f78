"""Mixing against targets found by re-sharing and against plain prefix sums."""

import math

import pytest
from pyspark.sql import functions as F

from gridhour.llm import mixing


def shared_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share, cut, share the rest again until no source is above its cap."""
    order = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [k for k in order if k not in fixed]
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        above = [k for k in open_ if share[k] > cap * sizes[k]]
        if not above:
            return {**fixed, **share}
        for k in above:
            fixed[k] = float(cap * sizes[k])
            left -= fixed[k]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 20, None: 5},
        {"a": 7},
        {"a": 0, "b": 0},
        {"z": 1, "é": 100000, "a": 3, "b": 9, "c": 2, "d": 50, "e": 0},
        {f"s{i}": 100 + i for i in range(20)},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (1, 2, 3), 3).collect()}
    want = shared_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_mix_takes_whole_passes_and_the_nearest_prefix(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 37) % 50, 0.2 + (i % 5) / 5) for i in range(600)]
    rows += [(7, "s3", 3, float("nan")), (7, "s3", 3, None), (None, "s1", 4, -1.0), (None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, sz long, q double").withColumn("taken", F.lit("extra"))
    out = mixing.mix(df, F.col("sz"), quality=F.col("q")).collect()
    assert len(out) == len(rows)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df, F.col("sz"), quality=F.col("q")).collect()))
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    for source, group in by.items():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert all(r["size"] * r["epochs"] <= r["taken"] <= 3 * r["size"] for r in group)
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) / 2 + 1e-6, source


def test_quality_raises_the_chance_to_be_drawn(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("sz"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("q"))
    other = spark.range(4000, 4400).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit(5).alias("sz"), F.lit(1.0).alias("q"))
    drawn = mixing.mix(df.unionAll(other), F.col("sz"), quality=F.col("q")).where("source = 's' and selected")
    even, odd = drawn.where("doc_id % 2 = 0").count(), drawn.where("doc_id % 2 = 1").count()
    assert even > 1.5 * odd > 0


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_documents(odd).collect()] == [0, 0, 0]
