from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridhour.operators import align, dedupe, futures, profile, quality, weather
from gridhour.registry import FRONT_RULES

D = date(2024, 1, 1)


def test_forward_fill_over_many_buckets_equals_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [(s, D + timedelta(days=int(d)), None if rng.random() < 0.8 else float(rng.integers(100))) for s in ("a", "b", None) for d in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "s string, d date, v double")
    got = align.forward_fill(df, "d", ["v"], ("s",)).toPandas().fillna({"s": ""}).sort_values(["s", "d"]).v
    pdf = pd.DataFrame(rows, columns=["s", "d", "v"]).fillna({"s": ""}).sort_values(["s", "d"])
    want = pdf.groupby("s").v.ffill()
    assert np.array_equal(got.to_numpy(), want.to_numpy().astype(float), equal_nan=True)


def test_steps_expand_across_years(spark):
    df = spark.createDataFrame([(date(2023, 12, 1), 1.0), (date(2024, 2, 1), 2.0)], "d date, v double")
    out = align.expand_steps(df, "d", F.lit("2024-02-03").cast("date")).collect()
    assert len(out) == 65 and sum(r.v == 2.0 for r in out) == 3


def test_quantiles_equal_numpy_with_a_hot_group_and_heavy_tails(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.lognormal(3, 4, 4000), 2), "flat": np.repeat(7.0, 50), "neg": rng.normal(0, 5, 301), "one": np.array([3.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("neg", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.prob): r.q for r in profile.exact_quantiles(df, "x", probs, ("g",)).collect()}
    for g, xs in groups.items():
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(xs, p)) <= 1e-9 * max(1.0, abs(np.quantile(xs, p)))
    whole = {r.prob: r.q for r in profile.exact_quantiles(df, "x", probs).collect()}
    every = np.concatenate(list(groups.values()))
    assert all(abs(whole[p] - np.quantile(every, p)) <= 1e-9 * max(1.0, abs(np.quantile(every, p))) for p in probs)


def test_rows_without_a_group_key_are_a_group(spark):
    from gridhour.operators import resample

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, x double")
    assert {r.g: r.q for r in profile.exact_quantiles(df, "x", [0.5], ("g",)).collect()} == {"a": 2.0, None: 6.0}
    d = profile.describe(df, ["x"], {"p50": 0.5}, ("g",)).collect()
    assert {r.g: (r.n, r.p50) for r in d} == {"a": (2, 2.0), None: (2, 6.0)}
    timed = df.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert {r.g: r.x for r in resample.modal_complete_hours(timed, "ts", "x", ("g",)).collect()} == {"a": 2.0, None: 6.0}


def months(spark, values):
    return spark.createDataFrame([(date(2025, i + 1, 1), v) for i, v in enumerate(values)], "m date, v double")


def test_break_must_be_sustained(spark):
    out = profile.sustained_break(months(spark, [0.0, 400.0, 10.0, 500.0, None, 600.0]), "m", "v", 300.0).first()
    assert (out.break_month.month, out.sustained) == (4, True)
    fallback = profile.sustained_break(months(spark, [0.0, 400.0, 10.0]), "m", "v", 300.0).first()
    assert (fallback.break_month.month, fallback.sustained) == (2, False)
    assert profile.sustained_break(months(spark, [0.0, 1.0]), "m", "v", 300.0).first().break_month is None


def bars(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d), c, p, v) for d, c, p, v in rows], "fecha date, commodity string, periodo string, cierre double")


def test_front_contract_and_roll_with_and_without_overlap(spark):
    b = bars(
        spark,
        [
            ("2023-12-28", "EUA", "Dic-23", 80.0), ("2023-12-28", "EUA", "Dic-24", 84.0), ("2024-01-02", "EUA", "Dic-24", 83.0),
            ("2024-01-30", "TTF", "Feb-24", 30.0), ("2024-02-01", "TTF", "Mar-24", 31.0), ("2024-02-01", "TTF", "Feb-24", 29.0),
            ("2024-02-01", "TTF", "Bad", 1.0),
        ],
    )
    series = futures.front_series(b, FRONT_RULES)
    got = {(r.commodity, r.fecha.isoformat()): (r.periodo, r.precio) for r in series.collect()}
    assert got == {
        ("EUA", "2023-12-28"): ("Dic-23", 80.0), ("EUA", "2024-01-02"): ("Dic-24", 83.0),
        ("TTF", "2024-01-30"): ("Feb-24", 30.0), ("TTF", "2024-02-01"): ("Mar-24", 31.0),
    }
    turns = {r.commodity: (r.salto, r.prima) for r in futures.rolls(series, b).collect()}
    assert turns == {"EUA": (3.0, 4.0), "TTF": (1.0, None)}


def test_quantity_zero_or_missing_counts_as_one_in_vwap(spark):
    rows = [("t1", "2024-01-01 10:00:00", 10.0, 0), ("t2", "2024-01-01 11:00:00", 20.0, None), ("t3", "2024-01-01 12:00:00", 40.0, 2)]
    df = spark.createDataFrame(rows, "trade_id string, t string, precio double, cantidad int").select(
        "trade_id", F.col("t").cast("timestamp").alias("deal_date"), "precio", "cantidad",
        F.lit("TTF").alias("commodity"), F.lit("Feb-24").alias("periodo"), F.lit(1).alias("item_id"), F.lit(True).alias("agresor_compra"),
    )
    bar = futures.daily_bars(df).first()
    assert (bar.vwap, bar.volumen, bar.apertura, bar.cierre, bar.n_trades) == (27.5, 4, 10.0, 40.0, 3)


def test_same_instant_with_other_value_is_a_collision(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.005), (2, 5.0), (2, 6.0)], "ts int, v double")
    assert [r.ts for r in dedupe.collisions(df, ["ts"], "v", 0.01).collect()] == [2]


def test_final_version_wins_where_it_has_a_value(spark):
    df = spark.createDataFrame([(1, 5, 9.0, 8.0), (1, 1, None, 7.0)], "ts int, expver int, a double, b double")
    row = dedupe.combine_versions(df, ["ts"], "expver", ["a", "b"]).first()
    assert (row.a, row.b) == (9.0, 7.0)


def test_totals_become_rates_and_never_fall_below_zero(spark):
    rows = [("r", 40.0, 0.0, i, v) for i, v in enumerate([0.0, 10800.0, 5400.0])]
    df = spark.createDataFrame(rows, "run_date string, lat double, lon double, valid_time int, ssrd double")
    got = {r.valid_time: r.ssrd for r in weather.deaccumulate(df, ["ssrd"], 10800.0).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_crop_wraps_longitudes(spark):
    df = spark.createDataFrame([(40.0, 355.0), (40.0, 3.0), (40.0, 100.0), (50.0, 0.0)], "lat double, lon double")
    assert sorted(r.lon for r in weather.crop(df, (36.0, 44.0), (-9.5, 4.5)).collect()) == [-5.0, 3.0]


def test_constant_column_needs_more_than_100_values(spark):
    df = spark.range(101).select(F.lit(5.0).alias("c"), F.when(F.col("id") < 100, 5.0).alias("few"), F.col("id").cast("double").alias("v"))
    assert [(r.column_name, r.constant_value) for r in profile.constant_columns(df, ["c", "few", "v"]).collect()] == [("c", 5.0)]


def test_additivity_and_frozen_series(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 10.0, 6.0, None), (date(2024, 2, 1), 10.0, 6.0, 3.0)], "d date, t double, a double, b double")
    assert sorted(r.residual for r in quality.additivity(df, "t", ["a", "b"], ("b",)).collect()) == [1.0, 4.0]
    assert quality.frozen_years(df, "d", "t").first().frozen
