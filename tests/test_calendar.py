from datetime import date

from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.operators import align, calendar, quality, resample


def days(spark, *texts):
    return spark.createDataFrame([(date.fromisoformat(t),) for t in texts], "day date")


def test_local_days_have_23_24_or_25_hours(spark):
    d = days(spark, "2024-03-31", "2024-06-12", "2024-10-27")
    got = {r.day.isoformat(): r.n for r in d.select("day", clock.day_length(F.col("day")).alias("n")).collect()}
    assert got == {"2024-03-31": 23, "2024-06-12": 24, "2024-10-27": 25}
    hours = calendar.expected_hours(d).groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("u"))
    assert {r.day.isoformat(): (r.n, r.u) for r in hours.collect()} == {
        "2024-03-31": (23, 23), "2024-06-12": (24, 24), "2024-10-27": (25, 25),
    }


def test_calendar_range_has_only_clock_change_days_and_edges(spark):
    bounds = calendar.fixed_bounds(spark, "2020-01-01 00:00:00", "2026-08-15 23:00:00")
    cal = calendar.hourly_calendar(bounds)
    assert cal.count() == 58056
    odd = {r.date_local.isoformat(): r.n_hours for r in calendar.atypical_days(cal).collect()}
    # Seven spring and six autumn changes (October 2026 lies outside), and the two edges.
    assert len(odd) == 15
    assert odd["2024-03-31"] == 23 and odd["2024-10-27"] == 25
    assert odd["2020-01-01"] == 23 and odd["2026-08-16"] == 2


def test_local_day_bounds_follow_the_season():
    start, end = clock.local_day_bounds(date(2024, 7, 1))
    assert (start.isoformat(), end.isoformat()) == ("2024-06-30T22:00:00", "2024-07-01T22:00:00")
    start, end = clock.local_day_bounds(date(2024, 10, 27))
    assert (end - start).total_seconds() == 25 * 3600


def test_filter_of_local_day_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp'2024-01-15 10:00:00' AS ts, 1.0D AS v").write.parquet(path)
    plan = resample.on_local_day(spark.read.parquet(path), "ts", date(2024, 1, 15))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_autumn_day_keeps_the_first_of_two_hours(spark):
    cal = calendar.expected_hours(days(spark, "2024-10-27", "2024-03-31"))
    priced = cal.withColumn("p", F.unix_timestamp("ts").cast("double"))
    wide = {r.fecha.isoformat(): r for r in align.pivot_hours(priced, "ts", "p").collect()}
    autumn, spring = wide["2024-10-27"], wide["2024-03-31"]
    assert autumn.price_h02 - autumn.price_h01 == 3600
    assert autumn.price_h03 - autumn.price_h02 == 7200
    assert spring.price_h02 is None and spring.price_h03 - spring.price_h01 == 3600


def test_pivot_skips_null_prices(spark):
    rows = [("2024-10-27 00:00:00", None), ("2024-10-27 01:00:00", 7.0)]
    df = spark.createDataFrame(rows, "t string, p double").select(F.col("t").cast("timestamp").alias("ts"), "p")
    assert align.pivot_hours(df, "ts", "p").first().price_h02 == 7.0


def test_target_and_lags_do_not_jump_over_missing_days(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 2.0), (date(2024, 1, 4), 4.0)], "fecha date, v double")
    target = {r.fecha.day: r.v for r in align.next_day_target(df).collect()}
    assert target == {1: 2.0, 2: None, 3: 4.0, 4: None}
    lags = {r.fecha.day: (r.v_lag1d, r.v_lag7d) for r in align.lag_block(df, {1: "lag1d", 7: "lag7d"}).collect()}
    assert lags[2] == (1.0, None) and lags[8] == (None, 1.0) and 4 not in lags


def test_25_hour_day_with_a_missing_hour_is_within_tolerance(spark):
    cal = calendar.expected_hours(days(spark, "2024-10-27")).withColumn("load", F.lit(1.0))
    holes = cal.withColumn("load", F.when(F.hour("ts") != 1, F.col("load")))
    row = quality.policy_status(holes, "ts", ["load"], {"load": 1}, set()).first()
    assert (row.n_expected, row.missing_critical, row.critical_ok) == (25, 1, True)
    strict = quality.policy_status(holes, "ts", ["load"], {"load": 0}, set()).first()
    assert not strict.critical_ok and not strict.is_complete


def test_empty_day_between_two_days_misses_all_hours(spark):
    rows = [("2024-01-01 10:00:00", 1.0), ("2024-01-03 10:00:00", 1.0)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.col("t").cast("timestamp").alias("ts"), "v")
    gaps = {r.day.day: r.n_missing for r in quality.gaps_by_column(df, "ts", ["v"]).collect()}
    assert gaps == {1: 23, 2: 24, 3: 23}
