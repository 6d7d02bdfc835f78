import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gridhour.operators import intervals, joins

START = datetime(2023, 11, 20)


def hours(spark, seed=1, n=24 * 120, keep=0.6):
    rng = random.Random(seed)
    rows, on = [], True
    for i in range(n):
        on = on if rng.random() < 0.95 else not on
        # whole months without a row, and one column that stops for longer
        if on and not 24 * 45 < i < 24 * 80 and rng.random() < 0.97:
            rows.append((START + timedelta(hours=i), 1.0 if rng.random() < keep or i < 50 else None, None if i > 24 * 30 else 2.0, None))
    return spark.createDataFrame(rows, "ts timestamp, a double, b double, never double")


def plain(rows, cols, low, high):
    out = set()
    for c in cols:
        have, t = {r.ts for r in rows if r[c] is not None}, low
        while t <= high:
            if t not in have:
                end = t
                while end + timedelta(hours=1) <= high and end + timedelta(hours=1) not in have:
                    end += timedelta(hours=1)
                out.add((c, t, end, int((end - t).total_seconds() // 3600) + 1))
                t = end
            t += timedelta(hours=1)
    return out


def test_intervals_are_the_maximal_runs_of_missing_hours(spark):
    df = hours(spark)
    rows = df.collect()
    low, high = min(r.ts for r in rows), max(r.ts for r in rows)
    got = intervals.missing_intervals(df, "ts", ["a", "b", "never"]).collect()
    assert {tuple(r) for r in got} == plain(rows, ["a", "b", "never"], low, high) and len(got) > 100
    wide = (datetime(2023, 12, 5, 3), datetime(2024, 5, 1))
    got = intervals.missing_intervals(df, "ts", ["a", "b"], F.lit("2023-12-05 03:00:00"), F.lit("2024-05-01 00:00:00")).collect()
    assert {tuple(r) for r in got} == plain(rows, ["a", "b"], *wide)


def test_expanded_intervals_equal_the_anti_join(spark):
    df = hours(spark, 2)
    bounds = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    expected = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    anti = joins.missing_keys(expected, df.where("a IS NOT NULL"), ["ts"])
    got = intervals.expanded(intervals.missing_intervals(df, "ts", ["a"])).select("ts")
    assert sorted(got.collect()) == sorted(anti.collect())


def test_keys_nulls_and_empty_tables(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("x", t(0), 1.0), ("x", t(3), 1.0), (None, t(5), 1.0), (None, t(5), 2.0), (None, t(8), None), ("y", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = {tuple(r) for r in intervals.missing_intervals(df, "ts", ["v"], keys=("k",)).collect()}
    assert got == {("x", "v", t(1), t(2), 2), (None, "v", t(6), t(8), 3)}
    assert intervals.missing_intervals(df.limit(0), "ts", ["v"]).collect() == []


def test_levels_equal_explode_and_join(spark):
    rng = random.Random(3)
    days = sorted(rng.sample(range(700), 40))
    steps = [(k, date(2022, 6, 1) + timedelta(days=d), None if rng.random() < 0.1 else float(d)) for d in days for k in ("a", None)]
    points = [(k, datetime(2022, 5, 1) + timedelta(minutes=17 * i)) for i in range(0, 60000, 37) for k in ("a", None, "z")]
    s = spark.createDataFrame(steps, "k string, d date, v double")
    p = spark.createDataFrame(points, "k string, ts timestamp")
    got = {(r.k, r.ts): r.v for r in intervals.level_at(p, "ts", s, "d", "v", ("k",)).collect()}
    want = {}
    for k, ts in points:
        before = [(d, v) for kk, d, v in steps if kk == k and v is not None and datetime(d.year, d.month, d.day) <= ts]
        want[k, ts] = max(before)[1] if before else None
    assert got == want and len(got) == len(points)


def test_levels_make_no_row_a_day(spark):
    s = spark.createDataFrame([(date(2000, 1, 1), 1.0), (date(2020, 1, 1), 2.0)], "d date, v double")
    spans = intervals.step_intervals(s, "d", "v").collect()
    assert [(r["_from"].year, r["_until"] and r["_until"].year, r.v) for r in sorted(spans)] == [(2000, 2020, 1.0), (2020, None, 2.0)]
