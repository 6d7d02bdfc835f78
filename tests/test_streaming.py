from pyspark.sql import functions as F

from gridhour.operators import merge
from gridhour.streaming import feeds


def land(spark, path, rows, n):
    df = spark.createDataFrame(rows, "id int, t string, s string, v double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_hours_are_updated_by_late_readings_over_several_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    aggs = [F.avg("v").alias("v"), F.count("*").alias("n")]
    schema = land(spark, src, [(1, "2024-01-01 10:05:00", "a", 1.0), (2, "2024-01-02 10:05:00", "a", 5.0)], 1)

    def run():
        stream = feeds.hourly_stream(feeds.read_landed(spark, src, schema, max_files=1), "ts", "s", aggs)
        feeds.drain(feeds.start_versions(stream, out, state))

    run()
    land(spark, src, [(3, "2024-01-01 10:45:00", "a", 3.0)], 2)
    run()
    got = {r.ts.isoformat(): (r.v, r.n) for r in feeds.latest(spark, out, ["ts", "s"]).collect()}
    assert got == {"2024-01-01T10:00:00": (2.0, 2), "2024-01-02T10:00:00": (5.0, 1)}


def test_trade_ids_are_kept_once_across_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 1.0)]
    schema = land(spark, src, rows, 1)
    land(spark, src, [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-01 11:00:00", "a", 2.0)], 2)
    stream = feeds.dedupe_stream(feeds.read_landed(spark, src, schema, max_files=1), "ts", "id")
    feeds.drain(feeds.start_versions(stream, out, state, "append"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_batches_fill_gaps_of_the_stored_table(spark, tmp_path):
    src, path, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    schema = land(spark, src, [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-01 10:00:00", "a", 2.0)], 1)
    shaped = lambda df: df.select("ts", "id", F.col("v").alias("a"), F.date_format("ts", "yyyy-MM").alias("month"))
    stored = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, CAST(NULL AS DOUBLE) AS a, '2024-01' AS month UNION ALL SELECT timestamp'2024-01-01 11:00:00', 9.0D, '2024-01'")
    merge.merge_into_parquet(spark, path, stored, ["ts"], merge.UPSERT, "month")
    stream = shaped(feeds.read_landed(spark, src, schema))
    feeds.drain(feeds.start_merge(stream, path, ["ts"], ["id"], merge.FILL_NULL, state))
    assert {r.ts.hour: r.a for r in spark.read.parquet(path).collect()} == {10: 2.0, 11: 9.0}


def test_closed_days_raise_an_alert_only_after_the_watermark(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = [(i, f"2024-01-02 {i:02d}:30:00", "a", 1.0) for i in range(20)] + [(99, "2024-01-05 00:00:00", "a", 1.0)]
    schema = land(spark, src, rows, 1)
    feeds.drain(feeds.start_versions(feeds.closed_days(feeds.read_landed(spark, src, schema), "ts", "s"), out, state, "append"))
    got = [(r.day.isoformat(), r.n_hours, r.n_expected, r.alert) for r in spark.read.parquet(out).collect()]
    assert got == [("2024-01-02", 20, 24, True)]


def test_revised_days_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [(d, f"2024-01-{d:02d} 10:00:00", "a", 5.0) for d in (1, 10, 20)]
    shaped = lambda df: df.select("ts", "id", F.col("v").alias("a"), F.date_format("ts", "yyyy-MM").alias("month"))
    results = []
    for name, parts in (("one", [rows]), ("many", [[r] for r in rows])):
        src, path, state = (str(tmp_path / f"{name}-{n}") for n in ("src", "table", "state"))
        stored = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 0.0D AS a, '2024-01' AS month")
        merge.merge_into_parquet(spark, path, stored, ["ts"], merge.UPSERT, "month")
        for i, part in enumerate(parts):
            schema = land(spark, src, part, i)
            q = feeds.start_merge(shaped(feeds.read_landed(spark, src, schema)), path, ["ts"], ["id"], merge.OVERWRITE_DIFFERENT, state, last_days=3, run_day="2024-01-20")
            feeds.drain(q)
        results.append({r.ts.day: r.a for r in spark.read.parquet(path).collect()})
    assert results[0] == results[1] == {1: 0.0, 20: 5.0}


def test_gaps_of_any_age_are_filled_unless_a_review_window_is_given(spark, tmp_path):
    from gridhour.queries import catalog

    # even users stored hours without a view, odd users bring one of each hour, the oldest two months late
    hours = ["2024-01-01 10", "2024-02-20 10", "2024-03-01 10"]
    rows = [(10 * n + u, f"{h}:05:00", u, kind, float(n), "{}") for n, h in enumerate(hours) for u, kind in ((2, "click"), (3, "view"))]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.REGISTRY["stream_late_fill"].build(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(f"{h}:00:00", float(n)) for n, h in enumerate(hours)]

    cells = df.select(F.col("t").cast("timestamp").alias("ts"))
    assert feeds.reviewed(cells, str(tmp_path / "none"), "ts", 14).distinct().count() == 2
