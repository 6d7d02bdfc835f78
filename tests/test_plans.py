from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.operators import calendar
from gridhour.plans import bronze, feeds, model_data, reports
from gridhour.queries import surrogates as s
from gridhour.sources import schemas
from gridhour.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Hourly tables over three weeks around the autumn clock change, every column filled."""
    bounds = calendar.fixed_bounds(spark, "2024-10-14 22:00:00", "2024-11-04 22:00:00")
    hours = calendar.hourly_calendar(bounds).select(F.col("ts_utc").alias("datetime"))
    v = F.unix_timestamp("datetime") / 3600 % 977
    frames = {n: hours.select("datetime", *[(v + i).alias(c) for i, (c, _, _) in enumerate(spec)]) for n, spec in s.HOURLY_TABLES.items()}
    frames["era5_weather_agg"] = hours.where(F.hour("datetime") % 3 == 0).select(
        F.col("datetime").alias("ts"), *[(v + 280).alias(c) for c in reg.WEATHER_COLUMNS]
    )
    days = hours.select(F.to_date("datetime").alias("fecha")).distinct()
    frames["commodities"] = days.select(
        "fecha", *[F.when(F.weekday("fecha") < 5, F.dayofyear("fecha").cast("double")).alias(c) for c in reg.COMMODITY_COLUMNS]
    )
    frames["esios_capacity_available"] = days.select(F.col("fecha").alias("date"), F.lit(1.0).alias("total_mw"))
    return {n: df.cache() for n, df in frames.items()}


def test_target_is_the_next_day_and_commodities_fill_weekends(spark, tables):
    rows = {r.fecha.isoformat(): r for r in model_data.daily_dataset(tables).collect()}
    price = {r.datetime: r.es_esios for r in tables["spot_price"].collect()}
    saturday = rows["2024-10-19"]
    assert saturday.price_h00 == round(price[datetime(2024, 10, 19, 22)], 2)
    assert saturday.gas_mibgas == float(datetime(2024, 10, 18).timetuple().tm_yday)
    assert (saturday.d1_dow, saturday.d1_is_weekend) == (6, 1)
    assert "2024-10-26" in rows and len(rows["2024-10-26"].asDict()) == 262


def test_features_of_a_day_do_not_see_later_reality(spark, tables):
    """Changing what really happened from day D on changes no feature of D except the target."""
    cut = datetime(2024, 10, 24, 22)
    spoil = lambda df: df.select("datetime", *[F.when(F.col("datetime") < cut, F.col(c)).otherwise(-1e6).alias(c) for c in df.columns if c != "datetime"])
    real = ("entsoe_gen_data", "esios_gen", "spot_price")
    spoiled = {n: spoil(df) if n in real else df for n, df in tables.items()}
    load = spoiled["load_inter"]
    actual = set(reg.REAL_LOAD_COLUMNS)
    spoiled["load_inter"] = load.select("datetime", *[F.when((F.col("datetime") < cut) | F.lit(c not in actual), F.col(c)).otherwise(-1e6).alias(c) for c in load.columns if c != "datetime"])
    day = "fecha = DATE'2024-10-25'"
    pick = lambda t: model_data.daily_dataset(t).where(day).first().asDict()
    before, after = pick(tables), pick(spoiled)
    changed = {c for c in before if before[c] != after[c]}
    assert changed and all(c.startswith("price_h") for c in changed)


def test_split_borders_belong_to_the_earlier_part(spark):
    df = spark.createDataFrame([("2024-12-31",), ("2025-01-01",), ("2025-12-31",), ("2026-01-01",)], "d string").select(F.to_date("d").alias("fecha"))
    train, val, test = model_data.split_train_val_test(df)
    assert [p.count() for p in (train, val, test)] == [1, 2, 1]


def test_spine_keeps_one_row_per_instant_and_suffixes_collisions(spark, tables):
    twice = {**tables, "entsoe_load_inter": tables["entsoe_gen_data"].select("datetime", "solar_mw")}
    spine = model_data.hourly_spine(twice, check_keys=True)
    assert spine.count() == tables["entsoe_gen_data"].count() and "solar_mw_load" in spine.columns
    utc = model_data.hourly_spine(tables, day_tz="UTC").where("ts = TIMESTAMP'2024-10-19 22:00:00'").first()
    local = model_data.hourly_spine(tables).where("ts = TIMESTAMP'2024-10-19 22:00:00'").first()
    assert utc.fecha.day == 19 and local.fecha.day == 20


def test_bronze_is_extracted_read_back_and_joined_without_filling(spark, tables, tmp_path):
    root, out = str(tmp_path / "tables"), str(tmp_path / "bronze")
    for n in reg.BRONZE_TABLES:
        tables[n].withColumn("updated_at", F.lit("x")).write.parquet(f"{root}/{n}")
    names = bronze.extract_bronze(spark, root, out)
    raw = src.scan_all(spark, out, [f"{n}_raw" for n in names])
    unified = bronze.bronze_union({n: raw[f"{n}_raw"] for n in names})
    assert len(unified.columns) == 56 and unified.count() == tables["entsoe_gen_data"].count()
    assert unified.where("hour_local <> 0 AND commodities_gas_mibgas IS NOT NULL").count() == 0
    assert unified.where("hour_utc % 3 <> 0 AND era5_t2m_mean IS NOT NULL").count() == 0
    assert unified.where("hour_local = 0 AND dayofweek(date_local) = 3 AND commodities_gas_mibgas IS NULL").count() == 0
    with pytest.raises(ValueError):
        bronze.bronze_union({"esios_gen": raw["esios_gen_raw"]})


def test_refresh_of_generation_is_idempotent(spark, tables):
    gen, esios = tables["entsoe_gen_data"], tables["esios_gen"]
    full = bronze.clean_generation(gen, esios)
    old = full.where("datetime < TIMESTAMP'2024-10-30'").withColumn("ent_gwind", F.lit(-1.0))
    once = bronze.generation_refresh(gen, esios, old)
    newest = once.where("datetime > TIMESTAMP'2024-10-22 23:00:00'")
    assert newest.exceptAll(full).count() == 0 and once.where("ent_gwind = -1").count() > 0
    again = bronze.generation_refresh(gen, esios, once)
    assert again.exceptAll(once).count() == 0


def test_capture_of_the_same_day_overwrites_itself(spark):
    d = lambda n: (datetime(2024, 1, 1) + timedelta(days=n)).date()
    rows = [(d(0), d(1), "nuclear_mw", 5.0, 8741), (d(0), d(1), "ccgt_mw", 3.0, None), (d(0), d(1), "ccgt_mw", 99.0, 3)]
    readings = spark.createDataFrame(rows, "run_date date, target_date date, column_name string, value double, geo_id long")
    empty = schemas.empty_table(spark, schemas.CAPACITY_SNAPSHOT)
    first = feeds.capacity_snapshot(empty, readings)
    second = feeds.capacity_snapshot(first, readings.withColumn("value", F.col("value") + 1))
    assert [(r.nuclear_mw, r.ccgt_mw) for r in second.collect()] == [(6.0, 4.0)]


def test_load_quality_and_column_report(spark, tables):
    load = tables["load_inter"].withColumnRenamed("datetime", "ts")
    full = feeds.load_quality(load).where("is_complete").count()
    assert full == 21
    report = {r.column_name: r for r in reports.column_report(load.withColumn("c", F.lit(5.0)), ["ree_load", "c"], "t").collect()}
    assert report["c"].is_constant and not report["ree_load"].is_constant


def test_generation_codes_add_up_before_the_hour_averages(spark):
    wind = ("Wind Onshore|Actual Aggregated", "Wind Offshore|Actual Aggregated")
    rows = [(f"2024-06-01 10:{m}:00", code, v) for m, v in (("00", 10.0), ("30", 20.0)) for code in wind]
    readings = spark.createDataFrame(rows, "t string, code string, value double").select(F.col("t").cast("timestamp").alias("ts"), "code", "value")
    loaded = feeds.generation_load(schemas.empty_table(spark, "ts TIMESTAMP, wind_mw DOUBLE"), readings)
    assert [(r.wind_mw, r.solar_mw) for r in loaded.collect()] == [(30.0, None)]
    row = feeds.generation_quality(loaded).first()
    assert (row.missing_critical, row.is_complete) == (24 * 4 - 1, False)


def test_price_day_needs_its_own_zone_only(spark, tables):
    price = tables["spot_price"].select(F.col("datetime").alias("ts"), "es_esios", F.lit(None).cast("double").alias("fr_entsoe"))
    assert feeds.price_quality(price).where("is_complete").count() == 21
    cover, agree = reports.price_report(price.withColumn("es_omie", F.col("es_esios") + 1), ["es_esios", "fr_entsoe"], "es_omie", ["es_esios"])
    assert {r.column_name: r.n_values for r in cover.collect()}["fr_entsoe"] == 0
    assert agree.first().n_diff_es_esios == agree.first().n_hours


def test_forecast_grid_equals_a_plain_computation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    steps, cells = 4, [(40.0, 355.0), (41.0, 1.0), (10.0, 1.0)]
    names = ["t2m", "d2m", "u10", "v10", "u100", "v100", "wind_gust10", "ssrd", "tcc", "tp", "msl"]
    data = rng.random((steps, len(cells), len(names))) * 100
    rows = [("2024-01-01", i * 3, *cell, *map(float, data[i, j])) for i in range(steps) for j, cell in enumerate(cells)]
    grid = spark.createDataFrame(rows, "run_date string, valid_time int, lat double, lon double, " + ", ".join(f"{n} double" for n in names))
    got = {r.ts: r for r in feeds.forecast_aggregate(grid).collect()}
    assert sorted(got) == [3, 6, 9]
    inside = data[:, :2]
    ssrd = np.clip((inside[1:, :, 7] - inside[:-1, :, 7]) / 10800, 0, None).mean(axis=1)
    rain = (np.clip((inside[1:, :, 9] - inside[:-1, :, 9]) / 10800, 0, None) * 10800 * 1000).mean(axis=1)
    wind = np.hypot(inside[1:, :, 2], inside[1:, :, 3]).mean(axis=1)
    for i, ts in enumerate((3, 6, 9)):
        assert np.allclose([got[ts].ssrd_mean, got[ts].tp_mean, got[ts].wind10_mean], [ssrd[i], rain[i], wind[i]])
    run = schemas.conform(feeds.forecast_aggregate(grid), schemas.WEATHER_RUN.replace("ts TIMESTAMP", "ts INT"))
    assert run.columns[:2] == ["ts", "run_date"] and run.count() == 3


def test_audit_row(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    row = src.audit_row(spark, "load", at("2024-01-01 00:00:00"), at("2024-01-01 00:01:30"), 7, "OK").first()
    assert (row.pipeline, row.registros, row.duracion_seg) == ("load", 7, 90.0)


def test_plans_have_no_cross_joins_or_python_workers(spark):
    from gridhour.queries.catalog import REGISTRY

    for name in ("daily_dataset_valid_days", "bronze_union", "pair_control_p99", "roll_report", "market_file_hours", "snapshot_revision"):
        plan = REGISTRY[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("CartesianProduct", "NestedLoop", "Python", "Pandas")), name


def test_spine_keeps_every_year_by_default(spark):
    from gridhour.plans import model_data

    gen = spark.sql("SELECT timestamp'2019-06-01 10:00:00' AS datetime, 1.0D AS x UNION ALL SELECT timestamp'2026-09-01 10:00:00', 2.0D")
    assert model_data.hourly_spine({"entsoe_gen_data": gen}).count() == 2
    assert model_data.hourly_spine({"entsoe_gen_data": gen}, span=("2019-01-01", "2020-01-01")).count() == 1


def test_price_load_changes_only_what_a_source_delivers(spark):

    stored = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 50.0D AS es_omie, 52.0D AS es_entsoe, 1.0D AS es_esios, 'keep' AS note")
    files = spark.createDataFrame([], "file string, text string")
    reading = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'es_esios' AS column_name, 60.0D AS value")
    row = feeds.spot_price_load(stored, files, reading, reading.limit(0)).first()
    assert (row.es_omie, row.es_entsoe, row.es_esios, row.note) == (50.0, 52.0, 60.0, "keep")
    market_only = stored.select("ts", "es_omie")
    assert feeds.spot_price_load(market_only, files, reading, reading.limit(0)).first().es_omie == 50.0


def test_null_codes_are_reported_as_unmapped(spark):
    from gridhour.operators import resample

    df = spark.createDataFrame([(None,), ("b",), ("a",)], "code string")
    assert {r.code: r.n_rows for r in resample.unmapped_codes(df, "code", {"x": ["a"]}).collect()} == {None: 1, "b": 1}


def test_backfill_corrects_every_column_that_is_no_control(spark, tmp_path):
    from gridhour.queries import catalog

    rows = [(n, f"2024-01-01 {h}:10:00", u, kind, v, "{}") for n, (h, u, kind, v) in enumerate([
        ("10", 2, "view", 1.0), ("10", 2, "click", 2.0), ("10", 3, "view", 1.5), ("10", 3, "click", 7.0),
        ("11", 2, "view", 4.0), ("11", 3, "click", 3.0), ("12", 3, "click", 9.0),
    ])]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.REGISTRY["backfill_recompute"].build(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("2024-01-01 10:00:00", 1.5, 7.0), ("2024-01-01 11:00:00", 4.0, 3.0)]

    pair = [spark.createDataFrame([(1, *v)], "ts int, a double, b double") for v in ((1.0, 2.0), (1.5, 7.0))]
    assert [tuple(r) for r in feeds.backfill(*pair, ["ts"], ["a", "b"], control=("b",)).select("ts", "a", "b").collect()] == [(1, 1.5, 2.0)]
