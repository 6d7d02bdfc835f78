from datetime import date

from pyspark.sql import functions as F

from gridhour.functions import energy, labels, numbers
from gridhour.operators import resample
from gridhour.registry import GENERATION_CODES


def readings(spark, rows, schema="t string, v double"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_power_averages_and_energy_sums(spark):
    rows = [(f"2024-01-01 10:{m}:00", "load", 100.0) for m in ("00", "15", "30", "45")]
    rows += [(f"2024-01-01 10:{m}:00", "flow", 25.0) for m in ("00", "15", "30", "45")]
    df = readings(spark, rows, "t string, s string, v double")
    got = {r.s: r.v for r in resample.to_hour_by_unit(df, "ts", "s", "v", {"flow"}).collect()}
    assert got == {"load": 100.0, "flow": 100.0}


def test_hour_with_three_of_four_quarters_is_rejected(spark):
    rows = [(f"2024-01-01 {h:02d}:{m}:00", 10.0 * h) for h in (1, 2, 3) for m in ("00", "15", "30", "45")]
    rows.remove(("2024-01-01 02:45:00", 20.0))
    got = resample.modal_complete_hours(readings(spark, rows), "ts", "v").collect()
    assert sorted(r.ts.hour for r in got) == [1, 3]


def test_smallest_count_wins_a_tie_of_counts(spark):
    rows = [("2024-01-01 01:00:00", 1.0), ("2024-01-01 02:00:00", 2.0), ("2024-01-01 02:30:00", 4.0)]
    assert [r.ts.hour for r in resample.modal_complete_hours(readings(spark, rows), "ts", "v").collect()] == [1]


def test_local_day_uses_all_sub_hour_readings(spark):
    rows = [(f"2024-06-30 22:{m}:00", v) for m, v in (("00", 0.0), ("15", 10.0), ("30", 20.0), ("45", 30.0))]
    rows.append(("2024-06-30 21:45:00", 99.0))
    got = resample.hourly_on_local_day(readings(spark, rows), "ts", {"v": "avg"}, date(2024, 7, 1)).collect()
    assert [(r.ts.hour, r.v) for r in got] == [(22, 15.0)]


def test_codes_of_a_column_add_up_and_null_counts_as_zero(spark):
    rows = [("2024-01-01 00:00:00", "Wind Onshore|Actual Aggregated", 5.0), ("2024-01-01 00:00:00", "Wind Offshore|Actual Aggregated", None),
            ("2024-01-01 00:00:00", "Fusion|Actual Aggregated", 1.0)]
    df = readings(spark, rows, "t string, code string, v double")
    row = resample.map_codes(df, ["ts"], "code", "v", GENERATION_CODES).first()
    assert row.wind_mw == 5.0 and row.solar_mw is None
    lost = resample.unmapped_codes(df, "code", GENERATION_CODES).collect()
    assert [(r.code, r.n_rows) for r in lost] == [("Fusion|Actual Aggregated", 1)]


def test_null_rules_of_derived_columns(spark):
    df = spark.createDataFrame([(5.0, 2.0), (2.0, 5.0), (None, 1.0), (3.0, None), (None, None)], "a double, b double")
    got = df.select(
        energy.clean_pv(F.col("a"), F.col("b")).alias("pv"),
        energy.dispatchable_hydro(F.col("a"), F.col("b")).alias("hydro"),
        energy.net_flow(F.col("a"), F.col("b")).alias("net"),
        energy.imports(F.col("a") - 4).alias("imp"),
        numbers.sum_null_as_zero(["a", "b"]).alias("s0"),
        numbers.sum_if_any(["a", "b"]).alias("s1"),
        numbers.row_mean(["a", "b"]).alias("m"),
    ).collect()
    assert [r.pv for r in got] == [3.0, 0.0, None, None, None]
    assert [r.hydro for r in got] == [7.0, 7.0, None, 3.0, None]
    assert [r.net for r in got] == [7.0, 7.0, None, None, None]
    assert [r.imp for r in got] == [1.0, 0.0, None, 0.0, None]
    assert [r.s0 for r in got] == [7.0, 7.0, 1.0, 3.0, 0.0]
    assert [r.s1 for r in got] == [7.0, 7.0, 1.0, 3.0, None]
    assert [r.m for r in got] == [3.5, 3.5, 1.0, 3.0, None]


def test_rounding_of_ties_and_ranges(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-0.125,), (7000.0,)], "v double")
    got = df.select(
        numbers.half_up(F.col("v")).alias("up"), numbers.half_even(F.col("v")).alias("even"), numbers.within(F.col("v"), -1000, 6000).alias("w")
    ).collect()
    assert [r.up for r in got] == [0.13, 2.68, -0.13, 7000.0]
    assert [r.even for r in got] == [0.12, 2.68, -0.12, 7000.0]
    assert got[3].w is None


def test_numbers_in_two_notations(spark):
    texts = ["1.234,56", "12,5", " 12.5 ", "1,234.5", "", "n/a", "12 EUR", "-3,25", None, "1-2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.n is None else float(r.n) for r in df.select(numbers.number_from_text(F.col("t")).alias("n")).collect()]
    assert got == [1234.56, 12.5, 12.5, 1.2345, None, None, None, -3.25, None, None]


def test_header_labels_and_names(spark):
    df = spark.createDataFrame([("H23Q1",), ("7",), ("H24",), ("x",)], "t string")
    got = df.select(labels.header_hour(F.col("t")).alias("h"), labels.header_quarter(F.col("t")).alias("q")).collect()
    assert [(r.h, r.q) for r in got] == [(23, 1), (7, None), (None, None), (None, None)]
    names = spark.createDataFrame([("de_lu_entsoe",), ("es_omie",), ("other",), ("_esios",)], "t string")
    got = names.select(labels.price_zone(F.col("t")).alias("z"), labels.price_source(F.col("t")).alias("s")).collect()
    assert [(r.z, r.s) for r in got] == [("DE_LU", "entsoe"), ("ES", "omie"), (None, None), (None, None)]


def test_contract_labels(spark):
    texts = ["Dic-26", "Ene-05", "Foo-26", "Dic26", "Dic-x", "Dic-26-1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.d is None else r.d.isoformat() for r in df.select(labels.contract_delivery(F.col("t")).alias("d")).collect()]
    assert got == ["2026-12-01", "2005-01-01", None, None, None, None, None]
