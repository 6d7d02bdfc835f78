"""Registered queries against their SQL twins on the smallest tables.

``GRIDHOUR_ALL=1`` runs every query; by default a selection that touches each module.
"""

import os

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
SELECTED = [
    "hourly_calendar", "dst_calendar", "hourly_mean", "modal_complete_hour", "pivot_24h", "target_d1", "lag_d1_d7",
    "ffill_by_series", "step_expand_days", "row_stats_24h", "version_priority", "bronze_union_hourly_daily",
    "missing_hours", "snapshot_revision", "merge_overwrite_tol", "merge_exact_and_margin", "merge_into_parquet_table",
    "exact_quantiles_by_group", "iqr_outliers", "sustained_break", "day_status_by_series", "pair_control_p99",
    "zone_spread", "ohlc_vwap", "front_contract", "roll_premium", "weather_grid_mean", "deaccumulate",
    "iso_json_flatten", "market_file_hours", "clean_trades", "daily_dataset_valid_days", "hourly_spine",
    "bronze_union", "generation_refresh", "load_inter_load", "spot_price_load", "commodities_load", "stream_ohlc",
    "hourly_spine_all_tables", "spot_price_all_sources", "control_six_pairs", "futures_from_trades", "diff_by_digest",
    "missing_hours_as_intervals", "step_levels_on_readings", "table_spans", "landed_documents", "stream_trades_to_bars",
    "stream_day_status",
]
KEYS = list(entry.queries()) if os.environ.get("GRIDHOUR_ALL") else SELECTED


@pytest.fixture(scope="module")
def twin():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_twin(spark, twin, key):
    ok, text = check_oracle.compare(spark, twin, SF, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert ok, text


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "price_h00" in df.columns


def test_daily_dataset_has_its_documented_columns(spark):
    df = entry.queries()["daily_dataset"](spark, SF)
    assert len(df.columns) == 1 + 261
    assert [c for c in df.columns if c.startswith("d1_")] == ["d1_dow", "d1_month", "d1_is_weekend"]


def test_bronze_union_has_56_columns(spark):
    assert len(entry.queries()["bronze_union"](spark, SF).columns) == 56


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
