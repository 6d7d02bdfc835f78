"""Feed loads: prices, load and flows, programme, capacity, commodities, weather."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock, energy
from gridhour.functions.numbers import half_up, sum_if_any, within
from gridhour.operators import align, dedupe, futures, joins, merge, quality, resample
from gridhour.operators import weather as wx
from gridhour.sources import indicators, market_files, trades
from gridhour.sources.tables import discover_prices

log = logging.getLogger(__name__)

#: Unmapped codes that a load names in its warnings, the most frequent first.
UNMAPPED_SHOWN = 50


# Prices --------------------------------------------------------------------------------


def sane_price(c: Column) -> Column:
    return within(half_up(c, 2), *reg.PRICE_RANGE)


def spot_prices(files: DataFrame, readings: DataFrame, zones: DataFrame, expected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hourly prices of three sources: the market-file columns, and the others in long form.

    ``files``: market files (file, text); of several versions of a delivery day the greatest
    name counts, and ``expected`` names a column with the day a file must be for. ``readings``: (ts, column_name, value) sub-hour
    prices of the indicator feed. ``zones``: the same for the exchange feed, where hours
    with fewer readings than usual are dropped rather than averaged.
    """
    omie = market_files.hourly_prices(market_files.newest_versions(market_files.parse(files, expected=expected))).select(
        "ts", sane_price(F.col("es_omie")).cast("double").alias("es_omie"), sane_price(F.col("pt_omie")).cast("double").alias("pt_omie")
    )
    hourly = readings.groupBy("column_name", clock.hour_floor(F.col("ts")).alias("ts")).agg(F.avg("value").alias("value"))
    full = resample.modal_complete_hours(zones, "ts", "value", ("column_name",))
    long = hourly.unionByName(full.select("column_name", "ts", "value")).withColumn("value", sane_price(F.col("value")))
    return omie, long.where(F.col("value").isNotNull())


def spot_price_load(
    stored: DataFrame, files: DataFrame, readings: DataFrame, zones: DataFrame, expected: str | None = None
) -> DataFrame:
    """Price table after loading the three sources into the price columns it has.

    Price columns are discovered by their names, zone and source. Each source changes its own
    columns and only where it has a value: an hour or a column that was not delivered keeps what
    is stored, and so does every column that is no price, numbers included.
    """
    prices = discover_prices(stored, "ts")[0]
    omie, long = spot_prices(files, readings, zones, expected)
    landed = [c for c in ("es_omie", "pt_omie") if c in prices]
    others = [c for c in prices if c not in landed]
    blocks = [omie.select("ts", *landed)] if landed else []
    blocks += [resample.sparse_to_wide(long, ["ts"], "column_name", "value", others)] if others else []
    if not blocks:
        return stored
    fresh = joins.outer_blocks(blocks, "ts").dropna(how="all", subset=prices)
    return merge.merge_frames(stored, fresh, ["ts"], merge.PREFER_FRESH)


def price_quality(prices: DataFrame) -> DataFrame:
    """Day verdict of the price table: the prices of the own zone must be whole, the others
    are context."""
    cols = [c for c in prices.columns if c != "ts"]
    critical = {c: 0 for c in reg.CRITICAL_PRICES if c in cols}
    return quality.policy_status(prices, "ts", cols, critical, {c for c in cols if c not in critical})


# Generation -----------------------------------------------------------------------------


def generation_frame(readings: DataFrame, codes: dict[str, list[str]] = reg.GENERATION_CODES) -> DataFrame:
    """Sub-hour (ts, code, value) readings to hourly power per canonical column: codes add up
    first, then the hour averages."""
    wide = resample.map_codes(readings, ["ts"], "code", "value", codes)
    hourly = resample.to_hour(wide, "ts", {c: "avg" for c in codes})
    return hourly.select("ts", *[half_up(F.col(c), 2).alias(c) for c in codes])


def generation_load(stored: DataFrame, readings: DataFrame, codes: dict[str, list[str]] = reg.GENERATION_CODES, guard: bool = True) -> DataFrame:
    """Generation table after a load: new hours inserted, gaps of stored hours filled.

    ``guard`` first counts the codes that no column takes and warns of each: a new code would
    otherwise vanish from the totals without a trace. It reads the codes once more.
    """
    if guard:
        for r in resample.unmapped_codes(readings, "code", codes).orderBy(F.desc("n_rows"), "code").limit(UNMAPPED_SHOWN).collect():
            log.warning("%d readings have the code %r, which no column takes", r["n_rows"], r["code"])
    return merge.merge_frames(stored, generation_frame(readings, codes), ["ts"], merge.FILL_NULL)


def generation_quality(generation: DataFrame) -> DataFrame:
    cols = [c for c in reg.GENERATION_CODES if c in generation.columns]
    policy = reg.GENERATION_POLICY
    return quality.policy_status(generation, "ts", cols, dict(policy.critical), set(policy.sporadic))


# Load and interconnection ---------------------------------------------------------------


def load_frame(readings: DataFrame, columns: tuple[str, ...] = reg.LOAD_COLUMNS, summed=reg.LOAD_SUMMED) -> DataFrame:
    """Sub-hour (ts, column_name, value) readings to the hourly wide frame: balances sum,
    power averages."""
    hourly = resample.to_hour_by_unit(readings, "ts", "column_name", "value", set(summed))
    return resample.sparse_to_wide(hourly, ["ts"], "column_name", "value", list(columns))


def with_generated(load: DataFrame) -> DataFrame:
    """Columns the table generates: total net flow and peninsular generation, NULL included."""
    net = energy.net_flow(F.col("ree_netflow_fr"), F.col("ree_netflow_pt"), F.col("ree_netflow_ma"))
    return load.withColumns(
        {"total_net_flow_mw": net, "gen_peninsular_mw": energy.generation_from_load(F.col("ree_load"), net)}
    )


def load_inter_load(stored: DataFrame, readings: DataFrame, recompute: bool = False) -> DataFrame:
    """Stored hours with their gaps filled; ``recompute`` overwrites them instead."""
    policy = merge.PREFER_FRESH if recompute else merge.FILL_NULL
    return with_generated(merge.merge_frames(stored, load_frame(readings), ["ts"], policy))


def programme_load(
    stored: DataFrame, readings: DataFrame, columns: tuple[str, ...], overwrite: bool = False, tol: float = 0.01
) -> DataFrame:
    """Programme table (MWh, so sums); firm data fills gaps, ``overwrite`` also corrects."""
    fresh = load_frame(readings, columns, columns)
    return merge.merge_frames(stored, fresh, ["ts"], merge.OVERWRITE_DIFFERENT if overwrite else merge.FILL_NULL, tol)


def without_bilateral(programme: DataFrame, bilateral: DataFrame, pairs: dict[str, str], ts: str = "ts") -> DataFrame:
    """Market part of the programme: programme minus bilateral contracts."""
    both = joins.pair_on_key(programme, bilateral, [ts])
    return both.select(ts, *[(F.col(p) - F.col(b)).alias(f"pdbc_{p}") for p, b in pairs.items()])


# Capacity -------------------------------------------------------------------------------


def capacity_daily(stored: DataFrame, readings: DataFrame) -> DataFrame:
    """Daily available capacity: mean power of the peninsula, two coal types in one column."""
    mine = indicators.peninsular(readings)
    daily = mine.groupBy(F.col("day").alias("date"), "column_name").agg(half_up(F.avg("value"), 2).alias("value"))
    raw = resample.sparse_to_wide(
        daily, ["date"], "column_name", "value",
        ["hydro_mw", "pump_mw", "nuclear_mw", "coal_antracita_mw", "coal_subbituminosa_mw", "ccgt_mw", "fuel_mw"],
    )
    coal = half_up(sum_if_any(["coal_antracita_mw", "coal_subbituminosa_mw"]), 2)
    fresh = raw.withColumn("coal_mw", coal).select("date", *reg.CAPACITY_COLUMNS)
    return merge.merge_frames(stored, fresh, ["date"], merge.PREFER_FRESH)


def capacity_monthly(stored: DataFrame, monthly: DataFrame, today: Column) -> DataFrame:
    """Monthly installed capacity on each day up to today; months being settled are redone."""
    redo = monthly.where(F.array_contains(merge.months_to_rewrite(today), F.trunc("month", "month")))
    fresh = align.expand_month(redo, "month", today, "date")
    return merge.merge_frames(stored, fresh, ["date"], merge.PREFER_FRESH)


def capacity_snapshot(stored: DataFrame, readings: DataFrame) -> DataFrame:
    """Bitemporal table after a capture: the same capture again overwrites itself."""
    mine = indicators.peninsular(readings, allow_missing=True)
    daily = mine.groupBy("run_date", "target_date", "column_name").agg(half_up(F.avg("value"), 2).alias("value"))
    fresh = resample.sparse_to_wide(
        daily, ["run_date", "target_date"], "column_name", "value", list(reg.SNAPSHOT_COLUMNS)
    )
    return merge.merge_frames(stored, fresh, ["run_date", "target_date"], merge.UPSERT)


def capacity_features(snapshots: DataFrame, cols: list[str]) -> DataFrame:
    """Per target day: capacity as known the day before, and its revision over six days."""
    level = joins.as_known_before(snapshots).select("target_date", *[F.col(c).alias(f"known_{c}") for c in cols])
    return level.join(joins.snapshot_revision(snapshots, cols), "target_date", "left")


# Commodities ----------------------------------------------------------------------------


def trades_to_bars(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Clean trades, one per id, into daily bars. With a stored log, ids already there win."""
    log = dedupe.keep_last(trades.clean(raw), ["trade_id"], ["deal_date", "precio", "cantidad"])
    if stored is not None:
        log = merge.merge_frames(stored, log, ["trade_id"], merge.INSERT_IGNORE)
    return futures.daily_bars(log)


def continuous_futures(bars: DataFrame, commodities: DataFrame, since: str | None = None) -> DataFrame:
    """Commodity table with the front series written into existing days only."""
    series = futures.front_series(bars, reg.FRONT_RULES)
    if since:
        series = series.where(F.col("fecha") >= F.lit(since).cast("date"))
    cells = [
        F.max(F.when(F.col("commodity") == k, F.col("precio").cast("double"))).alias(c)
        for k, c in reg.FRONT_TARGETS.items()
    ]
    return merge.merge_frames(commodities, series.groupBy("fecha").agg(*cells), ["fecha"], merge.UPDATE_ONLY)


def commodities_load(stored: DataFrame, closes: list[DataFrame], gas: DataFrame, co2: DataFrame, until: Column) -> DataFrame:
    """Daily commodity table: new days inserted, gaps filled; the monthly CO2 level is
    expanded to days and always overwrites."""
    fresh = joins.outer_blocks([*closes, gas], "fecha")
    table = merge.merge_frames(stored, fresh, ["fecha"], merge.FILL_NULL)
    steps = align.expand_steps(co2, "fecha", until)
    return merge.merge_frames(table, steps.withColumn("co2_ets", half_up(F.col("co2_ets"), 4)), ["fecha"], merge.UPSERT)


# Weather --------------------------------------------------------------------------------


def reanalysis_aggregate(grid: DataFrame, version: str | None = None) -> DataFrame:
    """Grid cells to one row per instant; hourly totals become W/m2 and mm.

    ``version`` names a column whose least value is the final version: of several rows of a cell
    and instant each field comes from the best version that has it, before anything is averaged.
    """
    if version is not None:
        grid = dedupe.combine_versions(grid, ["ts", "lat", "lon"], version, [c for c in grid.columns if c not in ("ts", "lat", "lon", version)])
    g = wx.with_wind(wx.with_wind(wx.crop(grid, **_box()), "10"), "100")
    g = g.withColumns({"ssrd": energy.joules_to_watts(F.col("ssrd")), "tp": energy.metres_to_mm(F.col("tp"))})
    return wx.position_in_month(wx.spatial_mean(g, _mean_columns(), ["ts"]), "ts")


def forecast_aggregate(grid: DataFrame, seconds: float = 10800.0) -> DataFrame:
    """Forecast steps of each run: running totals to rates, then the spatial mean."""
    g = wx.with_wind(wx.with_wind(wx.crop(grid, **_box()), "10"), "100")
    rates = wx.deaccumulate(g, ["ssrd", "tp"], seconds)
    rates = rates.withColumn("tp", energy.metres_to_mm(F.col("tp") * F.lit(seconds)))
    return wx.spatial_mean(rates, _mean_columns(), ["run_date", "valid_time"]).withColumnRenamed("valid_time", "ts")


def _box() -> dict:
    return {"lat": reg.GRID_BOX["lat"], "lon": reg.GRID_BOX["lon"]}


def _mean_columns() -> list[str]:
    return [c.removesuffix("_mean") for c in reg.WEATHER_COLUMNS]


# Recompute ------------------------------------------------------------------------------


def backfill(stored: DataFrame, fresh: DataFrame, keys: list[str], cols: list[str], tol: float = 0.01, control: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows corrected where the recomputed value differs; no rows are added.

    Control columns are only compared, in :func:`backfill_report`: the error never touched them,
    so a difference there tells that the recomputation is wrong, and they keep what is stored.
    """
    rounded = fresh.select(*keys, *[half_up(F.col(c), 2).alias(c) for c in cols if c not in control])
    return merge.merge_frames(stored, rounded, keys, merge.OVERWRITE_DIFFERENT, tol, insert=False)


def backfill_report(
    stored: DataFrame, fresh: DataFrame, keys: list[str], cols: list[str], control: tuple[str, ...], tol: float = 0.01
) -> DataFrame:
    """Corrections per column, and the fresh rows that have no stored row."""
    counts = merge.change_counts(stored, fresh, keys, cols, tol, control)
    lost = joins.orphans(fresh, stored, keys).agg(F.count("*").alias("n_changed"))
    return counts.unionByName(
        lost.select(F.lit("(no stored row)").alias("column_name"), "n_changed", F.lit(False).alias("is_control"))
    )


def load_quality(load: DataFrame) -> DataFrame:
    return quality.policy_status(
        load, "ts", list(reg.LOAD_COLUMNS), dict(reg.LOAD_POLICY.critical), set(reg.LOAD_POLICY.sporadic)
    )
