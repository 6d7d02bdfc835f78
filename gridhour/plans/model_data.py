"""Model data: hourly exploration spine, leak-free daily dataset, chronological split."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock, energy
from gridhour.functions.numbers import zero_to_null
from gridhour.operators import align, joins
from gridhour.operators.dedupe import require_unique
from gridhour.sources.tables import between

log = logging.getLogger(__name__)

SPINE_HOURLY = (
    ("entsoe_load_inter", "_load"),
    ("esios_gen", "_esiosgen"),
    ("load_inter", "_loadinter"),
    ("esios_forecast_da", "_fcst"),
)
SPINE_DAILY = (("commodities", "fecha"), ("esios_capacity_available", "date"), ("esios_capacity_installed", "date"))


def _window(df: DataFrame, ts: str, span: tuple[str, str] | None) -> DataFrame:
    return between(df, ts, *span) if span else df


def hourly_spine(
    tables: dict[str, DataFrame],
    span: tuple[str, str] | None = None,
    day_tz: str = clock.MADRID,
    check_keys: bool = False,
) -> DataFrame:
    """Hourly tables side by side on the generation table's instants, daily facts repeated
    over their day. Pass ``day_tz="UTC"`` to attach daily facts by UTC date and ``span`` to
    keep a range of days only. A table that is not there is left out with a warning.

    ``check_keys`` runs one job that fails on a repeated instant.
    """
    for name in (*(n for n, _ in SPINE_HOURLY), *(n for n, _ in SPINE_DAILY)):
        if name not in tables:
            log.warning("table %s is missing and is left out of the hourly spine", name)
    spine = _window(tables["entsoe_gen_data"], "datetime", span).withColumnRenamed("datetime", "ts")
    for name, suffix in SPINE_HOURLY:
        if name in tables:
            other = _window(tables[name], "datetime", span).withColumnRenamed("datetime", "ts")
            spine = joins.left_with_suffix(spine, other, ["ts"], suffix)
    spine = spine.withColumn("fecha", clock.local_date(F.col("ts"), day_tz))
    for name, day in SPINE_DAILY:
        if name in tables:
            daily = _window(tables[name], day, span).withColumnRenamed(day, "fecha")
            if name == "commodities":
                daily = align.forward_fill(daily, "fecha", [c for c in daily.columns if c != "fecha"])
            spine = joins.spread_daily(spine, daily, "fecha", f"_{name}")
    return require_unique(spine, ["ts"], "hourly spine") if check_keys else spine


def _ahead(df: DataFrame, ts: str, cols: tuple[str, ...], prefix: str = "", stats=("mean", "min", "max")) -> DataFrame:
    """Statistics of a forecast day, stored on the day before it."""
    return align.daily_stats(df, ts, list(cols), stats, prefix=prefix, shift=-1)


def forecast_block(t: dict[str, DataFrame]) -> DataFrame:
    return _ahead(t["esios_forecast_da"], "datetime", reg.FORECAST_COLUMNS)


def ntc_block(t: dict[str, DataFrame]) -> DataFrame:
    return _ahead(t["load_inter"], "datetime", reg.NTC_COLUMNS)


def weather_block(t: dict[str, DataFrame]) -> DataFrame:
    kelvin = {c: energy.to_celsius(F.col(c)) for c in reg.KELVIN_COLUMNS}
    return _ahead(t["era5_weather_agg"].withColumns(kelvin), "ts", reg.WEATHER_COLUMNS)


def second_forecast_block(t: dict[str, DataFrame]) -> DataFrame:
    return _ahead(t["entsoe_forecast_da"], "datetime", reg.ENTSOE_FORECAST_COLUMNS, prefix="entsoe_")


def forecast_gap_block(t: dict[str, DataFrame]) -> DataFrame:
    """Daily mean and maximum of the gap between two independent forecasts."""
    both = joins.pair_on_key(
        t["esios_forecast_da"].select("datetime", *[a for a, _ in reg.FORECAST_PAIRS.values()]),
        t["entsoe_forecast_da"].select("datetime", *reg.ENTSOE_FORECAST_COLUMNS),
        ["datetime"],
    )
    gaps = {n: energy.disagreement(F.col(a), F.col(b)) for n, (a, b) in reg.FORECAST_PAIRS.items()}
    return _ahead(both.withColumns(gaps), "datetime", tuple(reg.FORECAST_PAIRS), stats=("mean", "max"))


def commodity_block(t: dict[str, DataFrame]) -> DataFrame:
    cols = list(reg.COMMODITY_COLUMNS)
    daily = t["commodities"].select("fecha", *[F.col(c).cast("double").alias(c) for c in cols])
    return align.forward_fill(daily, "fecha", cols)


def capacity_block(t: dict[str, DataFrame]) -> DataFrame:
    return t["esios_capacity_available"].select(
        F.col("date").alias("fecha"), F.col("total_mw").cast("double").alias("capacidad_disp_total_mw")
    )


def real_lag_block(t: dict[str, DataFrame]) -> DataFrame:
    """What really happened, one and seven days back; never the day itself."""
    load = t["load_inter"].withColumn("entsoe_load", zero_to_null(F.col("entsoe_load")))
    entsoe = t["entsoe_gen_data"].withColumn(
        "hydro_dispatch_mw", energy.dispatchable_hydro(F.col("hydro_reservoir_mw"), F.col("pumping_gen_mw"))
    )
    pv = joins.pair_on_key(
        t["entsoe_gen_data"].select("datetime", "solar_mw"), t["esios_gen"].select("datetime", "ree_gsolter_mw"), ["datetime"]
    ).select("datetime", energy.clean_pv(F.col("solar_mw"), F.col("ree_gsolter_mw")).alias("solar_fv_mw"))
    daily = joins.outer_blocks(
        [
            align.daily_stats(load, "datetime", list(reg.REAL_LOAD_COLUMNS)),
            align.daily_stats(entsoe, "datetime", [*reg.REAL_ENTSOE_COLUMNS, "hydro_dispatch_mw"]),
            align.daily_stats(t["esios_gen"], "datetime", list(reg.REAL_ESIOS_COLUMNS)),
            align.daily_stats(pv, "datetime", ["solar_fv_mw"]),
        ],
        "fecha",
    )
    return align.lag_block(daily, {1: "lag1d", 7: "lag7d"})


def price_by_hour(t: dict[str, DataFrame]) -> DataFrame:
    price = t["spot_price"].select("datetime", F.col("es_esios").cast("double").alias("es_esios"))
    return align.pivot_hours(price, "datetime", "es_esios")


def price_lag_block(by_hour: DataFrame) -> DataFrame:
    hours = [c for c in by_hour.columns if c != "fecha"]
    stats = align.row_stats(by_hour, hours, "precio_real", ["fecha"])
    return align.lag_block(stats, {1: "lag1d", 7: "lag7d"})


def neighbour_price_block(t: dict[str, DataFrame]) -> DataFrame:
    daily = align.daily_stats(t["spot_price"], "datetime", list(reg.NEIGHBOUR_PRICE_COLUMNS))
    return align.lag_block(daily, {1: "lag1d", 7: "lag7d"})


def daily_dataset(
    tables: dict[str, DataFrame],
    valid_only: bool = True,
    weather: bool = True,
    pending: bool = False,
    span: tuple[str, str] | None = None,
    places: int | None = 2,
) -> DataFrame:
    """One row per decision day D: 24 prices of D+1 and only what is known on D.

    ``span`` keeps a range of days only. Numbers are rounded half-even to ``places``; ``None`` keeps them as they are.

    Every block is reduced to one row per day in its own scan, partitioned by that day, and
    joined to the target days.
    """
    day_col = {"commodities": "fecha", "esios_capacity_available": "date", "era5_weather_agg": "ts"}
    t = {n: _window(df, day_col.get(n, "datetime"), span) for n, df in tables.items()}
    by_hour = price_by_hour(t)
    target = align.next_day_target(by_hour)
    blocks = [
        forecast_block(t),
        ntc_block(t),
        commodity_block(t),
        real_lag_block(t),
        price_lag_block(by_hour),
    ]
    if pending:
        blocks += [second_forecast_block(t), forecast_gap_block(t), capacity_block(t), neighbour_price_block(t)]
    if weather:
        blocks.append(weather_block(t))
    out = joins.attach_blocks(target, blocks, "fecha")
    calendar_cols = clock.weekday_features(F.col("fecha"))
    features = [c for b in blocks for c in b.columns if c != "fecha"]
    hours = [c for c in by_hour.columns if c != "fecha"]
    split_at = features.index("gas_mibgas") + len(reg.COMMODITY_COLUMNS)
    if valid_only:
        out = out.dropna(subset=hours)
    shown = "CAST(`{0}` AS DOUBLE) AS `{0}`" if places is None else f"bround(CAST(`{{0}}` AS DOUBLE), {places}) AS `{{0}}`"
    first, rest = features[:split_at], features[split_at:]
    return out.select(
        "fecha",
        *[F.expr(shown.format(c)) for c in hours + first],
        *calendar_cols,
        *[F.expr(shown.format(c)) for c in rest],
    )


def with_split(dataset: DataFrame, train_end: str = reg.TRAIN_END, val_end: str = reg.VAL_END) -> DataFrame:
    return dataset.withColumn("split", align.split_label(F.col("fecha"), train_end, val_end))


def split_train_val_test(dataset: DataFrame, train_end: str = reg.TRAIN_END, val_end: str = reg.VAL_END):
    """Chronological parts; never random."""
    labelled = with_split(dataset, train_end, val_end)
    return tuple(labelled.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test"))
