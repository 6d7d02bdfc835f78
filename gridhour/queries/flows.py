"""Whole plans over energy-shaped views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock
from gridhour.operators import merge
from gridhour.plans import bronze, feeds, model_data
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, ldate, lhour, local, num, query, stamp, table

# Daily model dataset --------------------------------------------------------------------


def _stats(cols, prefix="") -> list[str]:
    return [f"{prefix}{c}_{st}" for c in cols for st in ("mean", "min", "max")]


def _stats_sql(cols, prefix="") -> str:
    return ", ".join(
        f"{fn}({c}) AS {prefix}{c}_{st}" for c in cols for st, fn in (("mean", "avg"), ("min", "min"), ("max", "max"))
    )


def _ahead_sql(name: str, source: str, ts: str, cols, prefix="") -> str:
    return f"{name} AS (SELECT {ldate(ts)} - 1 AS fecha, {_stats_sql(cols, prefix)} FROM {source} GROUP BY 1)"


def _lags_sql(name: str, source: str, cols: list[str]) -> str:
    parts = [
        f"{name}{k} AS (SELECT fecha + {k} AS fecha, {', '.join(f'{c} AS {c}_lag{k}d' for c in cols)} FROM {source})" for k in (1, 7)
    ]
    return ", ".join(parts)


_HOURS = [f"price_h{h:02d}" for h in range(24)]
_PIVOT = ", ".join(
    f"arg_min(es_esios, datetime) FILTER (WHERE {lhour('datetime')} = {h} AND es_esios IS NOT NULL) AS price_h{h:02d}" for h in range(24)
)
_REAL = _stats([*reg.REAL_LOAD_COLUMNS, *reg.REAL_ENTSOE_COLUMNS, "hydro_dispatch_mw", *reg.REAL_ESIOS_COLUMNS, "solar_fv_mw"])
_PRICE = ["precio_real_mean", "precio_real_min", "precio_real_max"]
_NEIGHBOUR = _stats(reg.NEIGHBOUR_PRICE_COLUMNS)
_LIST = "[" + ", ".join(_HOURS) + "]"
_COMM_FILL = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in reg.COMMODITY_COLUMNS
)
_GAPS = ", ".join(
    f"{fn}(abs({a} - {b})) AS {n}_{st}" for n, (a, b) in reg.FORECAST_PAIRS.items() for st, fn in (("mean", "avg"), ("max", "max"))
)

_DATASET = f"""WITH {s.MODEL_TABLES},
wide AS (SELECT {ldate('datetime')} AS fecha, {_PIVOT} FROM spot_price GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(CAST(min(fecha) AS TIMESTAMP), CAST(max(fecha) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS fecha FROM wide),
target AS (SELECT days.fecha, {', '.join('w.' + c for c in _HOURS)} FROM days LEFT JOIN wide w ON w.fecha = days.fecha + 1),
{_ahead_sql('fc', 'esios_forecast_da', 'datetime', reg.FORECAST_COLUMNS)},
{_ahead_sql('ntc', 'load_inter', 'datetime', reg.NTC_COLUMNS)},
comm AS (SELECT fecha, {_COMM_FILL} FROM commodities),
real_load AS (SELECT {ldate('datetime')} AS fecha, {_stats_sql(reg.REAL_LOAD_COLUMNS)} FROM (SELECT * REPLACE (nullif(entsoe_load, 0) AS entsoe_load) FROM load_inter) GROUP BY 1),
real_gen AS (SELECT {ldate('datetime')} AS fecha, {_stats_sql([*reg.REAL_ENTSOE_COLUMNS, 'hydro_dispatch_mw'])}
 FROM (SELECT *, hydro_reservoir_mw + coalesce(pumping_gen_mw, 0) AS hydro_dispatch_mw FROM entsoe_gen_data) GROUP BY 1),
real_esios AS (SELECT {ldate('datetime')} AS fecha, {_stats_sql(reg.REAL_ESIOS_COLUMNS)} FROM esios_gen GROUP BY 1),
real_pv AS (SELECT {ldate('datetime')} AS fecha, {_stats_sql(['solar_fv_mw'])} FROM (SELECT datetime, greatest(0, g.solar_mw - e.ree_gsolter_mw) AS solar_fv_mw
 FROM entsoe_gen_data g JOIN esios_gen e USING (datetime) WHERE g.solar_mw IS NOT NULL AND e.ree_gsolter_mw IS NOT NULL) GROUP BY 1),
real_day AS (SELECT * FROM real_load FULL JOIN real_gen USING (fecha) FULL JOIN real_esios USING (fecha) FULL JOIN real_pv USING (fecha)),
{_lags_sql('real', 'real_day', _REAL)},
price_day AS (SELECT fecha, list_avg({_LIST}) AS precio_real_mean, list_min({_LIST}) AS precio_real_min, list_max({_LIST}) AS precio_real_max FROM wide),
{_lags_sql('price', 'price_day', _PRICE)},
{_ahead_sql('wx', '(SELECT * REPLACE (t2m_mean - 273.15 AS t2m_mean, d2m_mean - 273.15 AS d2m_mean) FROM era5_weather_agg)', 'ts', reg.WEATHER_COLUMNS)},
{_ahead_sql('fc2', 'entsoe_forecast_da', 'datetime', reg.ENTSOE_FORECAST_COLUMNS, 'entsoe_')},
gaps AS (SELECT {ldate('datetime')} - 1 AS fecha, {_GAPS} FROM esios_forecast_da JOIN entsoe_forecast_da USING (datetime) GROUP BY 1),
cap AS (SELECT date AS fecha, total_mw AS capacidad_disp_total_mw FROM esios_capacity_available),
neighbour_day AS (SELECT {ldate('datetime')} AS fecha, {_stats_sql(reg.NEIGHBOUR_PRICE_COLUMNS)} FROM spot_price GROUP BY 1),
{_lags_sql('neighbour', 'neighbour_day', _NEIGHBOUR)}
"""

_BLOCKS = {
    "fc": _stats(reg.FORECAST_COLUMNS),
    "ntc": _stats(reg.NTC_COLUMNS),
    "comm": list(reg.COMMODITY_COLUMNS),
    "real1": [f"{c}_lag1d" for c in _REAL],
    "real7": [f"{c}_lag7d" for c in _REAL],
    "price1": [f"{c}_lag1d" for c in _PRICE],
    "price7": [f"{c}_lag7d" for c in _PRICE],
    "wx": _stats(reg.WEATHER_COLUMNS),
}
_PENDING = {
    "fc2": _stats(reg.ENTSOE_FORECAST_COLUMNS, "entsoe_"),
    "gaps": [f"{n}_{st}" for n in reg.FORECAST_PAIRS for st in ("mean", "max")],
    "cap": ["capacidad_disp_total_mw"],
    "neighbour1": [f"{c}_lag1d" for c in _NEIGHBOUR],
    "neighbour7": [f"{c}_lag7d" for c in _NEIGHBOUR],
}


def _dataset_sql(blocks: dict[str, list[str]], valid_only: bool, places: int) -> str:
    shown = lambda c: f"(round(CAST({c} AS DOUBLE) + 1e-9, {places}) + 0.0)"
    cells = [f"{shown('target.' + c)} AS {c}" for c in _HOURS]
    cells += [f"{shown(f'{b}.{c}')} AS {c}" for b, cols in blocks.items() for c in cols]
    nxt = "(target.fecha + INTERVAL 1 DAY)"
    cells += [
        f"{big(f'isodow({nxt}) - 1')} AS d1_dow", f"{big(f'month({nxt})')} AS d1_month",
        f"{big(f'CASE WHEN isodow({nxt}) >= 6 THEN 1 ELSE 0 END')} AS d1_is_weekend",
    ]
    joined = " ".join(f"LEFT JOIN {b} ON {b}.fecha = target.fecha" for b in blocks)
    where = " WHERE " + " AND ".join(f"target.{c} IS NOT NULL" for c in _HOURS) if valid_only else ""
    return f"{_DATASET} SELECT {day('target.fecha')} AS fecha, {', '.join(cells)} FROM target {joined}{where}"


# The default plan rounds half-even to two places, where a tie may fall either way in the
# twin's arithmetic; the twins below check the same plan unrounded.
@query("daily_dataset", "C02 A05 A06 A07 A08 W01 W02 W03 W04 J09 J10 P13 P22 P23")
def daily_dataset(spark, sf):
    return model_data.daily_dataset(s.model_tables(spark, sf))


@query("daily_dataset_all_days", "C02", _dataset_sql({**_BLOCKS, **_PENDING}, False, 4))
def daily_dataset_all_days(spark, sf):
    return model_data.daily_dataset(s.model_tables(spark, sf), valid_only=False, pending=True, places=None)


@query("daily_dataset_valid_days", "C02 P13", _dataset_sql(_BLOCKS, True, 4))
def daily_dataset_valid_days(spark, sf):
    return model_data.daily_dataset(s.model_tables(spark, sf), places=None)


# Hourly spine ---------------------------------------------------------------------------

_SPINE_TABLES = ("entsoe_gen_data", "esios_gen", "load_inter", "esios_forecast_da")


@query(
    "hourly_spine",
    "C01 J01 J02 W04",
    f"""WITH {s.MODEL_TABLES}, comm AS (SELECT fecha, {_COMM_FILL} FROM commodities)
 SELECT {stamp('g.datetime')} AS ts, {day(ldate('g.datetime'))} AS fecha, """
    + ", ".join(f"{num(f'{a}.{c}')} AS {c}" for a, n in zip("gelf", _SPINE_TABLES) for c, _, _ in s.HOURLY_TABLES[n])
    + ", " + ", ".join(f"{num('comm.' + c)} AS {c}" for c in reg.COMMODITY_COLUMNS)
    + f""", {num('cap.total_mw')} AS total_mw FROM entsoe_gen_data g LEFT JOIN esios_gen e USING (datetime) LEFT JOIN load_inter l USING (datetime)
 LEFT JOIN esios_forecast_da f USING (datetime) LEFT JOIN comm ON comm.fecha = {ldate('g.datetime')} LEFT JOIN esios_capacity_available cap ON cap.date = {ldate('g.datetime')}""",
)
def hourly_spine(spark, sf):
    return model_data.hourly_spine(s.model_tables(spark, sf))


# Bronze ---------------------------------------------------------------------------------

_BR_JOINS = {"entsoe_gen_data": "g", "esios_gen": "e", "load_inter": "l", "esios_forecast_da": "f"}


def _bronze_sql() -> str:
    cells = []
    for n, spec in reg.BRONZE_TABLES.items():
        alias = {**_BR_JOINS, "commodities": "c", "era5_weather_agg": "w"}[n]
        for col in spec.columns:
            ref = f"{alias}.{col}"
            if spec.grain == "daily":
                ref = f"CASE WHEN {lhour('cal.ts')} = 0 THEN {ref} END"
            cells.append(f"{num(ref)} AS {spec.prefix}_{col}")
    return f"""WITH {s.MODEL_TABLES}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM hourly), cal AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b)
 SELECT {stamp('cal.ts')} AS ts_utc, {stamp(local('cal.ts'))} AS ts_local, {day('cal.ts')} AS date_utc, {day(ldate('cal.ts'))} AS date_local,
 {big("extract('hour' FROM cal.ts)")} AS hour_utc, {big(lhour('cal.ts'))} AS hour_local, {', '.join(cells)},
 {num('CASE WHEN g.solar_mw IS NULL OR e.ree_gsolter_mw IS NULL THEN NULL ELSE greatest(0, g.solar_mw - e.ree_gsolter_mw) END')} AS calc_solar_fv_mw,
 {num('g.hydro_reservoir_mw + coalesce(g.pumping_gen_mw, 0)')} AS calc_hydro_dispatch_mw, {num('l.ree_load - l.entsoe_load')} AS calc_autoconsumo_mw
 FROM cal LEFT JOIN entsoe_gen_data g ON g.datetime = cal.ts LEFT JOIN esios_gen e ON e.datetime = cal.ts LEFT JOIN load_inter l ON l.datetime = cal.ts
 LEFT JOIN esios_forecast_da f ON f.datetime = cal.ts LEFT JOIN commodities c ON c.fecha = {ldate('cal.ts')} LEFT JOIN era5_weather_agg w ON w.ts = cal.ts"""


@query("bronze_union", "C04 F03 J04 J05 J06 P05 P06 P07 P08 S04 D1", _bronze_sql())
def bronze_union(spark, sf):
    return bronze.bronze_union(bronze.normalized(s.model_tables(spark, sf)))


# Generation refresh ---------------------------------------------------------------------

_GEN_OUT = {
    "c_gsolar": "CASE WHEN g.solar_mw IS NULL OR e.ree_gsolter_mw IS NULL THEN NULL ELSE greatest(0, g.solar_mw - e.ree_gsolter_mw) END",
    "c_ghydrodispatch": "g.hydro_reservoir_mw + coalesce(g.pumping_gen_mw, 0)",
    **{o: f"{'g' if src == 'entsoe' else 'e'}.{c}" for o, (src, c) in reg.GENERATION_OUTPUT.items()},
}
_GEN_CELLS = ", ".join(f"{num(x)} AS {o}" for o, x in _GEN_OUT.items())


@query(
    "clean_generation",
    "C07 J07 P06 P07",
    f"WITH {s.MODEL_TABLES} SELECT {stamp('datetime')} AS datetime, {_GEN_CELLS} FROM entsoe_gen_data g JOIN esios_gen e USING (datetime)",
)
def clean_generation(spark, sf):
    t = s.model_tables(spark, sf)
    return bronze.clean_generation(t["entsoe_gen_data"], t["esios_gen"])


_OLD = "datetime < TIMESTAMP '2024-01-20'"


@query(
    "generation_refresh",
    "C07 J22 M04 M08",
    f"""WITH {s.MODEL_TABLES}, full_gen AS (SELECT datetime, {', '.join(f'{x} AS {o}' for o, x in _GEN_OUT.items())} FROM entsoe_gen_data g JOIN esios_gen e USING (datetime)),
 b AS (SELECT max(datetime) - INTERVAL 7 DAY AS t FROM full_gen WHERE {_OLD})
 SELECT {stamp('datetime')} AS datetime, {', '.join(f"{num(f'CASE WHEN datetime > t THEN {o} ELSE -1 END')} AS {o}" for o in _GEN_OUT)}
 FROM full_gen, b WHERE {_OLD} OR datetime > t""",
)
def generation_refresh(spark, sf):
    """The stored table holds wrong values up to a day; the refresh corrects its last week
    and adds the later hours."""
    t = s.model_tables(spark, sf)
    stored = bronze.clean_generation(t["entsoe_gen_data"], t["esios_gen"]).where("datetime < TIMESTAMP '2024-01-20'")
    stale = stored.select("datetime", *[F.lit(-1.0).alias(c) for c in stored.columns if c != "datetime"])
    return bronze.generation_refresh(t["entsoe_gen_data"], t["esios_gen"], stale)


# Futures --------------------------------------------------------------------------------


@query(
    "trades_to_bars",
    "C08 S11 W11 A10",
    f"""WITH {s.READINGS}, t AS (SELECT CAST(event_id AS VARCHAR) AS trade_id, ts, round(value, 3) AS p, qty FROM readings WHERE value <= 2000)
 SELECT 'TTF' AS commodity, 'Feb-24' AS periodo, {big('1')} AS item_id, {day(ldate('ts'))} AS fecha, {num('arg_min(p, (ts, trade_id))')} AS apertura, {num('max(p)')} AS maximo, {num('min(p)')} AS minimo,
 {num('arg_max(p, (ts, trade_id))')} AS cierre, {num('round(sum(p * greatest(qty, 1)) / sum(greatest(qty, 1)) + 1e-9, 3)')} AS vwap, {big('sum(greatest(qty, 1))')} AS volumen,
 {big('count(*)')} AS n_trades, {num('0')} AS pct_agresor_compra FROM t GROUP BY {day(ldate('ts'))}""",
)
def trades_to_bars(spark, sf):
    r = s.readings(spark, sf)
    raw = r.select(
        F.col("event_id").cast("string").alias("tradeId"),
        F.lit("X").alias("venueCode"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("double").alias("dealDate"),
        F.col("value").cast("string").alias("price"),
        F.col("qty").cast("double").alias("quantity"),
        F.lit(False).alias("aggressorBuy"),
        F.lit("TTF").alias("commodity"),
        F.lit("Feb-24").alias("periodo"),
        F.lit(1).alias("item_id"),
    )
    return feeds.trades_to_bars(raw.unionByName(raw.where(F.col("tradeId").endswith("7"))))


@query(
    "continuous_futures",
    "C08 W08 M07 J14",
    f"""WITH {s.BARS}, {s.DAILY_PRICE}, el AS (SELECT *, CASE WHEN commodity = 'EUA' THEN month(delivery) = 12 AND year(delivery) >= year(fecha) ELSE delivery > date_trunc('month', fecha) END AS ok FROM bars),
 front AS (SELECT commodity, fecha, arg_min(cierre, delivery) AS p FROM el WHERE ok GROUP BY 1, 2),
 d AS (SELECT fecha + {s.SHIFT_DAYS} AS fecha FROM daily_price WHERE v IS NOT NULL)
 SELECT {day('d.fecha')} AS fecha, {num('coalesce(e.p, -1)')} AS co2_eua_dec, {num('t.p')} AS gas_ttf_m1 FROM d
 LEFT JOIN front e ON e.fecha = d.fecha AND e.commodity = 'EUA' LEFT JOIN front t ON t.fecha = d.fecha AND t.commodity = 'TTF'""",
)
def continuous_futures(spark, sf):
    """The commodity table lacks the days without a low price, so some of the series is orphaned."""
    known = s.daily_price(spark, sf).where(F.col("v").isNotNull())
    days = known.select(F.date_add("fecha", s.SHIFT_DAYS).alias("fecha"))
    stored = days.withColumns({"co2_eua_dec": F.lit(-1.0), "gas_ttf_m1": F.lit(None).cast("double")})
    return feeds.continuous_futures(s.bars(spark, sf), stored)


# Feeds ----------------------------------------------------------------------------------


def _column_readings(spark, sf, columns):
    """Sub-hour readings whose column follows from type and user."""
    r = s.readings(spark, sf)
    names = F.array(*[F.lit(c) for c in columns])
    slot = (F.col("user_id") % len(columns) + 1).cast("int")
    return r.select("ts", F.element_at(names, slot).alias("column_name"), "value", "source", "qty")


def _column_readings_sql(columns) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return f"{s.READINGS}, cr AS (SELECT date_trunc('hour', ts) AS ts, {names}[1 + user_id % {len(columns)}] AS c, value, source, qty FROM readings)"


def _wide_sql(name: str, source: str, columns, summed) -> str:
    cells = ", ".join(f"{'sum' if c in summed else 'avg'}(value) FILTER (WHERE c = '{c}') AS {c}" for c in columns)
    return f"{name} AS (SELECT ts, {cells} FROM {source} GROUP BY ts)"


_GEN_CODES = {"solar_mw": ["view"], "wind_mw": ["click", "error"], "nuclear_mw": ["absent"]}
_MW = {"solar_mw": "series = 'view'", "wind_mw": "series IN ('click', 'error')", "nuclear_mw": "false"}


@query(
    "generation_load",
    "P03 P04 A01 M02 R3",
    f"""WITH {s.READINGS}, q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, series, avg(value) AS value FROM readings GROUP BY 1, 2),
 w AS (SELECT ts, {', '.join(f'sum(value) FILTER (WHERE {c}) AS {n}' for n, c in _MW.items())} FROM q WHERE series IN ('view', 'click', 'error') GROUP BY ts),
 h AS (SELECT date_trunc('hour', ts) AS ts, {', '.join(f'round(avg({n}) + 1e-9, 2) AS {n}' for n in _MW)} FROM w GROUP BY 1),
 st AS (SELECT date_trunc('hour', ts) AS ts, max(value) FILTER (WHERE series = 'view') AS solar_mw FROM readings WHERE source = 0 GROUP BY 1)
 SELECT {stamp('ts')} AS ts, {num('coalesce(st.solar_mw, h.solar_mw)')} AS solar_mw, {num('wind_mw')} AS wind_mw, {num('nuclear_mw')} AS nuclear_mw FROM st FULL JOIN h USING (ts)""",
)
def generation_load(spark, sf):
    """Quarter-hour readings by source code into a stored table that has gaps."""
    r = s.readings(spark, sf)
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900)
    quarters = r.groupBy(quarter.alias("ts"), F.col("series").alias("code")).agg(F.avg("value").alias("value"))
    nudged = quarters.withColumn("value", F.col("value") + 1e-9)
    stored = r.where(F.col("source") == 0).groupBy(clock.hour_floor(F.col("ts")).alias("ts")).agg(
        F.max(F.when(F.col("series") == "view", F.col("value"))).alias("solar_mw")
    )
    return feeds.generation_load(stored, nudged, _GEN_CODES)


_LC = list(reg.LOAD_COLUMNS)


@query(
    "load_inter_load",
    "C10 A01 A02 P09 M02 M11",
    f"""WITH {_column_readings_sql(_LC)}, {_wide_sql('old', '(SELECT * FROM cr WHERE hour(ts) < 12)', _LC, reg.LOAD_SUMMED)}, {_wide_sql('new', 'cr', _LC, reg.LOAD_SUMMED)},
 m AS (SELECT ts, {', '.join(f'coalesce(old.{c} + 1, new.{c}) AS {c}' for c in _LC)} FROM old FULL JOIN new USING (ts))
 SELECT {stamp('ts')} AS ts, {', '.join(f'{num(c)} AS {c}' for c in _LC)}, {num('ree_netflow_fr + ree_netflow_pt + ree_netflow_ma')} AS total_net_flow_mw,
 {num('ree_load - (ree_netflow_fr + ree_netflow_pt + ree_netflow_ma)')} AS gen_peninsular_mw FROM m""",
)
def load_inter_load(spark, sf):
    readings = _column_readings(spark, sf, _LC)
    stored = feeds.load_frame(readings.where(F.hour("ts") < 12))
    shifted = stored.select("ts", *[(F.col(c) + 1).alias(c) for c in _LC])
    return feeds.load_inter_load(shifted, readings)


_PC = list(reg.PROGRAMME_COLUMNS["esios_pbf_load_inter"])


@query(
    "programme_load",
    "C11 A02 M03 Q01",
    f"""WITH {_column_readings_sql(_PC)}, {_wide_sql('old', '(SELECT * FROM cr WHERE source = 0)', _PC, _PC)}, {_wide_sql('new', 'cr', _PC, _PC)}
 SELECT {stamp('ts')} AS ts, {', '.join(f"{num(f'CASE WHEN old.ts IS NULL OR (new.{c} IS NOT NULL AND (old.{c} IS NULL OR abs(old.{c} - new.{c}) > 0.01)) THEN new.{c} ELSE old.{c} END')} AS {c}" for c in _PC)}
 FROM old FULL JOIN new USING (ts)""",
)
def programme_load(spark, sf):
    readings = _column_readings(spark, sf, _PC)
    stored = feeds.load_frame(readings.where(F.col("source") == 0), tuple(_PC), tuple(_PC))
    return feeds.programme_load(stored, readings, tuple(_PC), overwrite=True)


@query(
    "spot_price_load",
    "C09 A01 A03 M04 P10",
    f"""WITH {s.READINGS}, a AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value) + 1e-9, 2) AS p FROM readings WHERE source = 0 GROUP BY 1),
 h AS (SELECT date_trunc('hour', ts) AS ts, count(value) AS n, avg(value) AS v FROM readings WHERE source = 1 GROUP BY 1),
 k AS (SELECT n FROM (SELECT n, count(*) AS c FROM h GROUP BY 1) ORDER BY c DESC, n LIMIT 1), b AS (SELECT h.ts, round(v + 1e-9, 2) AS p FROM h JOIN k ON h.n = k.n),
 fresh AS (SELECT ts, a.p AS es_esios, b.p AS es_entsoe FROM a FULL JOIN b USING (ts)),
 stored AS (SELECT DISTINCT date_trunc('hour', ts) AS ts, -1.0 AS o FROM readings WHERE source = 1)
 SELECT {stamp('ts')} AS ts, {num('coalesce(es_esios, o)')} AS es_esios, {num('coalesce(es_entsoe, o)')} AS es_entsoe
 FROM stored FULL JOIN fresh USING (ts)""",
)
def spot_price_load(spark, sf):
    r = s.readings(spark, sf).select("ts", "source", (F.col("value") + 1e-9).alias("value"))
    stored = r.where(F.col("source") == 1).select(clock.hour_floor(F.col("ts")).alias("ts")).distinct()
    stored = stored.withColumns({"es_esios": F.lit(-1.0), "es_entsoe": F.lit(-1.0)})
    no_files = r.where(F.lit(False)).select(F.lit("").alias("file"), F.lit("").alias("text"))
    one = r.where(F.col("source") == 0).withColumn("column_name", F.lit("es_esios"))
    two = r.where(F.col("source") == 1).withColumn("column_name", F.lit("es_entsoe"))
    return feeds.spot_price_load(stored, no_files, one, two)


@query(
    "spot_price_three_sources",
    "C09 S09 Q04",
    f"""WITH {s.HOURLY}, p AS (SELECT ts, {ldate('ts')} AS d, round(price + 1e-9, 2) AS p FROM hourly),
 ok AS (SELECT d FROM p GROUP BY d HAVING count(*) = 24 OR (count(*) = 23 AND d = DATE '2024-03-31')),
 omie AS (SELECT ts, round(CASE WHEN day(d) % 2 = 0 THEN p ELSE p + 0.75 END + 1e-9, 2) AS es_omie FROM p JOIN ok USING (d)),
 es AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value) + 1e-9, 2) AS es_esios FROM events GROUP BY 1)
 SELECT {stamp('ts')} AS ts, {num('es_omie')} AS es_omie, {num('es_esios')} AS es_esios FROM omie FULL JOIN es USING (ts)""",
)
def spot_price_three_sources(spark, sf):
    from gridhour.queries.markets import _market_files

    r = s.readings(spark, sf).select("ts", (F.col("value") + 1e-9).alias("value"), F.lit("es_esios").alias("column_name"))
    stored = r.where(F.lit(False)).select(
        clock.hour_floor(F.col("ts")).alias("ts"), F.lit(0.0).alias("es_omie"), F.lit(0.0).alias("es_esios")
    )
    return feeds.spot_price_load(stored, _market_files(spark, sf), r, r.where(F.lit(False)))


_CC = ["hydro_mw", "pump_mw", "nuclear_mw", "coal_antracita_mw", "coal_subbituminosa_mw", "ccgt_mw", "fuel_mw"]


@query(
    "capacity_daily",
    "C13 A34 M05 P14",
    f"""WITH {_column_readings_sql(_CC)}, d AS (SELECT CAST(ts AS DATE) AS date, c, round(avg(value) + 1e-9, 2) AS v FROM cr WHERE qty >= 20 GROUP BY 1, 2), days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM cr),
 w AS (SELECT date, {', '.join(f"max(v) FILTER (WHERE c = '{c}') AS {c}" for c in _CC)} FROM d GROUP BY 1)
 SELECT {day('date')} AS date, {', '.join(f'{num(c)} AS {c}' for c in reg.CAPACITY_COLUMNS if c != 'coal_mw')},
 {num('CASE WHEN coalesce(coal_antracita_mw, coal_subbituminosa_mw) IS NOT NULL THEN coalesce(coal_antracita_mw, 0) + coalesce(coal_subbituminosa_mw, 0) ELSE -5 END')} AS coal_mw FROM days LEFT JOIN w USING (date)""",
)
def capacity_daily(spark, sf):
    r = _column_readings(spark, sf, _CC)
    geo = F.when(F.col("qty") >= 20, reg.PENINSULA_GEO_ID).otherwise(3)
    readings = r.select(F.to_date("ts").alias("day"), "column_name", (F.col("value") + 1e-9).alias("value"), geo.alias("geo_id"))
    stored = readings.select(F.col("day").alias("date")).distinct()
    stored = stored.select("date", *[F.lit(-5.0 if c == "coal_mw" else None).cast("double").alias(c) for c in reg.CAPACITY_COLUMNS])
    return feeds.capacity_daily(stored, readings)


@query(
    "capacity_monthly",
    "C13 W06 M05 M10",
    f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(avg(o_totalprice) + 1e-9, 2) AS v FROM orders GROUP BY 1),
 redo AS (SELECT * FROM m WHERE m IN (DATE '2001-06-01', DATE '2001-07-01')),
 x AS (SELECT CAST(unnest(generate_series(CAST(m AS TIMESTAMP), CAST(least(last_day(m), DATE '2001-07-04') AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d, v FROM redo),
 st AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT {day('d')} AS date, {num('coalesce(x.v, CASE WHEN st.d IS NOT NULL THEN 0 END)')} AS solar_mw FROM st FULL JOIN x USING (d)""",
)
def capacity_monthly(spark, sf):
    o = table(spark, sf, "orders")
    monthly = o.groupBy(clock.month_floor(F.col("o_orderdate")).alias("month")).agg(F.round(F.avg("o_totalprice") + 1e-9, 2).alias("solar_mw"))
    stored = o.select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumn("solar_mw", F.lit(0.0))
    return feeds.capacity_monthly(stored, monthly, F.lit("2001-07-04").cast("date"))


@query(
    "capacity_snapshot",
    "C12 J11 J12 M04",
    f"""WITH {s.READINGS}, d AS (SELECT CAST(ts AS DATE) AS run, CAST(ts AS DATE) + CAST(user_id % 8 AS INTEGER) AS target, series, round(avg(value) + 1e-9, 2) AS v
 FROM readings WHERE qty >= 20 GROUP BY 1, 2, 3),
 w AS (SELECT run, target, max(v) FILTER (WHERE series = 'view') AS n, max(v) FILTER (WHERE series = 'click') AS c FROM d WHERE series IN ('view', 'click') GROUP BY 1, 2)
 SELECT {day('a.target')} AS target_date, {num('a.n')} AS known_nuclear_mw, {num('a.c')} AS known_ccgt_mw, {num('a.n - b.n')} AS revision_nuclear_mw, {num('a.c - b.c')} AS revision_ccgt_mw
 FROM w a LEFT JOIN w b ON b.target = a.target AND b.run = a.run - 6 WHERE a.run = a.target - 1""",
)
def capacity_snapshot(spark, sf):
    r = s.readings(spark, sf)
    name = F.when(F.col("series") == "view", "nuclear_mw").when(F.col("series") == "click", "ccgt_mw").otherwise("unused_mw")
    geo = F.when(F.col("qty") < 20, 3).when(F.col("qty") < 60, reg.PENINSULA_GEO_ID)
    run = F.to_date("ts")
    readings = r.select(
        run.alias("run_date"), F.date_add(run, (F.col("user_id") % 8).cast("int")).alias("target_date"),
        name.alias("column_name"), (F.col("value") + 1e-9).alias("value"), geo.alias("geo_id"),
    )
    empty = readings.where(F.lit(False)).select("run_date", "target_date", *[F.lit(0.0).alias(c) for c in reg.SNAPSHOT_COLUMNS])
    return feeds.capacity_features(feeds.capacity_snapshot(empty, readings), ["nuclear_mw", "ccgt_mw"])


@query(
    "commodities_load",
    "C17 S10 S17 W05 M01 M02",
    f"""WITH {s.DAILY_PRICE}, st AS (SELECT fecha, CASE WHEN day(fecha) % 2 = 0 THEN 1.0 END AS gas_ttf FROM daily_price WHERE year(fecha) < 2000),
 mf AS (SELECT min(fecha) AS fecha, arg_min(v, fecha) AS v FROM daily_price WHERE v IS NOT NULL GROUP BY date_trunc('month', fecha)),
 co AS (SELECT fecha, round(v / 1000 + 1e-9, 4) AS c, coalesce(lead(fecha) OVER (ORDER BY fecha) - 1, DATE '2001-09-30') AS last FROM mf),
 cx AS (SELECT CAST(unnest(generate_series(CAST(fecha AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS fecha, c FROM co),
 fresh AS (SELECT fecha, v AS gas_ttf, w AS gas_mibgas FROM daily_price WHERE v IS NOT NULL OR w IS NOT NULL)
 SELECT {day('fecha')} AS fecha, {num('coalesce(st.gas_ttf, fresh.gas_ttf)')} AS gas_ttf, {num('fresh.gas_mibgas')} AS gas_mibgas, {num('cx.c')} AS co2_ets
 FROM st FULL JOIN fresh USING (fecha) FULL JOIN cx USING (fecha)""",
)
def commodities_load(spark, sf):
    d = s.daily_price(spark, sf)
    stored = d.where(F.year("fecha") < 2000).select("fecha", F.when(F.dayofmonth("fecha") % 2 == 0, 1.0).alias("gas_ttf"))
    co2 = s.monthly_first(spark, sf).select("fecha", (F.col("v") / 1000 + 1e-9).alias("co2_ets"))
    close = d.where(F.col("v").isNotNull()).select("fecha", F.col("v").alias("gas_ttf"))
    gas = d.select("fecha", F.col("w").alias("gas_mibgas"))
    return feeds.commodities_load(stored, [close], gas, co2, F.lit("2001-09-30").cast("date"))


@query(
    "backfill_recompute",
    "C15 M03 J15",
    f"""WITH {s.STORED_FRESH}, n AS (SELECT ts, round(a + 1e-9, 2) AS a, round(b + 1e-9, 2) AS b FROM fresh)
 SELECT {stamp('o.ts')} AS ts, {num('CASE WHEN n.a IS NOT NULL AND (o.a IS NULL OR abs(o.a - n.a) > 0.01) THEN n.a ELSE o.a END')} AS a,
 {num('CASE WHEN n.b IS NOT NULL AND (o.b IS NULL OR abs(o.b - n.b) > 0.01) THEN n.b ELSE o.b END')} AS b FROM stored o LEFT JOIN n USING (ts)""",
)
def backfill_recompute(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    nudged = fresh.select("ts", (F.col("a") + 1e-9).alias("a"), (F.col("b") + 1e-9).alias("b"))
    return feeds.backfill(stored, nudged, ["ts"], ["a", "b"])


@query(
    "backfill_report",
    "C15 M12 J16",
    f"""WITH {s.STORED_FRESH}, p AS (SELECT o.a AS oa, n.a AS na, o.b AS ob, n.b AS nb FROM stored o JOIN fresh n USING (ts))
 SELECT 'a' AS column_name, {big('count(*) FILTER (WHERE na IS NOT NULL AND (oa IS NULL OR abs(oa - na) > 0.01))')} AS n_changed, false AS is_control FROM p
 UNION ALL SELECT 'b', {big('count(*) FILTER (WHERE nb IS NOT NULL AND ob IS NOT NULL AND abs(ob - nb) > 0.01)')}, true FROM p
 UNION ALL SELECT '(no stored row)', {big('(SELECT count(*) FROM fresh WHERE ts NOT IN (SELECT ts FROM stored))')}, false""",
)
def backfill_report(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return feeds.backfill_report(stored, fresh, ["ts"], ["a", "b"], ("b",))


@query(
    "late_fill_then_correct",
    "M02 M03 T05",
    f"""WITH {s.STORED_FRESH}, m AS (SELECT ts, coalesce(o.a, n.a) AS a, n.a AS na FROM stored o FULL JOIN fresh n USING (ts))
 SELECT {stamp('ts')} AS ts, {num("CASE WHEN ts > (SELECT max(ts) FROM fresh) - INTERVAL 3 DAY AND na IS NOT NULL AND abs(a - na) > 0.01 THEN na ELSE a END")} AS a FROM m""",
)
def late_fill_then_correct(spark, sf):
    """Gaps are filled everywhere; the last three days are also corrected."""
    from gridhour.streaming.feeds import recent_days

    stored, fresh = (df.select("ts", "a") for df in s.stored_and_fresh(spark, sf))
    filled = merge.merge_frames(stored, fresh, ["ts"], merge.FILL_NULL)
    return merge.merge_frames(filled, recent_days(fresh, "ts", 3), ["ts"], merge.OVERWRITE_DIFFERENT, 0.01)
