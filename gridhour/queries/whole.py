"""Whole flows with every table and source that belongs to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock, labels
from gridhour.operators import joins
from gridhour.plans import bronze, feeds, model_data, reports
from gridhour.queries import flows
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, ldate, num, query, stamp
from gridhour.session import scratch_path
from gridhour.sources.tables import scan_all

# All spine tables -------------------------------------------------------------------------

#: Tables that the model tables lack; one column of each collides with another table's.
_MORE_HOURLY = {"entsoe_load_inter": [("load_mw", "view", 2), ("nuclear_mw", "click", 3)]}
_MORE_DAILY = {"esios_capacity_installed": [("solar_mw", "error", 5), ("total_mw", "purchase", 7)]}


def spine_tables(spark, sf):
    t = s.model_tables(spark, sf)
    hourly = s.hourly_by_type(spark, sf)
    for n, cols in _MORE_HOURLY.items():
        t[n] = hourly.selectExpr("ts AS datetime", *[f"{c} * {float(k)}D AS {name}" for name, c, k in cols])
    for n, cols in _MORE_DAILY.items():
        t[n] = hourly.groupBy(F.to_date("ts").alias("date")).agg(*[(F.max(c) * float(k)).alias(name) for name, c, k in cols])
    return t


_MORE = ",\n".join(
    [f"{n} AS (SELECT ts AS datetime, {', '.join(f'{c} * {float(k)} AS {name}' for name, c, k in cols)} FROM hourly)" for n, cols in _MORE_HOURLY.items()]
    + [f"{n} AS (SELECT CAST(ts AS DATE) AS date, {', '.join(f'max({c}) * {float(k)} AS {name}' for name, c, k in cols)} FROM hourly GROUP BY 1)" for n, cols in _MORE_DAILY.items()]
)
_ALIAS = {"entsoe_gen_data": "g", "entsoe_load_inter": "x", "esios_gen": "e", "load_inter": "l", "esios_forecast_da": "f"}


def _spine_cells() -> str:
    cells, seen = [], set()
    tables = {**s.HOURLY_TABLES, **_MORE_HOURLY}
    for n, alias in _ALIAS.items():
        suffix = dict(model_data.SPINE_HOURLY).get(n, "")
        for c, _, _ in tables[n]:
            cells.append(f"{num(f'{alias}.{c}')} AS {c + suffix if c in seen else c}")
            seen.add(c)
    cells += [f"{num('comm.' + c)} AS {c}" for c in reg.COMMODITY_COLUMNS]
    cells += [f"{num('cap.total_mw')} AS total_mw", f"{num('ins.solar_mw')} AS solar_mw_esios_capacity_installed", f"{num('ins.total_mw')} AS total_mw_esios_capacity_installed"]
    return ", ".join(cells)


@query(
    "hourly_spine_all_tables",
    "C01 J01 J02 J03",
    f"""WITH {s.MODEL_TABLES}, {_MORE}, comm AS (SELECT fecha, {flows._COMM_FILL} FROM commodities)
 SELECT {stamp('g.datetime')} AS ts, {day(ldate('g.datetime'))} AS fecha, {_spine_cells()}
 FROM entsoe_gen_data g LEFT JOIN entsoe_load_inter x USING (datetime) LEFT JOIN esios_gen e USING (datetime) LEFT JOIN load_inter l USING (datetime)
 LEFT JOIN esios_forecast_da f USING (datetime) LEFT JOIN comm ON comm.fecha = {ldate('g.datetime')}
 LEFT JOIN esios_capacity_available cap ON cap.date = {ldate('g.datetime')} LEFT JOIN esios_capacity_installed ins ON ins.date = {ldate('g.datetime')}""",
)
def hourly_spine_all_tables(spark, sf):
    """All eight tables, names that collide, and the key checked."""
    return model_data.hourly_spine(spine_tables(spark, sf), check_keys=True)


# Prices -----------------------------------------------------------------------------------


@query(
    "spot_price_all_sources",
    "C09 S09 S13 A03 P10 M04",
    f"""WITH {s.HOURLY}, {s.READINGS}, p AS (SELECT ts, {ldate('ts')} AS d, round(price + 1e-9, 2) AS p FROM hourly),
 ok AS (SELECT d FROM p GROUP BY d HAVING count(*) = 24 OR (count(*) = 23 AND d = DATE '2024-03-31')),
 omie AS (SELECT ts, round(CASE WHEN day(d) % 2 = 0 THEN p ELSE p + 0.75 END + 1e-9, 2) AS es_omie FROM p JOIN ok USING (d)),
 es AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value) FILTER (WHERE source = 0) + 1e-9, 2) AS es_esios, round(avg(value) FILTER (WHERE source = 1) + 1e-9, 2) AS fr_esios FROM readings GROUP BY 1),
 h AS (SELECT series, date_trunc('hour', ts) AS ts, count(value) AS n, avg(value) AS v FROM readings WHERE series IN ('view', 'click') GROUP BY 1, 2),
 k AS (SELECT series, n FROM (SELECT series, n, count(*) AS c FROM h GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series ORDER BY c DESC, n) = 1),
 en AS (SELECT ts, max(round(v + 1e-9, 2)) FILTER (WHERE series = 'view') AS es_entsoe, max(round(v + 1e-9, 2)) FILTER (WHERE series = 'click') AS pt_entsoe FROM h JOIN k USING (series, n) GROUP BY ts),
 fresh AS (SELECT * FROM omie FULL JOIN es USING (ts) FULL JOIN en USING (ts)),
 st AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM readings WHERE source = 1)
 SELECT {stamp('ts')} AS ts, """
    + ", ".join(f"{num(f'coalesce(fresh.{c}, CASE WHEN st.ts IS NOT NULL THEN -1 END)')} AS {c}" for c in ("es_omie", "es_esios", "fr_esios", "es_entsoe", "pt_entsoe"))
    + f""", {num('CASE WHEN st.ts IS NOT NULL THEN 7 END')} AS volume_mwh, {num('CASE WHEN st.ts IS NOT NULL THEN 8 END')} AS zz_esios
 FROM st FULL JOIN fresh USING (ts)""",
)
def spot_price_all_sources(spark, sf):
    """Market files, indicator and exchange readings into one stored table. ``volume_mwh`` is a
    number but no price, ``zz_esios`` a zone that the source does not publish: both stay."""
    from gridhour.queries.markets import _market_files

    r = s.readings(spark, sf).select("ts", "source", "series", (F.col("value") + 1e-9).alias("value"))
    stored = r.where("source = 1").select(clock.hour_floor(F.col("ts")).alias("ts")).distinct()
    prices = ("es_omie", "es_esios", "fr_esios", "es_entsoe", "pt_entsoe")
    stored = stored.withColumns({c: F.lit(-1.0) for c in prices} | {"volume_mwh": F.lit(7.0), "zz_esios": F.lit(8.0)})
    esios = r.select("ts", F.when(F.col("source") == 0, "es_esios").otherwise("fr_esios").alias("column_name"), "value")
    named = F.when(F.col("series") == "view", "es_entsoe").when(F.col("series") == "click", "pt_entsoe")
    entsoe = r.select("ts", named.alias("column_name"), "value").where(F.col("column_name").isNotNull())
    return feeds.spot_price_load(stored, _market_files(spark, sf), esios, entsoe)


# Control pairs ----------------------------------------------------------------------------


def _side(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{n}' AS variable, datetime AS ts, {_side(a)} AS winner, {_side(b)} AS loser FROM both_tables" for n, (_, a, _, b) in reg.CONTROL_PAIRS.items()
)
_PAIR_CTE = f"""{s.MODEL_TABLES}, both_tables AS (SELECT * FROM entsoe_gen_data JOIN esios_gen USING (datetime)),
 p0 AS ({_PAIRS}), p AS (SELECT *, CAST(ts AS DATE) AS d, abs(winner - loser) AS diff_abs FROM p0),
 q AS (SELECT variable, quantile_cont(diff_abs, 0.99) AS threshold FROM p GROUP BY 1), m AS (SELECT * FROM p JOIN q USING (variable))"""


@query(
    "control_six_pairs",
    "C16 A31 Q05 U05 O02",
    f"""WITH {_PAIR_CTE},
 days AS (SELECT variable, d, count(*) AS n, avg(diff_abs) AS mean, max(diff_abs) AS mx FROM m WHERE diff_abs > threshold GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, d) AS place FROM days),
 t AS (SELECT variable, count(*) AS n_hours, max(threshold) AS threshold, count(*) FILTER (WHERE diff_abs > threshold) AS n_suspect FROM m GROUP BY 1)
 SELECT variable, {big('n_hours')} AS n_hours, {num('threshold')} AS threshold, {big('n_suspect')} AS n_suspect, {num('100.0 * n_suspect / n_hours')} AS pct_suspect,
 {big('place')} AS place, {day('d')} AS day, {big('n')} AS day_suspect, {num('mean')} AS diff_mean, {num('mx')} AS diff_max FROM t LEFT JOIN r USING (variable) WHERE place IS NULL OR place <= 5""",
)
def control_six_pairs(spark, sf):
    """The registered pairs on tables as they are scanned, with the five worst days of each."""
    marked = reports.marked_pairs(s.model_tables(spark, sf))
    wide = reports.control_summary(marked).withColumn("w", F.explode_outer("worst"))
    days = [F.col(f"w.{a}").alias(b) for a, b in (("place", "place"), ("day", "day"), ("n_suspect", "day_suspect"), ("diff_mean", "diff_mean"), ("diff_max", "diff_max"))]
    return wide.select("variable", "n_hours", "threshold", "n_suspect", "pct_suspect", *days)


# Bronze from extracted files --------------------------------------------------------------


@query("bronze_from_extract", "C05 C04 S01 S05 S06", flows._bronze_sql())
def bronze_from_extract(spark, sf):
    """Landed tables, extracted to normalised files one by one, read back and united."""
    root, out = scratch_path(spark, "landed"), scratch_path(spark, "bronze")
    tables = s.model_tables(spark, sf)
    for n, spec in reg.BRONZE_TABLES.items():
        extra = tables[n].withColumns({c: F.current_timestamp() for c in reg.AUDIT_COLUMNS})
        extra.withColumn("not_registered", F.lit(spec.grain)).write.parquet(f"{root}/{n}")
    done = bronze.extract_bronze(spark, root, out)
    raw = scan_all(spark, out, [f"{n}_raw" for n in done])
    return bronze.bronze_union({n.removesuffix("_raw"): df for n, df in raw.items()})


# Futures from trades ----------------------------------------------------------------------

_NAMES = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"


@query(
    "futures_from_trades",
    "C08 S11 W08 A10 M01 M07 J14",
    f"""WITH {s.READINGS}, t AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, {ldate('ts')} AS d, CASE WHEN user_id % 3 = 0 THEN 'EUA' ELSE 'TTF' END AS commodity,
 CASE WHEN user_id % 3 = 0 THEN make_date(year(ts) + CAST(user_id % 4 AS INTEGER), 12, 1) ELSE CAST(date_trunc('month', ts) + to_months(CAST(user_id % 4 AS INTEGER)) AS DATE) END AS delivery,
 round(value, 3) + CASE WHEN source = 0 AND event_id % 5 = 0 THEN 1000 ELSE 0 END AS p FROM readings WHERE value <= 900),
 b AS (SELECT d, commodity, delivery, arg_max(p, (ts, id)) AS cierre FROM t GROUP BY 1, 2, 3),
 f AS (SELECT commodity, d, arg_min(cierre, delivery) AS p FROM b WHERE CASE WHEN commodity = 'EUA' THEN month(delivery) = 12 AND year(delivery) >= year(d) ELSE delivery > date_trunc('month', d) END GROUP BY 1, 2),
 days AS (SELECT DISTINCT CAST(ts AS DATE) AS fecha FROM readings WHERE day(ts) % 6 <> 0)
 SELECT {day('fecha')} AS fecha, {num('coalesce(e.p, -1)')} AS co2_eua_dec, {num('t.p')} AS gas_ttf_m1, {num('3')} AS gas_mibgas FROM days
 LEFT JOIN f e ON e.d = fecha AND e.commodity = 'EUA' LEFT JOIN f t ON t.d = fecha AND t.commodity = 'TTF'""",
)
def futures_from_trades(spark, sf):
    """Raw trades and a stored log to bars, front contracts and the commodity table, as one plan.

    The log has some trades at another price, which wins; every trade arrives twice.
    """
    r = s.readings(spark, sf)
    eua = F.col("user_id") % 3 == 0
    step = (F.col("user_id") % 4).cast("int")
    delivery = F.when(eua, F.make_date(F.year("ts") + step, F.lit(12), F.lit(1))).otherwise(F.add_months(F.trunc(F.col("ts").cast("date"), "month"), step))
    raw = r.select(
        F.col("event_id").cast("string").alias("tradeId"), F.lit("X").alias("venueCode"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("double").alias("dealDate"),
        F.when(F.col("value") <= 900, F.col("value")).otherwise(1e9).cast("string").alias("price"), F.col("qty").cast("double").alias("quantity"), F.lit(False).alias("aggressorBuy"),
        F.when(eua, "EUA").otherwise("TTF").alias("commodity"), labels.contract_label(delivery).alias("periodo"), F.lit(1).alias("item_id"), "source", "event_id",
    )
    from gridhour.sources import trades

    kept = trades.clean(raw.where("source = 0 AND event_id % 5 = 0").drop("source", "event_id"))
    log = kept.withColumn("precio", F.col("precio") + 1000)
    fresh = raw.drop("source", "event_id")
    bars = feeds.trades_to_bars(fresh.unionAll(fresh), log)
    days = r.where(F.dayofmonth("ts") % 6 != 0).select(F.to_date("ts").alias("fecha")).distinct()
    commodities = days.withColumns({"co2_eua_dec": F.lit(-1.0), "gas_ttf_m1": F.lit(None).cast("double"), "gas_mibgas": F.lit(3.0)})
    return feeds.continuous_futures(bars, commodities)


# Programme --------------------------------------------------------------------------------

_PROGRAMME = {n: list(cols) for n, cols in reg.PROGRAMME_COLUMNS.items()}


def _programme_sql() -> str:
    ctes, cells, frm = [s.READINGS], [], []
    for i, (n, cols) in enumerate(_PROGRAMME.items()):
        names = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
        ctes.append(f"cr{i} AS (SELECT date_trunc('hour', ts) AS ts, {names}[1 + user_id % {len(cols)}] AS c, value, source FROM readings)")
        for side, where in (("old", "WHERE source = 0"), ("new", "")):
            made = ", ".join(f"sum(value) FILTER (WHERE c = '{c}') AS {c}" for c in cols)
            ctes.append(f"{side}{i} AS (SELECT ts, {made} FROM cr{i} {where} GROUP BY ts)")
        o, w = f"old{i}", f"new{i}"
        value = {c: f"CASE WHEN {w}.{c} IS NOT NULL AND ({o}.{c} IS NULL OR abs({o}.{c} - {w}.{c}) > 0.01) THEN {w}.{c} ELSE {o}.{c} END" for c in cols}
        ctes.append(f"t{i} AS (SELECT ts, {', '.join(f'{v} AS {c}' for c, v in value.items())} FROM {o} FULL JOIN {w} USING (ts))")
        frm.append(f"t{i}")
        cells += [f"{num(f't{i}.{c}')} AS {n}__{c}" for c in cols]
    pairs = ", ".join(f"{num(f't0.{p} - t2.{b}')} AS pdbc_{p}" for p, b in _MARKET_PAIRS.items())
    return f"WITH {', '.join(ctes)} SELECT {stamp('ts')} AS ts, {', '.join(cells)}, {pairs} FROM " + " JOIN ".join(f + (" USING (ts)" if i else "") for i, f in enumerate(frm))


_MARKET_PAIRS = {"nuclear_mw": "bil_nuclear_mw", "hydro_ugh_mw": "bil_hydro_ugh_mw", "solar_pv_mw": "bil_solar_pv_mw", "biomass_mw": "bil_biomass_mw"}


@query("programme_all_tables", "C11 A02 M03 P25", _programme_sql())
def programme_all_tables(spark, sf):
    """The three programme tables loaded side by side, and the programme without bilateral contracts."""
    loaded = {}
    for n, cols in _PROGRAMME.items():
        readings = flows._column_readings(spark, sf, cols)
        stored = feeds.load_frame(readings.where(F.col("source") == 0), tuple(cols), tuple(cols))
        loaded[n] = feeds.programme_load(stored, readings, tuple(cols), overwrite=True)
    gen, _, bilateral = loaded.values()
    parts = [df.select("ts", *[F.col(c).alias(f"{n}__{c}") for c in _PROGRAMME[n]]) for n, df in loaded.items()]
    parts.append(feeds.without_bilateral(gen, bilateral, _MARKET_PAIRS))
    out = parts[0]
    for df in parts[1:]:
        out = joins.pair_on_key(out, df, ["ts"])
    return out


# Weather ----------------------------------------------------------------------------------

_RUN_CELLS = f"""{s.READINGS}, c AS (SELECT CAST(ts AS DATE) AS run_date, CAST(35.0 AS DOUBLE) + user_id % 11 AS lat, CAST(350.0 AS DOUBLE) + user_id % 5 AS lon0,
 date_trunc('hour', ts) - INTERVAL 1 HOUR * (extract('hour' FROM ts) % 3) AS ts, avg(value) AS v, avg(CAST(qty AS DOUBLE)) AS q, sum(value) AS s FROM readings GROUP BY 1, 2, 3, 4),
 a AS (SELECT *, lon0 - 360 AS lon, sum(s) OVER w AS acc FROM c WINDOW w AS (PARTITION BY run_date, lat, lon0 ORDER BY ts)),
 d AS (SELECT *, lag(acc) OVER (PARTITION BY run_date, lat, lon ORDER BY ts) AS prev FROM a WHERE lat BETWEEN 36 AND 44 AND lon BETWEEN -9.5 AND 4.5),
 r AS (SELECT *, greatest(0, (acc - prev) / 10800) AS rate FROM d WHERE prev IS NOT NULL)"""


@query(
    "forecast_steps_mean",
    "C14 W07 A32 P12 P16 F19",
    f"""WITH {_RUN_CELLS} SELECT {day('run_date')} AS run_date, {stamp('ts')} AS ts, {num('avg(v)')} AS t2m_mean, {num('avg(v / 2)')} AS d2m_mean,
 {num('avg(sqrt(v * v + q * q))')} AS wind10_mean, {num('avg(sqrt(4 * v * v + q * q))')} AS wind100_mean, {num('avg(q)')} AS wind_gust10_mean,
 {num('avg(rate)')} AS ssrd_mean, {num('avg(q / 100)')} AS tcc_mean, {num('avg(rate / 1000 * 10800 * 1000)')} AS tp_mean, {num('avg(v + 1000)')} AS msl_mean FROM r GROUP BY run_date, ts""",
)
def forecast_steps_mean(spark, sf):
    """Steps of each forecast run with running totals, to rates and their mean over the box."""
    from pyspark.sql import Window

    r = s.readings(spark, sf)
    step = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 10800) * 10800)
    keys = [F.to_date("ts").alias("run_date"), (F.lit(35.0) + F.col("user_id") % 11).alias("lat"), (F.lit(350.0) + F.col("user_id") % 5).alias("lon"), step.alias("valid_time")]
    cells = r.groupBy(*keys).agg(F.avg("value").alias("v"), F.avg(F.col("qty").cast("double")).alias("q"), F.sum("value").alias("s"))
    so_far = F.sum("s").over(Window.partitionBy("run_date", "lat", "lon").orderBy("valid_time").rowsBetween(Window.unboundedPreceding, 0))
    v, q = F.col("v"), F.col("q")
    grid = cells.select(
        "run_date", "lat", "lon", "valid_time", v.alias("t2m"), (v / 2).alias("d2m"), v.alias("u10"), q.alias("v10"), (v * 2).alias("u100"), q.alias("v100"),
        q.alias("wind_gust10"), so_far.alias("ssrd"), (q / 100).alias("tcc"), (so_far / 1000).alias("tp"), (v + 1000).alias("msl"),
    )
    return feeds.forecast_aggregate(grid)


_FIELDS = {"t2m": "v", "d2m": "v / 2", "u10": "v", "v10": "q", "u100": "v * 2", "v100": "q", "wind_gust10": "v", "ssrd": "v * 3600", "tcc": "q / 100", "tp": "q / 1000", "msl": "v + 1000"}


@query(
    "weather_best_version",
    "C14 J21 A32",
    f"""WITH {s.READINGS}, g AS (SELECT date_trunc('hour', ts) AS ts, CAST(36.0 AS DOUBLE) + user_id % 8 AS lat, CAST(-9.0 AS DOUBLE) + user_id % 13 AS lon, user_id % 3 AS version,
 avg(value) FILTER (WHERE series <> 'view' OR user_id % 3 > 0) AS v, avg(CAST(qty AS DOUBLE)) AS q FROM readings GROUP BY 1, 2, 3, 4),
 b AS (SELECT ts, lat, lon, arg_min(v, version) FILTER (WHERE v IS NOT NULL) AS v, arg_min(q, version) FILTER (WHERE q IS NOT NULL) AS q FROM g GROUP BY 1, 2, 3),
 c AS (SELECT ts, v AS t2m, v / 2 AS d2m, sqrt(v * v + q * q) AS wind10, sqrt(4 * v * v + q * q) AS wind100, v AS wind_gust10, v AS ssrd, q / 100 AS tcc, q AS tp, v + 1000 AS msl FROM b)
 SELECT {stamp('ts')} AS ts, {', '.join(f"{num(f'avg({c.removesuffix("_mean")})')} AS {c}" for c in reg.WEATHER_COLUMNS)},
 {big("row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts) - 1")} AS tensor_index FROM c GROUP BY ts""",
)
def weather_best_version(spark, sf):
    """Final and preliminary versions of the same cells: the final one counts where it has a value."""
    r = s.readings(spark, sf)
    known = (F.col("series") != "view") | (F.col("user_id") % 3 > 0)
    keys = [clock.hour_floor(F.col("ts")).alias("ts"), (F.lit(36.0) + F.col("user_id") % 8).alias("lat"), (F.lit(-9.0) + F.col("user_id") % 13).alias("lon"), (F.col("user_id") % 3).alias("version")]
    cells = r.groupBy(*keys).agg(F.avg(F.when(known, F.col("value"))).alias("v"), F.avg(F.col("qty").cast("double")).alias("q"))
    grid = cells.selectExpr("ts", "lat", "lon", "version", *[f"{e} AS {n}" for n, e in _FIELDS.items()])
    return feeds.reanalysis_aggregate(grid, "version")
