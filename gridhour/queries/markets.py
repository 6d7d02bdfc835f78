"""Futures, weather and landed-text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions import clock, energy, labels
from gridhour.functions.numbers import number_from_text
from gridhour.operators import calendar, dedupe, futures, weather
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, day_length, day_start, ldate, num, query, stamp, table
from gridhour.sources import gas_index, indicators, market_files, tables, trades

# Futures --------------------------------------------------------------------------------


@query(
    "ohlc_vwap",
    "A10 W14 M09",
    f"""WITH {s.TRADES} SELECT {day(ldate('deal_date'))} AS fecha, commodity, periodo, {big('min(item_id)')} AS item_id,
 {num('arg_min(precio, (deal_date, trade_id))')} AS apertura, {num('max(precio)')} AS maximo, {num('min(precio)')} AS minimo,
 {num('arg_max(precio, (deal_date, trade_id))')} AS cierre,
 {num('round(sum(precio * greatest(cantidad, 1)) / sum(greatest(cantidad, 1)), 3)')} AS vwap, {big('sum(greatest(cantidad, 1))')} AS volumen,
 {big('count(*)')} AS n_trades, {num('round(100.0 * count(*) FILTER (WHERE agresor_compra) / count(*), 1)')} AS pct_agresor_compra
 FROM trades GROUP BY {day(ldate('deal_date'))}, commodity, periodo""",
)
def ohlc_vwap(spark, sf):
    return futures.daily_bars(s.trades(spark, sf))


_FRONT = f"""{s.BARS}, el AS (SELECT *, CASE WHEN commodity = 'EUA' THEN month(delivery) = 12 AND year(delivery) >= year(fecha)
 ELSE delivery > date_trunc('month', fecha) END AS ok FROM bars),
 front AS (SELECT commodity, fecha, cierre AS precio, periodo, delivery FROM el WHERE ok QUALIFY row_number() OVER (PARTITION BY commodity, fecha ORDER BY delivery) = 1),
 steps AS (SELECT *, lag(fecha) OVER w AS pf, lag(precio) OVER w AS pp, lag(periodo) OVER w AS pc FROM front WINDOW w AS (PARTITION BY commodity ORDER BY fecha)),
 turns AS (SELECT t.*, b.cierre - t.pp AS prima FROM (SELECT * FROM steps WHERE pc IS NOT NULL AND pc <> periodo) t
 LEFT JOIN bars b ON b.commodity = t.commodity AND b.fecha = t.pf AND b.delivery = t.delivery)"""


def _front(spark, sf):
    return futures.front_series(s.bars(spark, sf), reg.FRONT_RULES)


def _series_and_rolls(spark, sf):
    bars = s.bars(spark, sf)
    series = futures.front_series(bars, reg.FRONT_RULES)
    return series, futures.rolls(series, bars)


@query(
    "front_contract",
    "W08 J19 F14",
    f"""WITH {_FRONT} SELECT commodity, {day('fecha')} AS fecha, {num('precio')} AS precio, periodo, {day('delivery')} AS delivery FROM front""",
)
def front_contract(spark, sf):
    return _front(spark, sf)


_ROLL = f"""commodity, {day('pf')} AS prev_fecha, {num('pp')} AS prev_precio, pc AS prev_periodo, {day('fecha')} AS fecha, {num('precio')} AS precio,
 periodo, {num('precio - pp')} AS salto, {num('prima')} AS prima"""


@query("roll_premium", "W09", f"WITH {_FRONT} SELECT {_ROLL} FROM turns")
def roll_premium(spark, sf):
    return _series_and_rolls(spark, sf)[1]


@query(
    "first_and_last_rolls",
    "O05",
    f"""WITH {_FRONT} SELECT {_ROLL} FROM turns QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY fecha) <= 6
 OR row_number() OVER (PARTITION BY commodity ORDER BY fecha DESC) <= 6""",
)
def first_and_last_rolls(spark, sf):
    return futures.first_and_last(_series_and_rolls(spark, sf)[1])


@query(
    "roll_report",
    "Q11 W10",
    f"""WITH {_FRONT}, t AS (SELECT commodity, count(*) AS n_days, min(precio) AS lo, max(precio) AS hi, avg(abs(precio - pp)) AS tc FROM steps GROUP BY 1),
 j AS (SELECT commodity, count(*) AS n_rolls, avg(abs(precio - pp)) AS mj, avg(prima) AS mp, count(prima) AS np FROM turns GROUP BY 1)
 SELECT commodity, {big('n_days')} AS n_days, {num('lo')} AS precio_min, {num('hi')} AS precio_max, {num('tc')} AS typical_change, {big('n_rolls')} AS n_rolls,
 {num('mj')} AS mean_jump, {num('mp')} AS mean_premium, {big('np')} AS n_premium, {num('mj / nullif(tc, 0)')} AS jump_ratio FROM t LEFT JOIN j USING (commodity)""",
)
def roll_report(spark, sf):
    return futures.roll_report(*_series_and_rolls(spark, sf))


@query(
    "top_contract_year",
    "W13 J17",
    f"""WITH {s.BARS}, y AS (SELECT year(fecha) AS anio, commodity, periodo, sum(volumen) AS v, round(avg(cierre), 2) AS c, round(min(minimo), 2) AS lo,
 round(max(maximo), 2) AS hi, sum(n_trades) AS ops, count(*) AS dias FROM bars GROUP BY 1, 2, 3)
 SELECT {big('anio')} AS anio, commodity, periodo, {num('c')} AS cierre_medio, {num('lo')} AS minimo, {num('hi')} AS maximo, {big('ops')} AS operaciones, {big('dias')} AS dias
 FROM y QUALIFY row_number() OVER (PARTITION BY anio, commodity ORDER BY v DESC, periodo) = 1""",
)
def top_contract_year(spark, sf):
    return futures.top_contract_per_year(s.bars(spark, sf))


_MONTHS = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"


@query(
    "active_contracts",
    "F16",
    f"""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
 m AS (SELECT a, z, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', z) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS d FROM b),
 y AS (SELECT a, z, make_date(unnest(generate_series(year(a), year(z) + 2)), 12, 1) AS d FROM b),
 x AS (SELECT 'monthly' AS kind, d, greatest(CAST(d - INTERVAL 12 MONTH AS DATE), a) AS desde, least(CAST(d + INTERVAL 1 MONTH AS DATE), z + 1) AS hasta FROM m
 UNION ALL SELECT 'december', d, greatest(make_date(year(d) - 3, 1, 1), a), least(make_date(year(d) + 1, 1, 1), z + 1) FROM y)
 SELECT kind, {_MONTHS}[month(d)] || '-' || strftime(d, '%y') AS periodo, {day('d')} AS delivery, {day('desde')} AS desde, {day('hasta')} AS hasta FROM x WHERE hasta > desde""",
)
def active_contracts(spark, sf):
    bounds = calendar.day_bounds(table(spark, sf, "orders"), "o_orderdate")
    monthly = futures.active_monthly_contracts(bounds).select(F.lit("monthly").alias("kind"), "*")
    return monthly.unionByName(futures.active_december_contracts(bounds).select(F.lit("december").alias("kind"), "*"))


@query(
    "parse_contract_label",
    "F14",
    f"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN 'Foo' ELSE {_MONTHS}[1 + p_partkey % 12] END || '-' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') AS label FROM part)
 SELECT {big('k')} AS k, label, CASE WHEN k % 4 <> 3 THEN {day('make_date(2000 + k % 40, 1 + k % 12, 1)')} END AS delivery FROM p""",
)
def parse_contract_label(spark, sf):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(m) for m in labels.CONTRACT_MONTHS])
    month = F.when(k % 4 == 3, "Foo").otherwise(F.element_at(names, (k % 12 + 1).cast("int")))
    label = F.concat(month, F.lit("-"), F.lpad((k % 40).cast("string"), 2, "0"))
    p = table(spark, sf, "part").select(k.alias("k"), label.alias("label"))
    return p.withColumn("delivery", labels.contract_delivery(F.col("label")))


# Weather --------------------------------------------------------------------------------


def _grid(spark, sf):
    """Readings as grid cells: user picks the cell, quantity and value the fields."""
    r = s.readings(spark, sf)
    v, q = F.col("value"), F.col("qty").cast("double")
    return r.select(
        clock.hour_floor(F.col("ts")).alias("ts"),
        (F.lit(34.0) + F.col("user_id") % 33 * 0.4).alias("lat"),
        (F.lit(345.0) + F.col("user_id") % 57 * 0.5).alias("lon"),
        v.alias("t2m"), (v / 2).alias("d2m"), v.alias("u10"), q.alias("v10"), (v * 2).alias("u100"), q.alias("v100"),
        F.when(q > 10, v).alias("i10fg"), (v * 3600).alias("ssrd"), (q / 100).alias("tcc"), (q / 1000).alias("tp"), (v + 1000).alias("msl"),
    ).withColumnRenamed("i10fg", "wind_gust10")


_GRID = f"""{s.READINGS}, g0 AS (SELECT date_trunc('hour', ts) AS ts, CAST(34.0 AS DOUBLE) + user_id % 33 * CAST(0.4 AS DOUBLE) AS lat, CAST(345.0 AS DOUBLE) + user_id % 57 * CAST(0.5 AS DOUBLE) AS lon0,
 value AS v, CAST(qty AS DOUBLE) AS q FROM readings), g AS (SELECT *, (lon0 + 180) % 360 - 180 AS lon FROM g0),
 box AS (SELECT * FROM g WHERE lat BETWEEN 36 AND 44 AND lon BETWEEN -9.5 AND 4.5)"""


@query(
    "weather_grid_mean",
    "A32 C14 P12 P16 F19 W17 S12",
    f"""WITH {_GRID} SELECT {stamp('ts')} AS ts, {num('avg(v)')} AS t2m_mean, {num('avg(v / 2)')} AS d2m_mean, {num('avg(sqrt(v * v + q * q))')} AS wind10_mean,
 {num('avg(sqrt(4 * v * v + q * q))')} AS wind100_mean, {num('avg(v) FILTER (WHERE q > 10)')} AS wind_gust10_mean, {num('avg(v)')} AS ssrd_mean,
 {num('avg(q / 100)')} AS tcc_mean, {num('avg(q)')} AS tp_mean, {num('avg(v + 1000)')} AS msl_mean,
 {big("row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts) - 1")} AS tensor_index FROM box GROUP BY ts""",
)
def weather_grid_mean(spark, sf):
    from gridhour.plans.feeds import reanalysis_aggregate

    return reanalysis_aggregate(_grid(spark, sf))


_RUNS = f"""{s.READINGS}, steps AS (SELECT CAST(ts AS DATE) AS run_date, user_id % 33 AS lat, user_id % 5 AS lon,
 date_trunc('hour', ts) - INTERVAL 1 HOUR * (extract('hour' FROM ts) % 3) AS valid_time, sum(value) AS s FROM readings GROUP BY 1, 2, 3, 4),
 acc AS (SELECT *, sum(s) OVER (PARTITION BY run_date, lat, lon ORDER BY valid_time) AS ssrd FROM steps),
 d AS (SELECT *, lag(ssrd) OVER w AS prev FROM acc WINDOW w AS (PARTITION BY run_date, lat, lon ORDER BY valid_time))"""


@query(
    "deaccumulate",
    "W07",
    f"""WITH {_RUNS} SELECT {day('run_date')} AS run_date, {big('lat')} AS lat, {big('lon')} AS lon, {stamp('valid_time')} AS valid_time,
 {num('greatest(0, (ssrd - prev) / 10800 * 1000)')} AS ssrd_k FROM d WHERE prev IS NOT NULL""",
)
def deaccumulate(spark, sf):
    from pyspark.sql import Window

    r = s.readings(spark, sf)
    step = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 10800) * 10800)
    steps = r.groupBy(
        F.to_date("ts").alias("run_date"), (F.col("user_id") % 33).alias("lat"), (F.col("user_id") % 5).alias("lon"), step.alias("valid_time")
    ).agg(F.sum("value").alias("s"))
    totals = steps.withColumn("ssrd", F.sum("s").over(Window.partitionBy("run_date", "lat", "lon").orderBy("valid_time")))
    out = weather.deaccumulate(totals, ["ssrd"], 10800.0)
    return out.select("run_date", "lat", "lon", "valid_time", (F.col("ssrd") * 1000).alias("ssrd_k"))


@query(
    "forecast_grid_mean",
    "W07 A32",
    f"""WITH {_RUNS} SELECT {day('run_date')} AS run_date, {stamp('valid_time')} AS ts, {num('avg(greatest(0, (ssrd - prev) / 10800 * 1000))')} AS ssrd_k_mean
 FROM d WHERE prev IS NOT NULL GROUP BY run_date, valid_time""",
)
def forecast_grid_mean(spark, sf):
    cells = deaccumulate(spark, sf).withColumnRenamed("valid_time", "ts")
    return weather.spatial_mean(cells, ["ssrd_k"], ["run_date", "ts"])


@query(
    "cell_channels",
    "F27",
    f"""WITH {s.READINGS} SELECT {big('event_id')} AS event_id, {num('CAST(value AS FLOAT)')} AS c1, true AS c2_is_nan, {num('CAST(qty AS FLOAT)')} AS c3, {big('3')} AS n FROM readings""",
)
def cell_channels(spark, sf):
    r = s.readings(spark, sf).select("event_id", F.col("value").alias("t2m"), F.col("qty").alias("msl"))
    c = weather.cell_channels(r, ["event_id"], ("t2m", "d2m", "msl"))
    return c.select(
        "event_id",
        F.col("channels")[0].alias("c1"),
        F.isnan(F.col("channels")[1]).alias("c2_is_nan"),
        F.col("channels")[2].alias("c3"),
        F.size("channels").alias("n"),
    )


# Landed text ----------------------------------------------------------------------------


@query(
    "iso_json_flatten",
    "S08 F01 P14",
    f"""WITH {s.READINGS} SELECT {stamp('ts')} AS ts, {num('value')} AS value, {big("CASE WHEN series = 'view' THEN 8741 END")} AS geo_id,
 {big('event_id')} AS indicator_id FROM readings WHERE qty > 4 AND series <> 'click'""",
)
def iso_json_flatten(spark, sf):
    """Documents are written as JSON text from the readings, then parsed back. One series is
    peninsular, one belongs to another system, the others have no geography."""
    r = s.readings(spark, sf)
    text = F.to_json(
        F.struct(
            F.struct(
                F.col("event_id").alias("id"),
                F.array(
                    F.struct(
                        F.concat(F.date_format(clock.local_ts(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")).alias("datetime"),
                        F.when(F.col("qty") > 4, F.col("value")).alias("value"),
                        F.when(F.col("series") == "view", 8741).when(F.col("series") == "click", 3).cast("bigint").alias("geo_id"),
                    )
                ).alias("values"),
            ).alias("indicator")
        )
    )
    flat = indicators.flatten(indicators.parse_documents(r.select(text.alias("doc")), "doc"))
    return indicators.peninsular(flat, allow_missing=True).select("ts", "value", "geo_id", "indicator_id")


@query(
    "geo_kinds",
    "P15 A09",
    f"""WITH g AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'Illes Balears ' WHEN 1 THEN 'Gran Canaria ' ELSE 'Madrid ' END || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT {big('id')} AS geo_id, name AS geo_name, CASE WHEN id IN (3, 8741) THEN 'aggregate' WHEN lower(name) LIKE '%balear%' OR lower(name) LIKE '%canaria%' THEN 'off_peninsula' ELSE 'peninsular' END AS kind FROM g""",
)
def geo_kinds(spark, sf):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, "Illes Balears ").when(k % 4 == 1, "Gran Canaria ").otherwise("Madrid ")
    g = table(spark, sf, "nation").select(k.alias("geo_id"), F.concat(name, F.col("n_name")).alias("geo_name"))
    return g.withColumn("kind", indicators.geo_kind(F.col("geo_id"), F.col("geo_name")))


@query(
    "regions_wide",
    "A09 A33 Q14",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS d, {', '.join(f"avg(value) FILTER (WHERE event_type = '{t}') AS v_{t}" for t in s.TYPES)} FROM events GROUP BY 1)
 SELECT {day('d')} AS day, {', '.join(f'{num(f"v_{t}")} AS "{t}"' for t in s.TYPES)}, {num(' + '.join(f'coalesce(v_{t}, 0)' for t in s.TYPES))} AS regions_total FROM d""",
)
def regions_wide(spark, sf):
    named = s.readings(spark, sf).select(F.to_date("ts").alias("day"), F.col("series").alias("geo_name"), "value")
    return indicators.regions_wide(named, "day", s.TYPES)


@query(
    "parse_market_numbers",
    "F10",
    f"""SELECT {big('o_orderkey')} AS k, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE {num('o_totalprice')} END AS parsed FROM orders""",
)
def parse_market_numbers(spark, sf):
    """Prices are written with Spanish or English separators, or spoiled, then parsed back."""
    o = table(spark, sf, "orders")
    kind = F.col("o_orderpriority")
    english = F.format_number("o_totalprice", 2)
    spanish = F.translate(english, ",.", ".,")
    text = (
        F.when(kind == "1-URGENT", F.concat(english, F.lit(" EUR")))
        .when(kind == "2-HIGH", F.lit("  "))
        .when(kind == "3-MEDIUM", F.concat(F.lit(" "), F.translate(spanish, ".", "")))
        .otherwise(spanish)
    )
    return o.select(F.col("o_orderkey").alias("k"), number_from_text(text).alias("parsed"))


@query(
    "epoch_unit_detect",
    "F17",
    f"""SELECT {big('event_id')} AS event_id, {stamp("CASE WHEN event_id % 3 = 2 THEN date_trunc('second', ts) ELSE ts END")} AS deal_date FROM events""",
)
def epoch_unit_detect(spark, sf):
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, micros * 1000).when(k == 1, F.floor(micros / 1000)).otherwise(F.floor(micros / 1000000))
    return e.select("event_id", clock.epoch_any_unit(raw.cast("double")).alias("deal_date"))


@query(
    "clean_trades",
    "S11 P10 F26 F09",
    f"""WITH {s.READINGS} SELECT CAST(event_id AS VARCHAR) AS trade_id, {stamp('ts')} AS deal_date, {num('round(value, 3)')} AS precio,
 {big('CASE WHEN qty > 30 THEN qty ELSE 0 END')} AS cantidad, CASE WHEN user_id % 3 = 0 THEN true ELSE false END AS agresor_compra
 FROM readings WHERE qty >= 20 AND value <= 200""",
)
def clean_trades(spark, sf):
    return trades.clean(_raw_trades(spark, sf)).drop("venue")


def _raw_trades(spark, sf):
    """Raw trades; small quantities have no id or an unreadable price, high prices are out of
    range."""
    qty = F.col("qty")
    price = F.when(qty.between(10, 19), "n/a").when(F.col("value") > 200, "9999").otherwise(F.col("value").cast("string"))
    return s.readings(spark, sf).select(
        F.when(qty >= 10, F.col("event_id").cast("string")).alias("tradeId"),
        F.lit("X").alias("venueCode"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("double").alias("dealDate"),
        price.alias("price"),
        F.when(F.col("qty") > 30, F.col("qty").cast("double")).alias("quantity"),
        F.when(F.col("user_id") % 3 < 2, F.col("user_id") % 3 == 0).alias("aggressorBuy"),
    )


@query(
    "clean_trades_counts",
    "S11",
    f"""WITH {s.READINGS} SELECT {big('count(*) FILTER (WHERE qty >= 20 AND value <= 200)')} AS n_kept,
 {big('count(*) FILTER (WHERE NOT (qty >= 20 AND value <= 200))')} AS n_rejected FROM readings""",
)
def clean_trades_counts(spark, sf):
    return trades.clean_counts(_raw_trades(spark, sf))


@query(
    "gas_index_sheet",
    "S10 F20 W12",
    f"""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, o_totalprice / 1000 AS p FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
 SELECT {day('d')} AS fecha, {num('round(CAST(p AS DECIMAL(18, 6)), 3)')} AS gas_mibgas FROM r QUALIFY row_number() OVER (PARTITION BY d ORDER BY k) = 1""",
)
def gas_index_sheet(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.col("o_orderpriority")
    sheet = o.select(
        F.when(kind == "1-URGENT", "not a day").when(kind == "3-MEDIUM", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Delivery day"),
        F.lit("1").alias("MIBGAS LNG Index"),
        F.when(kind == "2-HIGH", "-").otherwise((F.col("o_totalprice") / 1000).cast("string")).alias("MIBGAS Index [EUR/MWh]"),
        "o_orderkey",
    )
    return gas_index.clean(sheet, ["o_orderkey"])


@query(
    "daily_close_series",
    "S17",
    f"""WITH {s.DAILY_PRICE} SELECT {day('fecha')} AS fecha, {num('v')} AS gas_ttf FROM daily_price WHERE v IS NOT NULL""",
)
def daily_close_series(spark, sf):
    d = s.daily_price(spark, sf)
    landed = d.select(F.col("fecha").cast("string").alias("Date"), F.coalesce(F.col("v").cast("string"), F.lit("NaN")).alias("Close"))
    return tables.daily_close(landed, "Date", "Close", "gas_ttf")


@query(
    "discovered_price_columns",
    "S13 F18",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS datetime, 'ES' AS zone, 'esios' AS source, 'es_esios' AS column_name, {num('view')} AS price FROM hourly WHERE view IS NOT NULL
 UNION ALL SELECT {stamp('ts')}, 'DE_LU', 'entsoe', 'de_lu_entsoe', {num('click')} FROM hourly WHERE click IS NOT NULL""",
)
def discovered_price_columns(spark, sf):
    h = s.hourly_by_type(spark, sf)
    wide = h.select(
        F.col("ts").alias("datetime"), F.col("view").alias("es_esios"), F.col("click").alias("de_lu_entsoe"),
        F.col("error").alias("it_nord_omie"), F.col("signup").alias("something_else"),
    )
    return tables.prices_long(wide, "datetime")


def _market_files(spark, sf):
    """One market file per local day, written from the hourly prices.

    Even days use hourly labels, odd days four quarters per hour in a scrambled order. A
    day with a missing hour makes an incomplete file, which must be rejected. A file holds
    at most 100 labels, so collecting them per day is bounded.
    """
    h = s.hourly_by_type(spark, sf).select("ts", F.round(F.col("price") + 1e-9, 2).alias("p"))
    local_day = clock.local_date(F.col("ts"))
    first = clock.day_start(local_day)
    hour = ((F.unix_timestamp("ts") - F.unix_timestamp(first)) / 3600 + 1).cast("int")
    quarters = F.when(F.dayofmonth(local_day) % 2 == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(q) for q in (1, 2, 3, 4)]))
    cells = h.select(local_day.alias("d"), hour.alias("h"), "p", F.explode(quarters).alias("q"))
    label = F.when(F.col("q") == 0, F.col("h").cast("string")).otherwise(F.format_string("H%dQ%d", "h", "q"))
    price = F.col("p") + F.when(F.col("q") > 0, (F.col("q") - 1) * 0.5).otherwise(0.0)
    text = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    cells = cells.select("d", F.struct(F.hash("d", "h", "q").alias("o"), label.alias("label"), text(price).alias("es"), text(price + 1).alias("pt")).alias("c"))
    files = cells.groupBy("d").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    line = lambda name, f: F.concat(F.lit(name), F.array_join(F.transform("cs", lambda c: c[f]), ";"), F.lit(";"))
    day_text = F.date_format("d", "dd/MM/yyyy")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("OMIE;Fecha Emision :"), day_text, F.lit(" - 13:49;;"), day_text, F.lit(";")),
        F.lit(""),
        line(";", "label"),
        line("Precio marginal en el sistema español (EUR/MWh);", "es"),
        line("Precio marginal en el sistema portugués (EUR/MWh);", "pt"),
    )
    return files.select(F.col("d").alias("file"), body.alias("text"))


_FILES = f"""{s.HOURLY}, p AS (SELECT ts, {ldate('ts')} AS d, round(price + 1e-9, 2) AS p FROM hourly),
 ok AS (SELECT d FROM p GROUP BY d HAVING count(*) = {day_length('d')})"""


@query(
    "market_file_hours",
    "S09 A04 F11 F12 F13 R9 R10",
    f"""WITH {_FILES} SELECT {day('d')} AS file, {day('d')} AS delivery, {big(f'(epoch(ts) - epoch({day_start("d")})) / 3600 + 1')} AS hour,
 {num('round(CASE WHEN day(d) % 2 = 0 THEN p ELSE p + 0.75 END + 1e-9, 2)')} AS es_omie, {num('round(CASE WHEN day(d) % 2 = 0 THEN p + 1 ELSE p + 1.75 END + 1e-9, 2)')} AS pt_omie,
 {stamp('ts')} AS ts FROM p JOIN ok USING (d)""",
)
def market_file_hours(spark, sf):
    return market_files.hourly_prices(market_files.parse(_market_files(spark, sf), expected="file"))


@query(
    "market_file_rejects",
    "S09 R9",
    f"""WITH {_FILES} SELECT DISTINCT {day('d')} AS file, {day('d')} AS delivery, 'number of values fits neither format' AS reason FROM p WHERE d NOT IN (SELECT d FROM ok)""",
)
def market_file_rejects(spark, sf):
    return market_files.rejected(market_files.parse(_market_files(spark, sf), expected="file"))


@query(
    "labelled_hours",
    "A04 F12",
    f"""WITH {s.READINGS}, c AS (SELECT CAST(ts AS DATE) AS d, extract('hour' FROM ts) + 1 AS h, user_id % 2 + 1 AS q, round(avg(value) + 1e-9, 4) AS v FROM readings GROUP BY 1, 2, 3),
 g AS (SELECT d, h, avg(v) AS v, count(*) AS n FROM c GROUP BY 1, 2), ok AS (SELECT d FROM g GROUP BY d HAVING count(*) = 24 AND min(n) = 2 AND max(n) = 2)
 SELECT {day('d')} AS d, {big('h')} AS hour, {num('round(v + 1e-9, 2)')} AS v FROM g JOIN ok USING (d)""",
)
def labelled_hours(spark, sf):
    from gridhour.operators import resample

    r = s.readings(spark, sf)
    label = F.format_string("H%dQ%d", F.hour("ts") + 1, F.col("user_id") % 2 + 1)
    cells = r.groupBy(F.to_date("ts").alias("d"), label.alias("label")).agg(
        F.round(F.avg("value") + 1e-9, 4).cast("decimal(18,4)").alias("v")
    )
    cells = cells.withColumns({"hour": labels.header_hour(F.col("label")), "n": F.lit(24), "k": F.lit(2)})
    return resample.labelled_hours(cells, "d", "hour", "v", "n", "k")


@query(
    "trade_dedupe_by_id",
    "W11 M01",
    f"""WITH {s.READINGS} SELECT CAST(qty AS VARCHAR) AS trade_id, {big('max(event_id)')} AS event_id FROM readings GROUP BY qty""",
)
def trade_dedupe_by_id(spark, sf):
    r = s.readings(spark, sf).select(F.col("qty").cast("string").alias("trade_id"), "event_id")
    return dedupe.keep_last(r, ["trade_id"], ["event_id"])


@query(
    "wind_modulus",
    "F19",
    f"""WITH {s.READINGS} SELECT {big('event_id')} AS event_id, {num('sqrt(value * value + qty * qty)')} AS wind FROM readings""",
)
def wind_modulus(spark, sf):
    return s.readings(spark, sf).select("event_id", energy.modulus(F.col("value"), F.col("qty")).alias("wind"))
