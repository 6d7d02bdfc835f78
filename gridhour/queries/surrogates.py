"""Energy-shaped views of the given tables, each with the same view in SQL.

``events`` plays the sub-hour readings: the type is the series, the value the power or
price, ``k`` in ``props`` a quantity, the parity of the user a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions.clock import hour_floor
from gridhour.queries.base import table
from gridhour.session import scratch_path

TYPES = ["view", "signup", "error", "click", "purchase"]


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("series"),
        "value",
        (F.col("user_id") % 2).alias("source"),
        F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
    )


READINGS = """readings AS (SELECT event_id, ts, user_id, event_type AS series, value, user_id % 2 AS source,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS qty FROM events)"""


def hourly_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly mean per series as columns, and over all series as ``price``."""
    e = table(spark, sf, "events")
    cells = [F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TYPES]
    return e.groupBy(hour_floor(F.col("ts")).alias("ts")).agg(*cells, F.avg("value").alias("price"))


_CELLS = ", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES)
HOURLY = f"hourly AS (SELECT date_trunc('hour', ts) AS ts, {_CELLS}, avg(value) AS price FROM events GROUP BY 1)"


def spread(columns: tuple[str, ...] | list[str], offset: int) -> list[tuple[str, str, int]]:
    """(column, series, factor): registered columns dealt over the series."""
    return [(c, TYPES[(i + offset) % 5], 1 + i // 5) for i, c in enumerate(columns)]


# Hourly tables of the model, as column lists dealt over the five series.
GEN_COLUMNS = (
    "solar_mw", "wind_mw", "hydro_run_river_mw", "hydro_reservoir_mw", "pumping_gen_mw", "pumping_cons_mw",
    "biomass_mw", "waste_mw", "other_renewable_mw", "oil_mw", "gas_mw", "nuclear_mw",
)
ESIOS_COLUMNS = (
    "ree_gsolter_mw", "ree_gbattery_mw", "ree_cbattery_mw", "ree_gnuclear_mw", "ree_gccgas_mw",
    "ree_gotherthermal_mw", "ree_gcoal_mw", "ree_gsolar_mw", "ree_gwind_mw", "ree_gpumping_mw", "ree_cpumping_mw",
    "ree_ghidro_mw",
)
LOAD_TABLE_COLUMNS = (
    "ree_load", "entsoe_load", "ree_ntc_impfr", "ree_ntc_expfr", "ree_netflow_fr", "ree_ntc_imppt", "ree_ntc_exppt",
    "ree_netflow_pt", "ree_ntc_impma", "ree_ntc_expma", "ree_netflow_ma", "total_net_flow_mw", "gen_peninsular_mw",
)
HOURLY_TABLES = {
    "entsoe_gen_data": spread(GEN_COLUMNS, 0),
    "esios_gen": spread(ESIOS_COLUMNS, 2),
    "load_inter": spread(LOAD_TABLE_COLUMNS, 1),
    "esios_forecast_da": spread(reg.FORECAST_COLUMNS, 3),
    "entsoe_forecast_da": spread(reg.ENTSOE_FORECAST_COLUMNS, 4),
    "spot_price": [("es_esios", "price", 1), ("pt_entsoe", "click", 1), ("fr_entsoe", "purchase", 1)],
}


def hourly_table(hourly: DataFrame, name: str) -> DataFrame:
    return hourly.selectExpr("ts AS datetime", *[f"{t} * {float(k)}D AS {c}" for c, t, k in HOURLY_TABLES[name]])


def hourly_table_sql(name: str) -> str:
    cells = ", ".join(f"{t} * {float(k)} AS {c}" for c, t, k in HOURLY_TABLES[name])
    return f"{name} AS (SELECT ts AS datetime, {cells} FROM hourly)"


def weather_table(hourly: DataFrame) -> DataFrame:
    """3-hourly rows."""
    cells = [f"{t} * {float(k)}D AS {c}" for c, t, k in spread(reg.WEATHER_COLUMNS, 2)]
    return hourly.where(F.hour("ts") % 3 == 0).selectExpr("ts", *cells)


_WX = ", ".join(f"{t} * {float(k)} AS {c}" for c, t, k in spread(reg.WEATHER_COLUMNS, 2))
WEATHER = f"era5_weather_agg AS (SELECT ts, {_WX} FROM hourly WHERE extract('hour' FROM ts) % 3 = 0)"


def commodities_table(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rows; markets are closed at weekends, so values are missing there."""
    e = table(spark, sf, "events")
    open_day = F.weekday("ts") < 5
    cells = [
        F.avg(F.when(open_day & (F.col("event_type") == t), F.col("value") * float(k))).alias(c)
        for c, t, k in spread(reg.COMMODITY_COLUMNS, 1)
    ]
    return e.groupBy(F.to_date("ts").alias("fecha")).agg(*cells)


_COMM = ", ".join(
    f"avg(value * {float(k)}) FILTER (WHERE isodow(ts) < 6 AND event_type = '{t}') AS {c}"
    for c, t, k in spread(reg.COMMODITY_COLUMNS, 1)
)
COMMODITIES = f"commodities AS (SELECT CAST(ts AS DATE) AS fecha, {_COMM} FROM events GROUP BY 1)"


def capacity_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("date")).agg(F.max("value").alias("total_mw"))


CAPACITY = "esios_capacity_available AS (SELECT CAST(ts AS DATE) AS date, max(value) AS total_mw FROM events GROUP BY 1)"


def model_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables of the model. Their common hourly frame is written once to the shared
    folder, as the hourly tables would be stored, instead of being recomputed per table."""
    path = scratch_path(spark, "hourly")
    hourly_by_type(spark, sf).write.parquet(path)
    hourly = spark.read.parquet(path)
    tables = {n: hourly_table(hourly, n) for n in HOURLY_TABLES}
    tables["era5_weather_agg"] = weather_table(hourly)
    tables["commodities"] = commodities_table(spark, sf)
    tables["esios_capacity_available"] = capacity_table(spark, sf)
    return tables


MODEL_TABLES = ",\n".join([HOURLY, *[hourly_table_sql(n) for n in HOURLY_TABLES], WEATHER, COMMODITIES, CAPACITY])


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade log: two commodities, contracts one to four months out."""
    r = readings(spark, sf)
    delivery = F.add_months(F.trunc(F.col("ts").cast("date"), "month"), (F.col("user_id") % 4 + 1).cast("int"))
    return r.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("trade_id"),
        F.when(F.col("source") == 0, "EUA").otherwise("TTF").alias("commodity"),
        F.date_format(delivery, "yyyy-MM").alias("periodo"),
        (F.col("user_id") % 4).cast("int").alias("item_id"),
        F.col("ts").cast("timestamp").alias("deal_date"),
        F.col("value").alias("precio"),
        F.col("qty").alias("cantidad"),
        (F.col("user_id") % 3 == 0).alias("agresor_compra"),
    )


TRADES = f"""{READINGS}, trades AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS trade_id,
 CASE WHEN source = 0 THEN 'EUA' ELSE 'TTF' END AS commodity,
 strftime(date_trunc('month', ts) + to_months(CAST(user_id % 4 + 1 AS INTEGER)), '%Y-%m') AS periodo,
 user_id % 4 AS item_id, ts AS deal_date, value AS precio, qty AS cantidad, user_id % 3 = 0 AS agresor_compra
 FROM readings)"""


SHIFT_DAYS = 9131


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars over several years: one price per day, commodity and contract.

    TTF contracts are 1 to 4 months out, EUA contracts are Decembers 0 to 3 years out.
    Order days are moved to 2020 and later, because contract labels name years after 2000.
    Bars are a stored table, so they are written once and read back.
    """
    from gridhour.functions.labels import contract_label

    o = table(spark, sf, "orders")
    fecha = F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS)
    step = (F.col("o_custkey") % 4).cast("int")
    ttf = F.add_months(F.trunc(fecha, "month"), step + 1)
    eua = F.make_date(F.year(fecha) + step, F.lit(12), F.lit(1))
    name = F.when(F.col("o_custkey") % 3 == 0, "EUA").otherwise("TTF")
    delivery = F.when(F.col("o_custkey") % 3 == 0, eua).otherwise(ttf)
    built = (
        o.select(fecha.alias("fecha"), name.alias("commodity"), contract_label(delivery).alias("periodo"), "o_totalprice")
        .groupBy("fecha", "commodity", "periodo")
        .agg(
            F.max("o_totalprice").alias("cierre"),
            F.min("o_totalprice").alias("minimo"),
            F.max("o_totalprice").alias("maximo"),
            F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("volumen"),
            F.count("*").alias("n_trades"),
        )
    )
    path = scratch_path(spark, "bars")
    built.write.parquet(path)
    return spark.read.parquet(path)


_NAMES = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
BARS = f"""moved AS (SELECT CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS fecha, o_totalprice, o_custkey FROM orders),
raw_bars AS (SELECT fecha, o_totalprice, CASE WHEN o_custkey % 3 = 0 THEN 'EUA' ELSE 'TTF' END AS commodity,
 CASE WHEN o_custkey % 3 = 0 THEN make_date(year(fecha) + o_custkey % 4, 12, 1)
 ELSE CAST(date_trunc('month', fecha) + to_months(CAST(o_custkey % 4 + 1 AS INTEGER)) AS DATE) END AS delivery FROM moved),
bars AS (SELECT fecha, commodity, delivery, {_NAMES}[month(delivery)] || '-' || strftime(delivery, '%y') AS periodo,
 max(o_totalprice) AS cierre, min(o_totalprice) AS minimo, max(o_totalprice) AS maximo,
 sum(floor(o_totalprice / 1000)) AS volumen, count(*) AS n_trades
 FROM raw_bars GROUP BY 1, 2, 3, 4)"""


def daily_price(spark: SparkSession, sf: str) -> DataFrame:
    """One row per calendar day with orders; NULL on days whose lowest price is small."""
    o = table(spark, sf, "orders")
    low = F.min("o_totalprice")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("fecha")).agg(
        F.when(low > 20000, low).alias("v"), F.max("o_totalprice").alias("w")
    )


DAILY_PRICE = """daily_price AS (SELECT CAST(o_orderdate AS DATE) AS fecha,
 CASE WHEN min(o_totalprice) > 20000 THEN min(o_totalprice) END AS v, max(o_totalprice) AS w FROM orders GROUP BY 1)"""


def monthly_first(spark: SparkSession, sf: str) -> DataFrame:
    """First known value of each month: a monthly series on irregular days."""
    known = daily_price(spark, sf).where(F.col("v").isNotNull())
    first = known.groupBy(F.trunc("fecha", "month")).agg(F.min("fecha").alias("fecha"), F.min_by("v", "fecha").alias("v"))
    return first.select("fecha", "v")


def stored_and_fresh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of an hourly table: even users stored it, odd users republished it.

    ``a`` and ``b`` are sparse, so cells are missing on both sides.
    """
    r = readings(spark, sf)

    def side(n: int) -> DataFrame:
        return (
            r.where(F.col("source") == n)
            .groupBy(hour_floor(F.col("ts")).alias("ts"))
            .agg(
                F.avg(F.when(F.col("series") == "view", F.col("value"))).alias("a"),
                F.avg(F.when(F.col("series") == "click", F.col("value"))).alias("b"),
            )
        )

    return side(0), side(1)


STORED_FRESH = (
    READINGS
    + "".join(
        f""", {n} AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE series = 'view') AS a,
 avg(value) FILTER (WHERE series = 'click') AS b FROM readings WHERE source = {i} GROUP BY 1)"""
        for i, n in enumerate(["stored", "fresh"])
    )
)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal table: run day, target day 0 to 7 days ahead, mean value per series."""
    r = readings(spark, sf)
    run = F.to_date("ts")
    return r.groupBy(
        run.alias("run_date"), F.date_add(run, (F.col("user_id") % 8).cast("int")).alias("target_date")
    ).agg(
        F.avg(F.when(F.col("series") == "view", F.col("value"))).alias("nuclear_mw"),
        F.avg(F.when(F.col("series") == "click", F.col("value"))).alias("ccgt_mw"),
    )


SNAPSHOTS = f"""{READINGS}, snapshots AS (SELECT CAST(ts AS DATE) AS run_date,
 CAST(ts AS DATE) + CAST(user_id % 8 AS INTEGER) AS target_date,
 avg(value) FILTER (WHERE series = 'view') AS nuclear_mw, avg(value) FILTER (WHERE series = 'click') AS ccgt_mw
 FROM readings GROUP BY 1, 2)"""
