"""Fixed schemas of landed inputs and of the tables with their own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDICATOR = T.StructType(
    [
        T.StructField(
            "indicator",
            T.StructType(
                [
                    T.StructField("id", T.LongType()),
                    T.StructField("name", T.StringType()),
                    T.StructField(
                        "values",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("datetime", T.StringType()),
                                    T.StructField("datetime_utc", T.StringType()),
                                    T.StructField("value", T.DoubleType()),
                                    T.StructField("geo_id", T.LongType()),
                                    T.StructField("geo_name", T.StringType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        )
    ]
)

RAW_TRADE = T.StructType(
    [
        T.StructField("tradeId", T.StringType()),
        T.StructField("venueCode", T.StringType()),
        T.StructField("dealDate", T.DoubleType()),
        T.StructField("price", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("aggressorBuy", T.BooleanType()),
    ]
)

TRADES = "trade_id STRING, commodity STRING, periodo STRING, item_id INT, deal_date TIMESTAMP, precio DECIMAL(12,3), cantidad INT, agresor_compra BOOLEAN, venue STRING"
AUDIT = "pipeline STRING, fecha_inicio TIMESTAMP, fecha_fin TIMESTAMP, registros BIGINT, estado STRING, mensaje STRING, duracion_seg DOUBLE"
CAPACITY_SNAPSHOT = "run_date DATE, target_date DATE, hydro_mw DOUBLE, pump_mw DOUBLE, nuclear_mw DOUBLE, coal_antracita_mw DOUBLE, ccgt_mw DOUBLE, fuel_mw DOUBLE, gas_turbine_mw DOUBLE"
WEATHER_RUN = "ts TIMESTAMP, run_date DATE, t2m_mean DOUBLE, d2m_mean DOUBLE, wind10_mean DOUBLE, wind100_mean DOUBLE, wind_gust10_mean DOUBLE, ssrd_mean DOUBLE, tcc_mean DOUBLE, tp_mean DOUBLE, msl_mean DOUBLE"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast to a declared schema; columns that are absent become NULL, extra ones stay."""
    declared = T.StructType.fromDDL(ddl)
    known = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared
    ]
    return df.select(*known, *[c for c in df.columns if c not in declared.names])


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    """Stored table before its first load."""
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))
