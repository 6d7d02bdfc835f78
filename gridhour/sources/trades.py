"""Raw trades to the trade log, with the rejected rows kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import half_up
from gridhour.registry import TRADE_PRICE_RANGE
from gridhour.sources.schemas import RAW_TRADE


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines. Values that do not fit the schema become NULL and are rejected later."""
    return spark.read.schema(RAW_TRADE).json(path)


def _typed(raw: DataFrame) -> DataFrame:
    keep = [c for c in raw.columns if c not in RAW_TRADE.names]
    rounded = half_up(F.col("price").try_cast("decimal(24,9)"), 3)
    price = F.when(rounded.between(*TRADE_PRICE_RANGE), rounded).cast("decimal(12,3)")
    ok = (
        F.col("tradeId").isNotNull()
        & (F.col("tradeId") != "")
        & F.col("dealDate").isNotNull()
        & price.isNotNull()
    )
    return raw.select(
        *keep,
        F.col("tradeId").alias("trade_id"),
        clock.epoch_any_unit(F.col("dealDate")).alias("deal_date"),
        price.alias("precio"),
        F.coalesce(F.col("quantity").try_cast("int"), F.lit(0)).alias("cantidad"),
        F.coalesce("aggressorBuy", F.lit(False)).alias("agresor_compra"),
        F.col("venueCode").alias("venue"),
        F.coalesce(ok, F.lit(False)).alias("_ok"),
    )


def clean(raw: DataFrame) -> DataFrame:
    """Trades with id, date and a sane price; quantity and side default to 0 and false."""
    return _typed(raw).where("_ok").drop("_ok")


def rejected(raw: DataFrame) -> DataFrame:
    """The rows :func:`clean` leaves out."""
    return _typed(raw).where(~F.col("_ok")).drop("_ok")


def clean_counts(raw: DataFrame) -> DataFrame:
    return _typed(raw).agg(F.count_if("_ok").alias("n_kept"), F.count_if(~F.col("_ok")).alias("n_rejected"))
