"""Trades to daily bars, bars to continuous front-contract series, and their rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhour.functions import clock, labels
from gridhour.functions.numbers import half_up


def daily_bars(trades: DataFrame, tz: str = clock.MADRID, group: tuple[str, ...] = ("commodity", "periodo")) -> DataFrame:
    """OHLC, VWAP, volume, trade count and share of buyer-initiated trades per local day.

    Quantity counts at least 1. Open and close follow the instant and then a fixed hash of the
    trade id, so equal instants give the same bar on every run. All measures merge partially
    in hash aggregates, so one busy contract is reduced inside the map tasks.
    """
    day = clock.local_date(F.col("deal_date"), tz).alias("fecha")
    return trades.groupBy(day, *group).agg(*bar_measures())


def bar_measures() -> list[Column]:
    """The measures of a bar, for batches and streams alike."""
    qty = F.greatest(F.col("cantidad"), F.lit(1))
    order = clock.arrival_rank(F.col("deal_date"), F.col("trade_id"))
    return [
        F.min("item_id").alias("item_id"),
        F.min_by("precio", order).alias("apertura"),
        F.max("precio").alias("maximo"),
        F.min("precio").alias("minimo"),
        F.max_by("precio", order).alias("cierre"),
        half_up(F.try_divide(F.sum(F.col("precio") * qty), F.sum(qty)), 3).alias("vwap"),
        F.sum(qty).alias("volumen"),
        F.count("*").alias("n_trades"),
        half_up(F.try_divide(F.lit(100.0) * F.count_if("agresor_compra"), F.count("*")), 1).alias("pct_agresor_compra"),
    ]


def with_delivery(bars: DataFrame, period: str = "periodo") -> DataFrame:
    return bars.withColumn("delivery", labels.contract_delivery(F.col(period)))


def rule_of(commodity: Column, rules: dict[str, str]) -> Column:
    """Rule of a commodity; one without an entry follows the monthly rule."""
    out = F.lit("next_month")
    for name, rule in rules.items():
        out = F.when(commodity == name, rule).otherwise(out)
    return out


def front_series(bars: DataFrame, rules: dict[str, str], price: str = "cierre") -> DataFrame:
    """Nearest eligible contract per commodity and day, unadjusted price."""
    known = with_delivery(bars).where(F.col("delivery").isNotNull() & F.col(price).isNotNull())
    usable = known.where(labels.eligible(rule_of(F.col("commodity"), rules), F.col("delivery"), F.col("fecha")))
    pick = F.min_by(F.struct(F.col(price).alias("precio"), "periodo"), F.col("delivery")).alias("_p")
    return usable.groupBy("commodity", "fecha").agg(pick, F.min("delivery").alias("delivery")).select(
        "commodity", "fecha", "_p.precio", "_p.periodo", "delivery"
    )


def with_previous(series: DataFrame, cols: list[str]) -> DataFrame:
    """Values of the previous market day of the commodity.

    The series has one row per day; windows run per commodity and year, and the first
    day of a year takes the last row of the previous year with data.
    """
    part = ["commodity", "_y"]
    s = series.withColumn("_y", F.year("fecha"))
    ends = s.groupBy(*part).agg(F.max_by(F.struct(*cols), F.col("fecha")).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy("commodity").orderBy("_y"))).drop("_end")
    inside = Window.partitionBy(*part).orderBy("fecha")
    lagged = s.withColumn("_in", F.lag(F.struct(*cols)).over(inside)).join(ends, part, "left")
    prev = F.coalesce("_in", "_carry")
    return lagged.select(*series.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def rolls(series: DataFrame, bars: DataFrame, price: str = "cierre") -> DataFrame:
    """Contract changes of a front series with the jump and the same-day premium.

    The premium compares both contracts on the last day of the old one; it is NULL when
    the new contract had no price that day.
    """
    steps = with_previous(series, ["fecha", "precio", "periodo"])
    turns = steps.where(F.col("prev_periodo").isNotNull() & (F.col("prev_periodo") != F.col("periodo")))
    quotes = with_delivery(bars).where(F.col("delivery").isNotNull() & F.col(price).isNotNull()).select(
        "commodity", F.col("fecha").alias("prev_fecha"), "delivery", F.col(price).alias("_new_on_old_day")
    )
    return turns.join(quotes, ["commodity", "prev_fecha", "delivery"], "left").select(
        "commodity",
        "prev_fecha",
        "prev_precio",
        "prev_periodo",
        "fecha",
        "precio",
        "periodo",
        (F.col("precio") - F.col("prev_precio")).alias("salto"),
        (F.col("_new_on_old_day") - F.col("prev_precio")).alias("prima"),
    )


def typical_change(series: DataFrame) -> DataFrame:
    """Mean absolute change from one market day to the next."""
    steps = with_previous(series, ["precio"])
    return steps.groupBy("commodity").agg(
        F.count("*").alias("n_days"),
        F.min("precio").alias("precio_min"),
        F.max("precio").alias("precio_max"),
        F.avg(F.abs(F.col("precio") - F.col("prev_precio"))).alias("typical_change"),
    )


def roll_report(series: DataFrame, turns: DataFrame) -> DataFrame:
    """Per commodity: rolls, mean jump against the typical change, measured premium."""
    jumps = turns.groupBy("commodity").agg(
        F.count("*").alias("n_rolls"),
        F.avg(F.abs("salto")).alias("mean_jump"),
        F.avg("prima").alias("mean_premium"),
        F.count("prima").alias("n_premium"),
    )
    return typical_change(series).join(jumps, "commodity", "left").withColumn(
        "jump_ratio", F.try_divide("mean_jump", F.nullif("typical_change", F.lit(0.0)))
    )


def first_and_last(turns: DataFrame, n: int = 6) -> DataFrame:
    """First and last n rolls per commodity; all of them when there are at most 2n."""
    up = Window.partitionBy("commodity").orderBy("fecha")
    down = Window.partitionBy("commodity").orderBy(F.desc("fecha"))
    ranked = turns.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    return ranked.where((F.col("_a") <= n) | (F.col("_z") <= n)).drop("_a", "_z")


def top_contract_per_year(bars: DataFrame) -> DataFrame:
    """Most traded contract of each year and commodity, with the statistics of its bars."""
    yearly = bars.groupBy(F.year("fecha").alias("anio"), "commodity", "periodo").agg(
        F.sum("volumen").alias("_v"),
        half_up(F.avg("cierre"), 2).alias("cierre_medio"),
        half_up(F.min("minimo"), 2).alias("minimo"),
        half_up(F.max("maximo"), 2).alias("maximo"),
        F.sum("n_trades").alias("operaciones"),
        F.count("*").alias("dias"),
    )
    cols = ["periodo", "cierre_medio", "minimo", "maximo", "operaciones", "dias"]
    best = F.min_by(F.struct(*cols), F.struct((-F.col("_v")).alias("_m"), "periodo")).alias("_b")
    return yearly.groupBy("anio", "commodity").agg(best).select("anio", "commodity", *[F.col("_b")[c].alias(c) for c in cols])


def active_monthly_contracts(bounds: DataFrame, months_back: int = 12, curve: int = 3) -> DataFrame:
    """Monthly contracts alive in a (start, end) range with their trading window."""
    m0 = F.trunc("start", "month")
    m1 = F.add_months(F.trunc("end", "month"), curve)
    months = bounds.select("start", "end", F.explode(F.sequence(m0, m1, F.expr("INTERVAL 1 MONTH"))).alias("delivery"))
    out = months.select(
        labels.contract_label(F.col("delivery")).alias("periodo"),
        "delivery",
        F.greatest(F.add_months("delivery", -months_back), F.col("start")).alias("desde"),
        F.least(F.add_months("delivery", 1), F.date_add("end", 1)).alias("hasta"),
    )
    return out.where(F.col("hasta") > F.col("desde"))


def active_december_contracts(bounds: DataFrame, years_back: int = 3, years_ahead: int = 2) -> DataFrame:
    """December contracts alive in a (start, end) range with their trading window."""
    years = bounds.select(
        "start", "end", F.explode(F.sequence(F.year("start"), F.year("end") + years_ahead)).alias("anio")
    )
    out = years.select(
        labels.contract_label(F.make_date("anio", F.lit(12), F.lit(1))).alias("periodo"),
        F.make_date("anio", F.lit(12), F.lit(1)).alias("delivery"),
        F.greatest(F.make_date(F.col("anio") - years_back, F.lit(1), F.lit(1)), F.col("start")).alias("desde"),
        F.least(F.make_date(F.col("anio") + 1, F.lit(1), F.lit(1)), F.date_add("end", 1)).alias("hasta"),
    )
    return out.where(F.col("hasta") > F.col("desde"))
