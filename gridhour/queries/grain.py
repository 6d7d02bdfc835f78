"""Calendars, resampling and daily alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.operators import align, calendar, dedupe, joins, resample
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, day_length, day_start, ldate, lhour, num, query, stamp, table

# Calendars ------------------------------------------------------------------------------

_SPAN = "span AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)"
_CAL = f"""WITH {_SPAN}, cal AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span)"""


def _order_calendar(spark, sf):
    return calendar.hourly_calendar(calendar.hour_bounds(table(spark, sf, "orders"), "o_orderdate"))


@query(
    "hourly_calendar",
    "F02 F03 F08",
    f"""{_CAL} SELECT {day(ldate('ts'))} AS date_local, {day('min(ts)')} AS first_utc_day, {big('count(*)')} AS n_hours,
 {big(f"count(DISTINCT {lhour('ts')})")} AS n_labels, {big(f"sum({lhour('ts')})")} AS sum_hours FROM cal GROUP BY {ldate('ts')}""",
)
def hourly_calendar(spark, sf):
    return _order_calendar(spark, sf).groupBy("date_local").agg(
        F.min("date_utc").alias("first_utc_day"),
        F.count("*").alias("n_hours"),
        F.countDistinct("hour_local").alias("n_labels"),
        F.sum("hour_local").alias("sum_hours"),
    )


@query(
    "dst_calendar",
    "A29 Q20 F03 J13",
    f"""{_CAL}, d AS (SELECT {ldate('ts')} AS d, count(*) AS n FROM cal GROUP BY 1)
 SELECT {day('d')} AS date_local, {big('n')} AS n_hours, {day_length('d')} AS n_expected, n = {day_length('d')} AS intact
 FROM d WHERE n <> 24""",
)
def dst_calendar(spark, sf):
    checked = calendar.clock_change_check(_order_calendar(spark, sf))
    return calendar.atypical_days(_order_calendar(spark, sf)).select("date_local").join(checked, "date_local")


@query(
    "expected_hours_of_days",
    "F03 F04",
    f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
 h AS (SELECT d, unnest(generate_series({day_start('d')}, {day_start('d + INTERVAL 1 DAY')} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM d)
 SELECT {day('d')} AS day, {stamp('min(ts)')} AS first_hour, {stamp('max(ts)')} AS last_hour, {big('count(*)')} AS n FROM h GROUP BY d""",
)
def expected_hours_of_days(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return calendar.expected_hours(days).groupBy("day").agg(
        F.min("ts").alias("first_hour"), F.max("ts").alias("last_hour"), F.count("*").alias("n")
    )


@query(
    "calendar_features",
    "F06 F07",
    f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT {day('d')} AS fecha, {big('isodow(d + INTERVAL 1 DAY) - 1')} AS d1_dow, {big('month(d + INTERVAL 1 DAY)')} AS d1_month,
 {big('CASE WHEN isodow(d + INTERVAL 1 DAY) >= 6 THEN 1 ELSE 0 END')} AS d1_is_weekend,
 {day("date_trunc('month', d)")} AS month_first, {day('last_day(d)')} AS month_last FROM d""",
)
def calendar_features(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("fecha")).distinct()
    return days.select(
        "fecha",
        *clock.weekday_features(F.col("fecha")),
        clock.month_floor(F.col("fecha")).alias("month_first"),
        F.last_day("fecha").alias("month_last"),
    )


# Resampling -----------------------------------------------------------------------------


@query(
    "hourly_mean",
    "A01 O01",
    f"""SELECT event_type AS series, {stamp("date_trunc('hour', ts)")} AS ts, {num('avg(value)')} AS value
 FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def hourly_mean(spark, sf):
    return resample.to_hour(s.readings(spark, sf), "ts", {"value": "avg"}, ("series",)).orderBy("series", "ts")


@query(
    "hourly_mixed_avg_sum",
    "A02",
    f"""SELECT event_type AS series, {stamp("date_trunc('hour', ts)")} AS ts,
 {num("CASE WHEN event_type IN ('click', 'purchase') THEN sum(value) ELSE avg(value) END")} AS value
 FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def hourly_mixed_avg_sum(spark, sf):
    return resample.to_hour_by_unit(s.readings(spark, sf), "ts", "series", "value", {"click", "purchase"})


@query(
    "modal_complete_hour",
    "A03",
    f"""WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, count(value) AS n, avg(value) AS v FROM events GROUP BY 1, 2),
 t AS (SELECT series, n, count(*) AS k FROM h GROUP BY 1, 2),
 m AS (SELECT series, n FROM t QUALIFY row_number() OVER (PARTITION BY series ORDER BY k DESC, n) = 1)
 SELECT h.series, {stamp('h.ts')} AS ts, {big('h.n')} AS n, {num('h.v')} AS value FROM h JOIN m ON h.series = m.series AND h.n = m.n""",
)
def modal_complete_hour(spark, sf):
    return resample.modal_complete_hours(s.readings(spark, sf), "ts", "value", ("series",))


@query(
    "modal_complete_hour_one_series",
    "A03",
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS ts, count(value) AS n, avg(value) AS v FROM events GROUP BY 1),
 t AS (SELECT n, count(*) AS k FROM h GROUP BY 1), m AS (SELECT n FROM t ORDER BY k DESC, n LIMIT 1)
 SELECT {stamp('ts')} AS ts, {big('h.n')} AS n, {num('v')} AS value FROM h JOIN m ON h.n = m.n""",
)
def modal_complete_hour_one_series(spark, sf):
    return resample.modal_complete_hours(s.readings(spark, sf), "ts", "value")


@query(
    "resample_local_day",
    "P17 F04",
    f"""SELECT event_type AS series, {stamp("date_trunc('hour', ts)")} AS ts, {num('avg(value)')} AS value, {big("0")} AS dummy
 FROM events WHERE {ldate('ts')} = DATE '2024-01-15' GROUP BY event_type, date_trunc('hour', ts)""",
)
def resample_local_day(spark, sf):
    from datetime import date

    r = s.readings(spark, sf)
    return resample.hourly_on_local_day(r, "ts", {"value": "avg"}, date(2024, 1, 15), ("series",)).withColumn("dummy", F.lit(0))


_CODES = {"renewable": ["view", "click"], "thermal": ["error"], "absent": ["signup|x"]}


@query(
    "multi_code_mapping",
    "P03",
    f"""WITH {s.READINGS}, h AS (SELECT series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY 1, 2)
 SELECT {stamp('ts')} AS ts, {num("sum(value) FILTER (WHERE series IN ('view', 'click'))")} AS renewable,
 {num("sum(value) FILTER (WHERE series = 'error')")} AS thermal, CAST(NULL AS DOUBLE) AS absent
 FROM h WHERE series IN ('view', 'click', 'error') GROUP BY ts""",
)
def multi_code_mapping(spark, sf):
    hourly = resample.to_hour(s.readings(spark, sf), "ts", {"value": "avg"}, ("series",))
    return resample.map_codes(hourly, ["ts"], "series", "value", _CODES)


@query(
    "unmapped_codes",
    "P04",
    f"""SELECT event_type AS series, {big('count(*)')} AS n_rows FROM events
 WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY event_type""",
)
def unmapped_codes(spark, sf):
    return resample.unmapped_codes(s.readings(spark, sf), "series", _CODES)


@query(
    "sparse_column_merge",
    "M11",
    f"""WITH h AS (SELECT event_type AS c, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2)
 SELECT {stamp('ts')} AS ts, {num("max(v) FILTER (WHERE c = 'view')")} AS "view", {num("max(v) FILTER (WHERE c = 'click')")} AS click
 FROM h WHERE c IN ('view', 'click') GROUP BY ts""",
)
def sparse_column_merge(spark, sf):
    hourly = resample.to_hour(s.readings(spark, sf), "ts", {"value": "avg"}, ("series",))
    return resample.sparse_to_wide(hourly, ["ts"], "series", "value", ["view", "click"])


# Daily alignment ------------------------------------------------------------------------


@query(
    "daily_stats",
    "A05 F02",
    f"""WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)
 SELECT series, {day(ldate('ts'))} AS fecha, {num('avg(value)')} AS value_mean, {num('min(value)')} AS value_min,
 {num('max(value)')} AS value_max FROM h GROUP BY series, {ldate('ts')}""",
)
def daily_stats(spark, sf):
    hourly = resample.to_hour(s.readings(spark, sf), "ts", {"value": "avg"}, ("series",))
    return align.daily_stats(hourly, "ts", ["value"], keys=("series",))


_PIVOT_SQL = ", ".join(
    f"arg_min(price, ts) FILTER (WHERE {lhour('ts')} = {h} AND price IS NOT NULL) AS price_h{h:02d}" for h in range(24)
)
_WIDE = f"{s.HOURLY}, wide AS (SELECT {ldate('ts')} AS fecha, {_PIVOT_SQL} FROM hourly GROUP BY 1)"
_HOURS = [f"price_h{h:02d}" for h in range(24)]


def _wide(spark, sf):
    return align.pivot_hours(s.hourly_by_type(spark, sf), "ts", "price")


@query(
    "pivot_24h",
    "A08",
    f"WITH {_WIDE} SELECT {day('fecha')} AS fecha, {', '.join(f'{num(c)} AS {c}' for c in _HOURS)} FROM wide",
)
def pivot_24h(spark, sf):
    return _wide(spark, sf)


@query(
    "pivot_24h_clock_changes",
    "A08",
    f"""{_CAL}, w AS (SELECT {ldate('ts')} AS fecha,
 {', '.join(f"arg_min(epoch(ts), ts) FILTER (WHERE {lhour('ts')} = {h}) AS h{h:02d}" for h in (0, 1, 2, 3))} FROM cal GROUP BY 1)
 SELECT {day('fecha')} AS fecha, {', '.join(f'{num(c)} AS {c}' for c in ('h00', 'h01', 'h02', 'h03'))} FROM w""",
)
def pivot_24h_clock_changes(spark, sf):
    cal = _order_calendar(spark, sf).withColumn("v", F.unix_timestamp("ts_utc").cast("double"))
    return align.pivot_hours(cal, "ts_utc", "v", prefix="h").select("fecha", "h00", "h01", "h02", "h03")


@query(
    "target_d1",
    "W01 W03",
    f"""WITH {_WIDE}, days AS (SELECT CAST(unnest(generate_series(CAST(min(fecha) AS TIMESTAMP), CAST(max(fecha) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM wide)
 SELECT {day('d')} AS fecha, {', '.join(f'{num(c)} AS {c}' for c in _HOURS)}
 FROM days LEFT JOIN wide ON wide.fecha = CAST(d + INTERVAL 1 DAY AS DATE)""",
)
def target_d1(spark, sf):
    return align.next_day_target(_wide(spark, sf))


@query(
    "target_complete_days",
    "P13",
    f"""WITH {_WIDE} SELECT {day('fecha')} AS fecha, {num('price_h00 + price_h23')} AS ends FROM wide
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _HOURS)}""",
)
def target_complete_days(spark, sf):
    full = _wide(spark, sf).dropna(subset=_HOURS)
    return full.select("fecha", (F.col("price_h00") + F.col("price_h23")).alias("ends"))


@query(
    "lag_d1_d7",
    "W02 J09",
    f"""WITH d AS (SELECT {ldate('ts')} AS d, avg(value) AS v_mean, max(value) AS v_max FROM events GROUP BY 1),
 a AS (SELECT d + 1 AS d, v_mean, v_max FROM d), b AS (SELECT d + 7 AS d, v_mean, v_max FROM d)
 SELECT {day('d')} AS fecha, {num('a.v_mean')} AS v_mean_lag1d, {num('a.v_max')} AS v_max_lag1d,
 {num('b.v_mean')} AS v_mean_lag7d, {num('b.v_max')} AS v_max_lag7d FROM a FULL JOIN b USING (d)""",
)
def lag_d1_d7(spark, sf):
    r = s.readings(spark, sf).withColumnRenamed("value", "v")
    return align.lag_block(align.daily_stats(r, "ts", ["v"], ("mean", "max")), {1: "lag1d", 7: "lag7d"})


@query(
    "ffill_daily",
    "W04",
    f"""WITH {s.DAILY_PRICE} SELECT {day('fecha')} AS fecha,
 {num('last_value(v IGNORE NULLS) OVER (ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v, {num('w')} AS w FROM daily_price""",
)
def ffill_daily(spark, sf):
    return align.forward_fill(s.daily_price(spark, sf), "fecha", ["v"])


@query(
    "ffill_by_series",
    "W04",
    f"""WITH {s.READINGS}, h AS (SELECT series, date_trunc('hour', ts) AS ts, max(value) FILTER (WHERE qty > 80) AS v FROM readings GROUP BY 1, 2)
 SELECT series, {stamp('ts')} AS ts,
 {num('last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v FROM h""",
)
def ffill_by_series(spark, sf):
    r = s.readings(spark, sf).withColumn("v", F.when(F.col("qty") > 80, F.col("value")))
    hourly = r.groupBy("series", clock.hour_floor(F.col("ts")).alias("ts")).agg(F.max("v").alias("v"))
    return align.forward_fill(hourly, "ts", ["v"], ("series",), bucket=F.to_date("ts"))


@query(
    "step_expand_days",
    "W05",
    f"""WITH {s.DAILY_PRICE}, f AS (SELECT min(fecha) AS fecha, arg_min(v, fecha) AS v FROM daily_price WHERE v IS NOT NULL GROUP BY date_trunc('month', fecha)),
 n AS (SELECT fecha, v, coalesce(lead(fecha) OVER (ORDER BY fecha) - 1, DATE '2001-12-31') AS last FROM f)
 SELECT {day("unnest(generate_series(CAST(fecha AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY))")} AS fecha, {num('v')} AS v FROM n""",
)
def step_expand_days(spark, sf):
    return align.expand_steps(s.monthly_first(spark, sf), "fecha", F.lit("2001-12-31").cast("date"))


@query(
    "month_expand_days",
    "W06 F06",
    f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1),
 x AS (SELECT m, v, least(last_day(m), DATE '2001-07-10') AS e FROM m WHERE m <= DATE '2001-07-10')
 SELECT {day("unnest(generate_series(CAST(m AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY))")} AS day, {num('v')} AS v FROM x""",
)
def month_expand_days(spark, sf):
    o = table(spark, sf, "orders")
    monthly = o.groupBy(clock.month_floor(F.col("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("v"))
    return align.expand_month(monthly, "month", F.lit("2001-07-10").cast("date"))


_LIST = "[" + ", ".join(_HOURS) + "]"


@query(
    "row_stats_24h",
    "A07",
    f"""WITH {_WIDE} SELECT {day('fecha')} AS fecha, {num(f'list_avg({_LIST})')} AS precio_real_mean,
 {num(f'list_min({_LIST})')} AS precio_real_min, {num(f'list_max({_LIST})')} AS precio_real_max FROM wide""",
)
def row_stats_24h(spark, sf):
    return align.row_stats(_wide(spark, sf), _HOURS, "precio_real", ["fecha"])


@query(
    "gap_days",
    "W18",
    f"""WITH d AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1, 2)
 SELECT p AS priority, {day('d')} AS fecha, {big('d - lag(d) OVER (PARTITION BY p ORDER BY d)')} AS gap_days FROM d""",
)
def gap_days(spark, sf):
    return align.day_gaps(_priority_days(spark, sf), "fecha", ("priority",))


def _priority_days(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("fecha")).distinct()


@query(
    "typical_step",
    "A35",
    f"""WITH d AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1, 2),
 g AS (SELECT p, d - lag(d) OVER (PARTITION BY p ORDER BY d) AS g FROM d),
 t AS (SELECT p, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1, 2),
 m AS (SELECT p, g AS modal FROM t QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, g) = 1),
 a AS (SELECT p, count(*) AS n, avg(g) AS mean FROM g WHERE g IS NOT NULL GROUP BY 1)
 SELECT p AS priority, {big('n')} AS n_gaps, {num('mean')} AS mean_gap, {big('modal')} AS modal_gap,
 CASE WHEN mean > 25 THEN 'monthly' WHEN mean > 5 THEN 'weekly' WHEN mean <= 1.6 THEN 'daily' ELSE 'irregular' END AS step
 FROM a JOIN m USING (p)""",
)
def typical_step(spark, sf):
    return align.typical_step(align.day_gaps(_priority_days(spark, sf), "fecha", ("priority",)), ("priority",))


@query(
    "split_labels",
    "U06 C03",
    f"""SELECT {day('o_orderdate')} AS fecha, CASE WHEN o_orderdate <= DATE '1999-12-31' THEN 'train'
 WHEN o_orderdate <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END AS split, {big('count(*)')} AS n
 FROM orders GROUP BY o_orderdate""",
)
def split_labels(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("fecha")).agg(F.count("*").alias("n"))
    return o.withColumn("split", align.split_label(F.col("fecha"), "1999-12-31", "2000-12-31"))


# One row per key ------------------------------------------------------------------------


@query(
    "dedupe_keep_last",
    "W11",
    f"""WITH {s.READINGS} SELECT series, {stamp("date_trunc('hour', ts)")} AS hour, {big('event_id')} AS event_id, {num('value')} AS value
 FROM readings QUALIFY row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1""",
)
def dedupe_keep_last(spark, sf):
    return _hour_rows(spark, sf, dedupe.keep_last)


@query(
    "dedupe_keep_first",
    "W12",
    f"""WITH {s.READINGS} SELECT series, {stamp("date_trunc('hour', ts)")} AS hour, {big('event_id')} AS event_id, {num('value')} AS value
 FROM readings QUALIFY row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ts, event_id) = 1""",
)
def dedupe_keep_first(spark, sf):
    return _hour_rows(spark, sf, dedupe.keep_first)


def _hour_rows(spark, sf, pick):
    r = s.readings(spark, sf).withColumn("hour", clock.hour_floor(F.col("ts")))
    return pick(r.select("series", "hour", "ts", "event_id", "value"), ["series", "hour"], ["ts", "event_id"]).drop("ts")


@query(
    "collisions",
    "W16",
    f"""SELECT event_type AS series, {stamp("date_trunc('hour', ts)")} AS hour, {big('count(value)')} AS n_values,
 {num('max(value) - min(value)')} AS spread FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING max(value) - min(value) > 50""",
)
def collisions(spark, sf):
    r = s.readings(spark, sf).withColumn("hour", clock.hour_floor(F.col("ts")))
    return dedupe.collisions(r, ["series", "hour"], "value", 50.0)


@query(
    "repeated_keys",
    "J03",
    f"""SELECT {big('l_orderkey')} AS l_orderkey, {big('l_linenumber')} AS l_linenumber, {big('count(*)')} AS n_rows
 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def repeated_keys(spark, sf):
    return dedupe.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "version_priority",
    "J21",
    f"""WITH {s.READINGS}, g AS (SELECT date_trunc('hour', ts) AS ts, user_id % 3 AS version,
 avg(value) FILTER (WHERE series = 'view') AS a, avg(value) FILTER (WHERE series = 'click') AS b FROM readings GROUP BY 1, 2)
 SELECT {stamp('ts')} AS ts, {num('arg_min(a, version) FILTER (WHERE a IS NOT NULL)')} AS a,
 {num('arg_min(b, version) FILTER (WHERE b IS NOT NULL)')} AS b FROM g GROUP BY ts""",
)
def version_priority(spark, sf):
    r = s.readings(spark, sf)
    grid = r.groupBy(clock.hour_floor(F.col("ts")).alias("ts"), (F.col("user_id") % 3).alias("version")).agg(
        F.avg(F.when(F.col("series") == "view", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("series") == "click", F.col("value"))).alias("b"),
    )
    return dedupe.combine_versions(grid, ["ts"], "version", ["a", "b"])


@query(
    "first_last_by_time",
    "W14 W13",
    f"""WITH {s.READINGS}, g AS (SELECT series, CAST(ts AS DATE) AS d, user_id, sum(value) AS v FROM readings GROUP BY 1, 2, 3)
 SELECT series, {day('d')} AS day, {big('user_id')} AS user_id, {num('v')} AS v FROM g
 QUALIFY row_number() OVER (PARTITION BY series, d ORDER BY round(v, 6) DESC, user_id) = 1""",
)
def first_last_by_time(spark, sf):
    r = s.readings(spark, sf)
    g = r.groupBy("series", F.to_date("ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 6).alias("v"))
    return dedupe.top_one(g, ["series", "day"], "v", ["user_id"])
