"""Structured Streaming over the landed readings, run until everything landed is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.functions.numbers import half_up
from gridhour.operators import futures, merge
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, day_length, ldate, local, num, query, stamp, table
from gridhour.session import scratch_path
from gridhour.streaming import feeds


def _stream(spark, sf):
    """The readings as a stream of landed files, shaped like :func:`surrogates.readings`."""
    e = feeds.read_landed(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema)
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("series"),
        "value",
        (F.col("user_id") % 2).alias("source"),
        F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
    )


def _drained(spark, stream, name, keys, mode="update"):
    out = scratch_path(spark, name)
    feeds.drain(feeds.start_versions(stream, out, feeds.state_path(spark, name), mode))
    return feeds.latest(spark, out, keys)


@query(
    "stream_hourly_mean",
    "T02 A01 A02",
    f"""SELECT event_type AS series, {stamp("date_trunc('hour', ts)")} AS ts, {num('avg(value)')} AS mean, {num('sum(value)')} AS total,
 {big('count(*)')} AS n FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def stream_hourly_mean(spark, sf):
    aggs = [F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("*").alias("n")]
    hourly = feeds.hourly_stream(_stream(spark, sf), "ts", "series", aggs)
    path = scratch_path(spark, "hourly-table")
    keyed = hourly.withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    state = feeds.state_path(spark, "hourly")
    feeds.drain(feeds.start_merge(keyed, path, ["ts", "series"], [], merge.UPSERT, state, "part", mode="update"))
    return spark.read.parquet(path).drop("part")


@query(
    "stream_dedupe",
    "T03",
    f"""SELECT {big('event_id')} AS event_id, {stamp('ts')} AS ts, {num('value')} AS value FROM events""",
)
def stream_dedupe(spark, sf):
    """Every trade arrives twice."""
    twice = _stream(spark, sf).select("event_id", "ts", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    once = feeds.dedupe_stream(twice, "ts", "event_id").drop("arrival")
    return _drained(spark, once, "dedupe", ["event_id"], "append").select("event_id", "ts", "value")


def _landed_in_turn(spark, df, ts, name, start, turns=3):
    """Write ``df`` in time order as ``turns`` landings, and run the stream after each of them."""
    root = scratch_path(spark, name)
    cuts = df.agg(F.percentile_approx(F.unix_micros(ts), [i / turns for i in range(1, turns)], 1000).alias("c")).first()["c"] or []
    edges = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        at = F.unix_micros(ts)
        part = df.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.parquet(f"{root}/landing={i}")
        feeds.drain(start(feeds.read_landed(spark, f"{root}/*", df.schema)))


@query(
    "stream_trades_to_bars",
    "T03 T04 A10",
    f"""WITH {s.TRADES}, t AS (SELECT *, {ldate('deal_date')} AS d FROM trades),
 w AS (SELECT max({local('deal_date')}) - INTERVAL 2 DAY AS mark FROM trades)
 SELECT {day('d')} AS fecha, commodity, periodo, {big('min(item_id)')} AS item_id,
 {num('arg_min(precio, (deal_date, trade_id))')} AS apertura, {num('max(precio)')} AS maximo, {num('min(precio)')} AS minimo,
 {num('arg_max(precio, (deal_date, trade_id))')} AS cierre,
 {num('((2000 * sum(CAST(round(precio * 10000) AS HUGEINT) * greatest(cantidad, 1)) + 10000 * sum(greatest(cantidad, 1))) // (20000 * sum(greatest(cantidad, 1)))) / 1000.0')} AS vwap, {big('sum(greatest(cantidad, 1))')} AS volumen,
 {big('count(*)')} AS n_trades, {num('round(100.0 * count(*) FILTER (WHERE agresor_compra) / count(*), 1)')} AS pct_agresor_compra
 FROM t, w WHERE CAST(d + 1 AS TIMESTAMP) <= mark GROUP BY d, commodity, periodo""",
)
def stream_trades_to_bars(spark, sf):
    """A trade log in three landings; every trade comes again with the next day's trades."""
    trades = s.trades(spark, sf).withColumn("precio", F.col("precio").cast("decimal(18,4)"))
    seen = trades.withColumn("seen", F.explode(F.array(F.col("deal_date"), F.col("deal_date") + F.expr("INTERVAL 1 DAY"))))
    out, state = scratch_path(spark, "trade-bars"), feeds.state_path(spark, "trade-bars")

    def start(stream):
        bars = feeds.trade_bars(stream, "deal_date", "trade_id", ["commodity", "periodo"], futures.bar_measures())
        return feeds.start_versions(bars, out, state, "append")

    _landed_in_turn(spark, seen, "seen", "trades", start)
    return spark.read.parquet(out).drop("batch")


@query(
    "stream_ohlc",
    "T04 A10",
    f"""WITH {s.READINGS} SELECT {day(ldate('ts'))} AS fecha, series, {num('arg_min(value, (ts, event_id))')} AS apertura, {num('max(value)')} AS maximo,
 {num('min(value)')} AS minimo, {num('arg_max(value, (ts, event_id))')} AS cierre,
 {num('round(sum(value * greatest(qty, 1)) / sum(greatest(qty, 1)) + 1e-9, 3)')} AS vwap, {big('count(*)')} AS n_trades FROM readings GROUP BY {day(ldate('ts'))}, series""",
)
def stream_ohlc(spark, sf):
    qty = F.greatest(F.col("qty"), F.lit(1))
    order = F.struct("ts", "event_id")
    aggs = [
        F.min_by("value", order).alias("apertura"),
        F.max("value").alias("maximo"),
        F.min("value").alias("minimo"),
        F.max_by("value", order).alias("cierre"),
        half_up(F.sum(F.col("value") * qty) / F.sum(qty) + 1e-9, 3).alias("vwap"),
        F.count("*").alias("n_trades"),
    ]
    path, state = scratch_path(spark, "ohlc-table"), feeds.state_path(spark, "ohlc")

    def start(stream):
        bars = feeds.bars_stream(stream, "ts", ["series"], aggs).withColumn("part", F.date_format("fecha", "yyyy-MM"))
        return feeds.start_merge(bars, path, ["fecha", "series"], [], merge.UPSERT, state, "part", mode="update")

    readings = s.readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    _landed_in_turn(spark, readings, "ts", "ohlc-readings", start, turns=2)
    return spark.read.parquet(path).drop("part")


def _stored_table(spark, sf, name):
    """Hourly table of the even users, laid out by day, with gaps in ``a``."""
    stored, _ = s.stored_and_fresh(spark, sf)
    path = scratch_path(spark, name)
    day_of = F.date_format("ts", "yyyy-MM-dd")
    merge.merge_into_parquet(spark, path, stored.select("ts", "a", day_of.alias("part")), ["ts"], merge.UPSERT, "part")
    return path


def _fresh_cells(spark, sf):
    r = _stream(spark, sf).where((F.col("source") == 1) & (F.col("series") == "view"))
    hour = clock.hour_floor(F.col("ts"))
    return r.select(
        hour.alias("ts"), F.date_format(hour, "yyyy-MM-dd").alias("part"), F.col("ts").alias("seen"), "event_id", F.col("value").alias("a")
    )


_LATE = f"""{s.STORED_FRESH}, f AS (SELECT date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS a FROM readings
 WHERE source = 1 AND series = 'view' GROUP BY 1)"""


@query(
    "stream_late_fill",
    "T01 M02",
    f"""WITH {_LATE} SELECT {stamp('ts')} AS ts, {num('coalesce(o.a, f.a)')} AS a FROM stored o FULL JOIN f USING (ts)""",
)
def stream_late_fill(spark, sf):
    path = _stored_table(spark, sf, "late-table")
    q = feeds.start_merge(
        _fresh_cells(spark, sf), path, ["ts"], ["seen", "event_id"], merge.FILL_NULL, feeds.state_path(spark, "late"), "part"
    )
    feeds.drain(q)
    return spark.read.parquet(path).select("ts", "a")


@query(
    "stream_revised_days",
    "T05 M03",
    f"""WITH {_LATE}, g AS (SELECT * FROM f WHERE {ldate('ts')} > (SELECT max({ldate('ts')}) FROM events) - INTERVAL 3 DAY)
 SELECT {stamp('ts')} AS ts, {num('CASE WHEN o.ts IS NULL THEN g.a WHEN g.a IS NOT NULL AND (o.a IS NULL OR abs(o.a - g.a) > 0.01) THEN g.a ELSE o.a END')} AS a
 FROM stored o FULL JOIN g USING (ts)""",
)
def stream_revised_days(spark, sf):
    path = _stored_table(spark, sf, "revised-table")
    newest = table(spark, sf, "events").agg(F.max(clock.local_date(F.col("ts")))).first()[0]
    q = feeds.start_merge(
        _fresh_cells(spark, sf), path, ["ts"], ["seen", "event_id"], merge.OVERWRITE_DIFFERENT,
        feeds.state_path(spark, "revised"), "part", 0.01, last_days=3, run_day=newest and newest.isoformat(),
    )
    feeds.drain(q)
    return spark.read.parquet(path).select("ts", "a")


@query(
    "stream_closed_days",
    "T06 Q02",
    f"""WITH e AS (SELECT event_type AS series, ts, {ldate('ts')} AS d FROM events),
 w AS (SELECT max(timezone('Europe/Madrid', timezone('UTC', ts))) - INTERVAL 1 DAY AS mark FROM events),
 g AS (SELECT series, d, count(DISTINCT date_trunc('hour', ts)) AS n FROM e GROUP BY 1, 2)
 SELECT {day('d')} AS day, series, {big('n')} AS n_hours, {day_length('d')} AS n_expected, n < {day_length('d')} AS alert FROM g, w
 WHERE CAST(d + 1 AS TIMESTAMP) <= mark""",
)
def stream_closed_days(spark, sf):
    return _drained(spark, feeds.closed_days(_stream(spark, sf), "ts", "series"), "closed", ["day", "series"], "append")


_CLOSED = f"""e AS (SELECT event_type AS series, ts, value, {ldate('ts')} AS d, date_trunc('hour', ts) AS h FROM events),
 w AS (SELECT max({local('ts')}) - INTERVAL 1 DAY AS mark FROM events),
 days AS (SELECT d, {day_length('d')} AS n_expected, count(DISTINCT h) AS n_rows,
 count(DISTINCT h) FILTER (WHERE series = 'view' AND value > 20) AS v, count(DISTINCT h) FILTER (WHERE series = 'click' AND value > 20) AS c,
 count(DISTINCT h) FILTER (WHERE series = 'error' AND value > 20) AS r, count(DISTINCT h) FILTER (WHERE series = 'purchase' AND value > 20) AS p
 FROM e, w WHERE CAST(d + 1 AS TIMESTAMP) <= mark GROUP BY d)"""


@query(
    "stream_day_status",
    "T06 Q02",
    f"""WITH {_CLOSED} SELECT {day('d')} AS day, n_expected, {big('n_rows')} AS n_rows,
 {big('n_expected - v + n_expected - c')} AS missing_critical, {big('n_expected - r + n_expected')} AS missing_recoverable,
 {big('n_expected - p')} AS missing_sporadic, n_expected - v <= 2 AND n_expected - c <= 6 AS critical_ok,
 n_expected - v <= 2 AND n_expected - c <= 6 AND n_rows >= n_expected AS is_complete FROM days""",
)
def stream_day_status(spark, sf):
    """Low readings count as missing; ``never`` is a column of the policy that no reading has."""
    kinds = {"view": ("critical", 2), "click": ("critical", 6), "error": ("recoverable", 0), "never": ("recoverable", 0), "purchase": ("sporadic", 0)}
    policy = spark.createDataFrame([(c, k, t) for c, (k, t) in kinds.items()], "column_name string, kind string, tolerance int")
    readings = s.readings(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "series", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    out, state = scratch_path(spark, "day-status"), feeds.state_path(spark, "day-status")

    def start(stream):
        return feeds.start_versions(feeds.closed_day_status(stream, policy, "ts", "series", "value"), out, state, "append")

    _landed_in_turn(spark, readings, "ts", "readings", start)
    return spark.read.parquet(out).drop("batch")


@query(
    "audit_of_runs",
    "S15",
    f"""SELECT event_type AS pipeline, {big('count(*)')} AS registros, CASE WHEN count(*) > 0 THEN 'OK' END AS estado, {num('epoch(max(ts)) - epoch(min(ts))')} AS duracion_seg
 FROM events GROUP BY event_type""",
)
def audit_of_runs(spark, sf):
    """One audit row per series load, appended to an audit table and read back."""
    runs = table(spark, sf, "events").groupBy(F.col("event_type").alias("pipeline")).agg(
        F.min("ts").cast("timestamp").alias("fecha_inicio"), F.max("ts").cast("timestamp").alias("fecha_fin"), F.count("*").alias("registros")
    )
    seconds = F.col("fecha_fin").cast("double") - F.col("fecha_inicio").cast("double")
    path = scratch_path(spark, "audit")
    from gridhour.sources.tables import append_audit

    append_audit(runs.withColumns({"estado": F.lit("OK"), "mensaje": F.lit(""), "duracion_seg": seconds}), path)
    return spark.read.parquet(path).select("pipeline", "registros", "estado", "duracion_seg")


@query(
    "csv_round_trip",
    "S07",
    f"""SELECT {day('o_orderdate')} AS fecha, {num('sum(o_totalprice)')} AS total FROM orders GROUP BY o_orderdate""",
)
def csv_round_trip(spark, sf):
    from gridhour.sources.tables import write_csv

    o = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("fecha")).agg(F.sum("o_totalprice").alias("total"))
    path = scratch_path(spark, "csv")
    write_csv(o, path)
    return spark.read.schema("fecha DATE, total DOUBLE").option("header", True).csv(path)


@query(
    "monthly_parquet_table",
    "S05 S06 S16 S04",
    f"""SELECT {stamp("date_trunc('hour', ts)")} AS ts, strftime(ts, '%Y-%m') AS month, {num('avg(value)')} AS value, CAST(NULL AS DOUBLE) AS added
 FROM events GROUP BY date_trunc('hour', ts), strftime(ts, '%Y-%m')""",
)
def monthly_parquet_table(spark, sf):
    """Hourly table written by month and read through a schema with a later column."""
    from gridhour.operators.resample import to_hour
    from gridhour.sources.schemas import conform
    from gridhour.sources.tables import scan_all, write_hourly

    root = scratch_path(spark, "monthly")
    write_hourly(to_hour(s.readings(spark, sf), "ts", {"value": "avg"}), f"{root}/hourly", "ts")
    found = scan_all(spark, root, ["hourly", "not_there"])["hourly"]
    return conform(found, "ts TIMESTAMP, month STRING, value DOUBLE, added DOUBLE")
