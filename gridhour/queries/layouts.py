"""Intervals, digests, bitmaps and stored layouts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.operators import digests, intervals, profile
from gridhour.plans import model_data
from gridhour.queries import flows  # noqa: F401  registers the spine
from gridhour.queries import surrogates as s
from gridhour.queries.base import REGISTRY, big, num, query, stamp, table
from gridhour.session import scratch_path
from gridhour.sources import layout
from gridhour.sources.tables import write_hourly

# Missing hours as intervals ---------------------------------------------------------------

_GAPS = " UNION ALL ".join(
    f"""SELECT '{t}' AS column_name, min(ts) AS a, max(ts) AS z, count(*) AS n FROM (SELECT ts, ts - INTERVAL 1 HOUR * row_number() OVER (ORDER BY ts) AS island
 FROM cal ANTI JOIN (SELECT ts FROM hourly WHERE "{t}" > 30) h USING (ts)) GROUP BY island"""
    for t in s.TYPES
)


@query(
    "missing_hours_as_intervals",
    "J13 U02 Q03 M11",
    f"""WITH {s.HOURLY}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM hourly), cal AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b), g AS ({_GAPS})
 SELECT column_name, {stamp('a')} AS from_ts, {stamp('z')} AS to_ts, {big('n')} AS n FROM g""",
)
def missing_hours_as_intervals(spark, sf):
    """Low hours count as missing, so each series has runs of them."""
    h = s.hourly_by_type(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), *[F.when(F.col(t) > 30, F.col(t)).alias(t) for t in s.TYPES])
    return intervals.missing_intervals(h, "ts", s.TYPES)


@query(
    "step_levels_on_readings",
    "W05 C17 J20",
    f"""WITH {s.READINGS}, st AS (SELECT series, CAST(ts AS DATE) AS d, max(value) AS level FROM readings WHERE user_id % 50 = 0 GROUP BY 1, 2)
 SELECT {big('r.event_id')} AS event_id, {stamp('r.ts')} AS ts, r.series, {num('st.level')} AS level FROM readings r ASOF LEFT JOIN st ON r.series = st.series AND r.ts >= CAST(st.d AS TIMESTAMP)""",
)
def step_levels_on_readings(spark, sf):
    """Levels that hold until the next one, on readings inside the hour."""
    r = s.readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    steps = r.where(F.col("user_id") % 50 == 0).groupBy("series", F.to_date("ts").alias("d")).agg(F.max("value").alias("level"))
    return intervals.level_at(r.select("event_id", "ts", "series"), "ts", steps, "d", "level", ("series",))


# Distinct counts from bitmaps -------------------------------------------------------------

_IDS = ("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "distinct_counts_by_bitmap",
    "A25",
    " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{c}' AS column_name, {big(f'count(DISTINCT {c})')} AS n_distinct, {big(f'count({c})')} AS n_values FROM lineitem GROUP BY 1, 2" for c in _IDS),
)
def distinct_counts_by_bitmap(spark, sf):
    parts = profile.key_bitmaps(table(spark, sf, "lineitem"), list(_IDS), ("l_returnflag", "l_linestatus"))
    return profile.count_bitmaps(parts, ("l_returnflag", "l_linestatus"))


@query(
    "distinct_counts_of_merged_bitmaps",
    "A25 M08",
    " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS column_name, {big(f'count(DISTINCT {c})')} AS n_distinct, {big(f'count({c})')} AS n_values FROM lineitem GROUP BY 1" for c in _IDS),
)
def distinct_counts_of_merged_bitmaps(spark, sf):
    """Bitmaps are stored by flag and status; those of a flag are merged without the rows."""
    parts = profile.key_bitmaps(table(spark, sf, "lineitem"), list(_IDS), ("l_returnflag", "l_linestatus"))
    path = scratch_path(spark, "bitmaps")
    parts.write.parquet(path)
    return profile.count_bitmaps(spark.read.parquet(path), ("l_returnflag",))


# Digests ----------------------------------------------------------------------------------


@query(
    "diff_by_digest",
    "J15 J16 M12",
    f"""WITH {s.READINGS}, st AS (SELECT event_id, CAST(ts AS DATE) AS d, value, qty FROM readings WHERE event_id % 701 <> 5 OR day(ts) % 5 <> 0),
 fr AS (SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 311 = 7 AND day(ts) % 5 = 1 THEN value + 1 ELSE value END AS value, qty FROM readings WHERE event_id % 503 <> 9 OR day(ts) % 5 <> 0),
 j AS (SELECT coalesce(st.event_id, fr.event_id) AS event_id, coalesce(st.d, fr.d) AS d, st.event_id AS a, fr.event_id AS b, st.value AS ov, fr.value AS nv, st.qty AS oq, fr.qty AS nq FROM st FULL JOIN fr USING (event_id))
 SELECT strftime(d, '%Y-%m-%d') AS part, {big('event_id')} AS event_id, {num('ov')} AS old_value, {num('nv')} AS new_value, {big('oq')} AS old_qty, {big('nq')} AS new_qty,
 CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'gone' ELSE 'changed' END AS state FROM j WHERE a IS NULL OR b IS NULL OR ov <> nv""",
)
def diff_by_digest(spark, sf):
    """Two stored versions of the readings by day; two days in five differ in a few rows."""
    r = s.readings(spark, sf).select("event_id", "value", "qty", F.date_format("ts", "yyyy-MM-dd").alias("part"), F.dayofmonth("ts").alias("dom"))
    k = F.col("dom") % 5
    stored = r.where((F.col("event_id") % 701 != 5) | (k != 0))
    fresh = r.where((F.col("event_id") % 503 != 9) | (k != 0))
    fresh = fresh.withColumn("value", F.when((F.col("event_id") % 311 == 7) & (k == 1), F.col("value") + 1).otherwise(F.col("value")))
    paths = [scratch_path(spark, n) for n in ("stored", "fresh")]
    for df, path in zip((stored, fresh), paths):
        df.drop("dom").repartition("part").write.partitionBy("part").parquet(path)
    a, b = (spark.read.schema("event_id long, value double, qty long, part string").parquet(p) for p in paths)
    return digests.table_diff(a, b, "part", ["event_id"], ["value", "qty"])


# Footers ----------------------------------------------------------------------------------


@query(
    "table_spans",
    "A14 Q09 J22",
    f"""WITH {s.HOURLY}, o AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events WHERE user_id % 2 = 0 AND day(ts) > 3 GROUP BY 1)
 SELECT 'events' AS table_name, {big('count(*)')} AS n_rows, {big('count(price)')} AS n_values, {stamp('min(ts)')} AS first_ts, {stamp('max(ts)')} AS last_ts FROM hourly
 UNION ALL SELECT 'even', {big('count(*)')}, {big('count(v)')}, {stamp('min(ts)')}, {stamp('max(ts)')} FROM o
 UNION ALL SELECT '(shared)', NULL, NULL, {stamp('greatest((SELECT min(ts) FROM hourly), (SELECT min(ts) FROM o))')}, {stamp('least((SELECT max(ts) FROM hourly), (SELECT max(ts) FROM o))')}""",
)
def table_spans(spark, sf):
    """Rows, filled values and spans of two stored hourly tables from their footers, and the span they share."""
    even = s.readings(spark, sf).where((F.col("source") == 0) & (F.dayofmonth("ts") > 3)).groupBy(clock.hour_floor(F.col("ts")).alias("ts")).agg(F.avg("value").alias("price"))
    spans = {}
    for name, df in (("events", s.hourly_by_type(spark, sf).select("ts", "price")), ("even", even)):
        path = scratch_path(spark, "spans")
        write_hourly(df.withColumn("ts", F.col("ts").cast("timestamp")), path, "ts")
        spans[name] = layout.footer_spans(spark, path, ["ts", "price"])
    at = lambda c: F.max(F.when(F.col("column_name") == "ts", F.timestamp_micros(F.col(c).cast("long"))))
    rows = [
        df.agg(F.max("n_rows").alias("n_rows"), F.max(F.when(F.col("column_name") == "price", F.col("n_values"))).alias("n_values"), at("low").alias("first_ts"), at("high").alias("last_ts")).select(F.lit(n).alias("table_name"), "*")
        for n, df in spans.items()
    ]
    none = F.lit(None).cast("bigint")
    both = layout.shared_span(spans["events"], spans["even"], "ts").select(F.lit("(shared)").alias("table_name"), none.alias("n_rows"), none.alias("n_values"), "first_ts", "last_ts")
    return rows[0].unionAll(rows[1]).unionAll(both)


# Buckets ----------------------------------------------------------------------------------

BUCKETS = 8


@query("hourly_spine_bucketed", "J01 J04 J10 C01", REGISTRY["hourly_spine"].sql)
def hourly_spine_bucketed(spark, sf):
    """The spine on hourly tables stored in buckets of their instant: no shuffle between them."""
    t = s.model_tables(spark, sf)
    hourly = [n for n in s.HOURLY_TABLES if n in ("entsoe_gen_data", *dict(model_data.SPINE_HOURLY))]
    return model_data.hourly_spine({**t, **{n: layout.save_bucketed(t[n], "datetime", BUCKETS) for n in hourly}})


# Curve ------------------------------------------------------------------------------------

_AXES = {"lat": (30.0, 50.0), "lon": (-180.0, 180.0), "hour": (0.0, 1024.0)}


@query(
    "weather_box_along_curve",
    "P16 S12",
    f"""WITH {s.READINGS} SELECT {big('event_id')} AS event_id, {num('lat')} AS lat, {num('lon')} AS lon, {num('v')} AS v FROM (SELECT event_id, CAST(34.0 AS DOUBLE) + user_id % 33 * CAST(0.4 AS DOUBLE) AS lat,
 CAST(-15.0 AS DOUBLE) + user_id % 57 * CAST(0.5 AS DOUBLE) AS lon, extract('day' FROM ts) * 24 + extract('hour' FROM ts) AS h, value AS v FROM readings) WHERE lat BETWEEN 36 AND 44 AND lon BETWEEN -9.5 AND 4.5 AND h BETWEEN 200 AND 400""",
)
def weather_box_along_curve(spark, sf):
    r = s.readings(spark, sf)
    grid = r.select(
        "event_id", (F.lit(34.0) + F.col("user_id") % 33 * 0.4).alias("lat"), (F.lit(-15.0) + F.col("user_id") % 57 * 0.5).alias("lon"),
        (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("double").alias("hour"), F.col("value").alias("v"),
    )
    path = scratch_path(spark, "curve")
    layout.write_along_curve(grid, path, _AXES, 8)
    box = {"lat": (36.0, 44.0), "lon": (-9.5, 4.5), "hour": (200.0, 400.0)}
    return layout.read_box(spark, path, _AXES, box).select("event_id", "lat", "lon", "v")


# Landed documents -------------------------------------------------------------------------

_FIELDS = {"id": "bigint", "price": "double", "deal": "timestamp", "unit": "string"}


def _documents(spark, sf):
    """Readings as JSON texts: some are cut off, some lack or spoil a field, some have new ones."""
    r = s.readings(spark, sf)
    k = F.col("event_id") % 20
    price = F.when(k == 1, F.lit('"n/a"')).when(k == 2, F.lit("null")).otherwise(F.col("value").cast("string"))
    parts = F.array_compact(F.array(
        F.when(k != 3, F.concat(F.lit('"id":'), F.col("event_id").cast("string"))),
        F.concat(F.lit('"price":'), price),
        F.concat(F.lit('"deal":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"')),
        F.when(k != 4, F.concat(F.lit('"unit":"'), F.col("series"), F.lit('"'))),
        F.when(k.isin(5, 6), F.lit('"venue":{"code":"X","tier":2}')),
        F.when(k == 6, F.concat(F.lit('"qty":'), F.col("qty").cast("string"))),
        F.when(k == 7, F.lit('"qty":"many"')),
    ))
    text = F.concat(F.lit("{"), F.array_join(parts, ","), F.when(k == 8, F.lit("")).otherwise(F.lit("}")))
    return r.select("event_id", F.when(k == 9, F.lit("[1, 2]")).otherwise(text).alias("text"))


@query(
    "landed_documents",
    "S08 S11",
    f"""WITH {s.READINGS}, k AS (SELECT *, event_id % 20 AS k FROM readings),
 x AS (SELECT *, CASE WHEN k = 8 THEN 'malformed' WHEN k = 9 THEN 'not an object' WHEN k = 3 THEN 'missing id' WHEN k = 2 THEN 'missing price' WHEN k = 1 THEN 'bad price' END AS reason FROM k)
 SELECT {big('event_id')} AS event_id, reason, {big('CASE WHEN k NOT IN (3, 8, 9) THEN event_id END')} AS id, {num('CASE WHEN k NOT IN (1, 2, 8, 9) THEN value END')} AS price,
 CASE WHEN k NOT IN (8, 9) THEN {stamp("date_trunc('second', ts)")} END AS deal, CASE WHEN k NOT IN (4, 8, 9) THEN series END AS unit,
 CASE WHEN k = 6 THEN 'qty,venue' WHEN k = 5 THEN 'venue' WHEN k = 7 THEN 'qty' WHEN k NOT IN (8, 9) THEN '' END AS extra_names, CASE WHEN k IN (5, 6) THEN 'X' END AS venue_code, {big('CASE WHEN k = 6 THEN qty END')} AS qty FROM x""",
)
def landed_documents(spark, sf):
    """Written with their VARIANT, read back, and a field that was unknown at landing read afterwards."""
    from gridhour.sources import landed

    path = scratch_path(spark, "landed-documents")
    landed.read_documents(_documents(spark, sf), "text", _FIELDS, ("id", "price")).write.parquet(path)
    back = landed.promote(spark.read.parquet(path), "qty", "bigint")
    names = F.array_join(F.array_sort(F.map_keys("extra")), ",")
    code = F.try_variant_get(F.element_at("extra", F.lit("venue")), "$.code", "string")
    return back.select("event_id", "reason", *_FIELDS, names.alias("extra_names"), code.alias("venue_code"), "qty")


@query(
    "landed_extra_fields",
    "S08 S13",
    f"""WITH {s.READINGS}, k AS (SELECT event_id % 20 AS k FROM readings) SELECT 'venue' AS field, 'OBJECT<code: STRING, tier: BIGINT>' AS type, {big('count(*)')} AS n FROM k WHERE k IN (5, 6)
 UNION ALL SELECT 'qty', 'BIGINT', {big('count(*)')} FROM k WHERE k = 6 UNION ALL SELECT 'qty', 'STRING', {big('count(*)')} FROM k WHERE k = 7""",
)
def landed_extra_fields(spark, sf):
    from gridhour.sources import landed

    return landed.extra_fields(landed.read_documents(_documents(spark, sf), "text", _FIELDS, ("id", "price")))
