"""Joins, set comparisons, snapshots and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour.functions import clock, energy
from gridhour.functions.numbers import none_null
from gridhour.operators import calendar, dedupe, joins, merge
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, ldate, lhour, num, query, stamp, table
from gridhour.sources import tables as src

# Joins ----------------------------------------------------------------------------------


@query(
    "bronze_union_hourly_daily",
    "J04 J05 J06 R4",
    f"""WITH {s.HOURLY}, {s.COMMODITIES}, b AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events),
 cal AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts_utc FROM b),
 wx AS (SELECT ts AS ts_utc, error AS t2m FROM hourly WHERE extract('hour' FROM ts) % 3 = 0)
 SELECT {stamp('cal.ts_utc')} AS ts_utc, {day(ldate('cal.ts_utc'))} AS date_local, {big(lhour('cal.ts_utc'))} AS hour_local,
 {num('h.view')} AS load, {num('wx.t2m')} AS t2m,
 {num(f"CASE WHEN {lhour('cal.ts_utc')} = 0 THEN c.gas_mibgas END")} AS gas
 FROM cal LEFT JOIN hourly h ON h.ts = cal.ts_utc LEFT JOIN wx USING (ts_utc) LEFT JOIN commodities c ON c.fecha = {ldate('cal.ts_utc')}""",
)
def bronze_union_hourly_daily(spark, sf):
    hourly = s.hourly_by_type(spark, sf)
    cal = calendar.hourly_calendar(calendar.hour_bounds(table(spark, sf, "events"), "ts"))
    wx = hourly.where(F.hour("ts") % 3 == 0).select(F.col("ts").alias("ts_utc"), F.col("error").alias("t2m"))
    daily = s.commodities_table(spark, sf).select(F.col("fecha").alias("date_local"), F.col("gas_mibgas").alias("gas"))
    load = hourly.select(F.col("ts").alias("ts_utc"), F.col("view").alias("load"))
    out = joins.join_grains(cal, [("hourly", load), ("3h", wx), ("daily", daily)])
    return out.select("ts_utc", "date_local", "hour_local", "load", "t2m", "gas")


@query(
    "suffix_join",
    "J01",
    f"""WITH {s.HOURLY} SELECT {stamp('a.ts')} AS ts, {num('a.view')} AS "view", {num('b.view')} AS view_other, {num('b.error')} AS error
 FROM hourly a LEFT JOIN (SELECT ts, click AS view, error FROM hourly WHERE error IS NOT NULL) b USING (ts)""",
)
def suffix_join(spark, sf):
    h = s.hourly_by_type(spark, sf)
    other = h.where(F.col("error").isNotNull()).select("ts", F.col("click").alias("view"), "error")
    return joins.left_with_suffix(h.select("ts", "view"), other, ["ts"], "_other")


@query(
    "spread_daily",
    "J02",
    f"""WITH {s.HOURLY}, {s.CAPACITY} SELECT {stamp('ts')} AS ts, {num('price')} AS price, {num('total_mw')} AS total_mw
 FROM hourly LEFT JOIN esios_capacity_available c ON c.date = {ldate('ts')}""",
)
def spread_daily(spark, sf):
    hourly = joins.with_local_day(s.hourly_by_type(spark, sf).select("ts", "price"), "ts")
    daily = s.capacity_table(spark, sf).withColumnRenamed("date", "fecha")
    return joins.spread_daily(hourly, daily, "fecha").drop("fecha")


@query(
    "common_hours",
    "J07 J18 U04 P08 P24 P26",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('view - click')} AS self_consumption, {num('abs(view - click)')} AS gap
 FROM hourly WHERE view IS NOT NULL AND click IS NOT NULL""",
)
def common_hours(spark, sf):
    h = s.hourly_by_type(spark, sf)
    a, b = h.select("ts", "view").dropna(), h.select("ts", "click").dropna()
    return joins.pair_on_key(a, b, ["ts"]).select(
        "ts",
        energy.self_consumption(F.col("view"), F.col("click")).alias("self_consumption"),
        energy.disagreement(F.col("view"), F.col("click")).alias("gap"),
    )


@query(
    "four_way_sources",
    "J08 J20",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('coalesce(view, click)')} AS demand,
 {num('CASE WHEN error IS NULL OR signup IS NULL THEN NULL ELSE greatest(0, error - signup) END')} AS clean FROM hourly WHERE price IS NOT NULL""",
)
def four_way_sources(spark, sf):
    h = s.hourly_by_type(spark, sf)
    out = h.select("ts")
    for c in ("view", "click", "error", "signup"):
        out = joins.left_with_suffix(out, h.where(F.col(c).isNotNull()).select("ts", c), ["ts"], f"_{c}")
    return out.select(
        "ts",
        joins.first_source("view", "click").alias("demand"),
        energy.clean_pv(F.col("error"), F.col("signup")).alias("clean"),
    )


@query(
    "outer_join_blocks",
    "J09 J10",
    f"""WITH a AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS x FROM events WHERE event_type = 'view' AND value > 150 GROUP BY 1),
 b AS (SELECT CAST(ts AS DATE) + 1 AS d, max(value) AS y FROM events WHERE event_type = 'click' AND value > 150 GROUP BY 1)
 SELECT {day('d')} AS fecha, {num('x')} AS x, {num('y')} AS y FROM a FULL JOIN b USING (d)""",
)
def outer_join_blocks(spark, sf):
    """Days with high prices in one series or, a day later, in the other."""
    e = table(spark, sf, "events").where(F.col("value") > 150)
    a = e.where(F.col("event_type") == "view").groupBy(F.to_date("ts").alias("fecha")).agg(F.avg("value").alias("x"))
    b = e.where(F.col("event_type") == "click").groupBy(F.date_add(F.to_date("ts"), 1).alias("fecha")).agg(F.max("value").alias("y"))
    return joins.outer_blocks([a, b], "fecha")


@query(
    "full_outer_join",
    "J09",
    f"""WITH {s.STORED_FRESH} SELECT {stamp('ts')} AS ts, {num('stored.a')} AS a, {num('fresh.b')} AS b FROM stored FULL JOIN fresh USING (ts)""",
)
def full_outer_join(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return joins.full_outer(stored.select("ts", "a"), fresh.select("ts", "b"), ["ts"])


_EXPECTED = """b AS (SELECT event_type AS series, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events GROUP BY 1),
 expected AS (SELECT series, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b)"""


def _expected_by_series(spark, sf):
    span = s.readings(spark, sf).groupBy("series").agg(
        clock.hour_floor(F.min("ts")).alias("start"), clock.hour_floor(F.max("ts")).alias("end")
    )
    return span.select("series", F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 HOUR"))).alias("ts"))


@query(
    "missing_hours",
    "J13 U02",
    f"""WITH {_EXPECTED}, got AS (SELECT DISTINCT event_type AS series, date_trunc('hour', ts) AS ts FROM events)
 SELECT series, {stamp('ts')} AS ts FROM (SELECT * FROM expected EXCEPT SELECT * FROM got)""",
)
def missing_hours(spark, sf):
    got = s.readings(spark, sf).select("series", clock.hour_floor(F.col("ts")).alias("ts")).distinct()
    return joins.missing_keys(_expected_by_series(spark, sf), got, ["series", "ts"])


@query(
    "hours_to_load",
    "U03 P18",
    f"""WITH {s.HOURLY}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM hourly), e AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b)
 SELECT {stamp('ts')} AS ts FROM (SELECT ts FROM e EXCEPT SELECT ts FROM hourly UNION SELECT ts FROM hourly WHERE view IS NULL OR click IS NULL)""",
)
def hours_to_load(spark, sf):
    h = s.hourly_by_type(spark, sf)
    expected = calendar.hourly_calendar(calendar.hour_bounds(h, "ts")).select(F.col("ts_utc").alias("ts"))
    return joins.keys_to_load(expected, h, ["ts"], ["view", "click"])


@query(
    "stored_keys_and_orphans",
    "J14 J16",
    f"""WITH {s.STORED_FRESH} SELECT 'orphan' AS kind, {stamp('ts')} AS ts, {num('a')} AS a FROM fresh WHERE ts NOT IN (SELECT ts FROM stored)
 UNION ALL SELECT 'kept', {stamp('ts')}, {num('a')} FROM fresh WHERE ts IN (SELECT ts FROM stored)""",
)
def stored_keys_and_orphans(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    lost = joins.orphans(fresh, stored, ["ts"]).select(F.lit("orphan").alias("kind"), "ts", "a")
    return lost.unionByName(joins.stored_only(fresh, stored, ["ts"]).select(F.lit("kept").alias("kind"), "ts", "a"))


_CHANGED = "(n.{c} IS NOT NULL AND (o.{c} IS NULL OR abs(o.{c} - n.{c}) > {tol}))"


def _changed_sql(c: str, tol: float) -> str:
    return f"coalesce({_CHANGED.format(c=c, tol=tol)}, false)"


@query(
    "diff_stored_vs_live",
    "J15",
    f"""WITH {s.STORED_FRESH} SELECT {stamp('ts')} AS ts, {num('o.a')} AS old_a, {num('n.a')} AS new_a, {_changed_sql('a', 5.0)} AS diff_a
 FROM stored o JOIN fresh n USING (ts)""",
)
def diff_stored_vs_live(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return joins.compare_values(stored, fresh, ["ts"], ["a"], 5.0)


@query(
    "snapshot_as_known",
    "J12",
    f"""WITH {s.SNAPSHOTS} SELECT {day('run_date')} AS run_date, {day('target_date')} AS target_date, {num('nuclear_mw')} AS nuclear_mw,
 {num('ccgt_mw')} AS ccgt_mw FROM snapshots WHERE run_date = target_date - 1""",
)
def snapshot_as_known(spark, sf):
    return joins.as_known_before(s.snapshots(spark, sf))


@query(
    "snapshot_revision",
    "J11",
    f"""WITH {s.SNAPSHOTS} SELECT {day('a.target_date')} AS target_date, {num('a.nuclear_mw - b.nuclear_mw')} AS revision_nuclear_mw,
 {num('a.ccgt_mw - b.ccgt_mw')} AS revision_ccgt_mw
 FROM snapshots a JOIN snapshots b ON b.target_date = a.target_date AND b.run_date = a.run_date - 6 WHERE a.run_date = a.target_date - 1""",
)
def snapshot_revision(spark, sf):
    return joins.snapshot_revision(s.snapshots(spark, sf), ["nuclear_mw", "ccgt_mw"])


@query(
    "incremental_window",
    "J22",
    f"""WITH {s.STORED_FRESH} SELECT {stamp('ts')} AS ts, {num('a')} AS a FROM fresh WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM stored)""",
)
def incremental_window(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return joins.newer_than_window(fresh.select("ts", "a"), stored, "ts", 7)


@query(
    "tagged_union",
    "U01 P20 C06 S02",
    """SELECT 'nation' AS source_df, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey,
 CAST(NULL AS BIGINT) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM nation
 UNION ALL SELECT 'region', NULL, NULL, NULL, CAST(r_regionkey AS BIGINT), r_name, NULL, NULL FROM region
 UNION ALL SELECT 'supplier', NULL, NULL, NULL, NULL, NULL, CAST(s_suppkey AS BIGINT), s_name FROM supplier""",
)
def tagged_union(spark, sf):
    from gridhour.plans.bronze import bronze_concat

    return bronze_concat(
        {
            "nation": table(spark, sf, "nation"),
            "region": table(spark, sf, "region"),
            "supplier": table(spark, sf, "supplier").select("s_suppkey", "s_name"),
        }
    )


@query(
    "time_range_scan",
    "S01 S03",
    f"""SELECT {big('l_orderkey')} AS l_orderkey, {num('l_quantity')} AS l_quantity, {day('l_shipdate')} AS l_shipdate FROM lineitem
 WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1996-04-16'""",
)
def time_range_scan(spark, sf):
    df = src.scan(spark, f"{sf}/lineitem.parquet", "l_shipdate", ("l_orderkey", "l_quantity"))
    return src.between(df, "l_shipdate", "1996-03-01", "1996-04-15").withColumn("l_shipdate", F.to_date("l_shipdate"))


@query(
    "normalized_time_axis",
    "P01 P02 C05",
    f"""SELECT {day('o_orderdate')} AS date_local, {big('o_orderkey')} AS ord_o_orderkey, {num('o_totalprice')} AS ord_o_totalprice FROM orders""",
)
def normalized_time_axis(spark, sf):
    from gridhour.registry import TableSpec

    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    with_audit = o.withColumn("updated_at", F.current_timestamp())
    return src.normalize_time(with_audit, TableSpec("o_orderdate", "ord", "daily"))


# Merges ---------------------------------------------------------------------------------


def _merge_sql(cell: str, join: str = "FULL") -> str:
    cells = ", ".join(f"{num('CASE WHEN o.ts IS NULL THEN n.' + c + ' ELSE ' + cell.format(c=c) + ' END')} AS {c}" for c in "ab")
    return f"WITH {s.STORED_FRESH} SELECT {stamp('coalesce(o.ts, n.ts)')} AS ts, {cells} FROM stored o {join} JOIN fresh n ON o.ts = n.ts"


def _merged(policy, tol=0.0):
    def build(spark, sf):
        stored, fresh = s.stored_and_fresh(spark, sf)
        return merge.merge_frames(stored, fresh, ["ts"], policy, tol)

    return build


_BOTH = "CASE WHEN n.ts IS NOT NULL THEN n.{c} ELSE o.{c} END"
query("merge_insert_ignore", "M01", _merge_sql("o.{c}"))(_merged(merge.INSERT_IGNORE))
query("merge_fill_null", "M02", _merge_sql("coalesce(o.{c}, n.{c})"))(_merged(merge.FILL_NULL))
query(
    "merge_overwrite_tol", "M03", _merge_sql("CASE WHEN " + _CHANGED.replace("{tol}", "5.0") + " THEN n.{c} ELSE o.{c} END")
)(_merged(merge.OVERWRITE_DIFFERENT, 5.0))
query("merge_upsert", "M04", _merge_sql(_BOTH))(_merged(merge.UPSERT))
query("merge_coalesce_new", "M05", _merge_sql("coalesce(n.{c}, o.{c})"))(_merged(merge.PREFER_FRESH))
query("merge_overwrite_existing", "M06", _merge_sql(_BOTH, "LEFT"))(_merged(merge.OVERWRITE_EXISTING))
query("merge_update_only", "M07", _merge_sql("coalesce(n.{c}, o.{c})", "LEFT"))(_merged(merge.UPDATE_ONLY))


@query(
    "merge_change_counts",
    "M12",
    f"""WITH {s.STORED_FRESH}, p AS (SELECT {_changed_sql('a', 5.0)} AS ca, {_changed_sql('b', 5.0)} AND o.b IS NOT NULL AS cb FROM stored o JOIN fresh n USING (ts))
 SELECT 'a' AS column_name, {big('count(*) FILTER (WHERE ca)')} AS n_changed, false AS is_control FROM p
 UNION ALL SELECT 'b', {big('count(*) FILTER (WHERE cb)')}, true FROM p""",
)
def merge_change_counts(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return merge.change_counts(stored, fresh, ["ts"], ["a", "b"], 5.0, ("b",))


_R1, _R2 = ("2024-01-10", "2024-01-20"), ("2024-01-08", "2024-01-22")


@query(
    "merge_exact_and_margin",
    "M13",
    f"""WITH {s.STORED_FRESH}, add_new AS (SELECT * FROM fresh WHERE ts BETWEEN DATE '{_R1[0]}' AND DATE '{_R1[1]}' AND ts NOT IN (SELECT ts FROM stored)),
 base AS (SELECT * FROM stored UNION ALL SELECT * FROM add_new),
 upd AS (SELECT * FROM fresh WHERE ts BETWEEN DATE '{_R2[0]}' AND DATE '{_R2[1]}')
 SELECT {stamp('o.ts')} AS ts, {num('coalesce(o.a, n.a)')} AS a, {num('coalesce(o.b, n.b)')} AS b FROM base o LEFT JOIN upd n ON o.ts = n.ts""",
)
def merge_exact_and_margin(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    at = lambda t: F.lit(t).cast("timestamp")
    return merge.ranged_merge(stored, fresh, "ts", tuple(map(at, _R1)), tuple(map(at, _R2)), merge.FILL_NULL)


@query(
    "months_to_rewrite",
    "M10",
    f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT d, date_trunc('month', d) AS m FROM d
 UNION ALL SELECT d, date_trunc('month', d) - INTERVAL 1 MONTH FROM d WHERE day(d) <= 5)
 SELECT {day('d')} AS today, {day('m')} AS month FROM m""",
)
def months_to_rewrite(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("today")).distinct()
    return days.select("today", F.explode(merge.months_to_rewrite(F.col("today"))).alias("month"))


@query(
    "merge_into_parquet_table",
    "M08 M10 S05 S06",
    f"""WITH {s.STORED_FRESH} SELECT {stamp('coalesce(o.ts, n.ts)')} AS ts, {num('coalesce(o.a, n.a)')} AS a, {num('coalesce(o.b, n.b)')} AS b
 FROM stored o FULL JOIN fresh n ON o.ts = n.ts""",
)
def merge_into_parquet_table(spark, sf):
    """Stored rows land in a parquet table by day; the fresh rows are merged into it on disk."""
    from gridhour.session import scratch_path

    stored, fresh = s.stored_and_fresh(spark, sf)
    path = scratch_path(spark, "merged-table")
    with_day = lambda df: df.withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    merge.merge_into_parquet(spark, path, with_day(stored), ["ts"], merge.UPSERT, "part")
    merge.merge_into_parquet(spark, path, with_day(fresh), ["ts"], merge.FILL_NULL, "part")
    return spark.read.parquet(path).select("ts", "a", "b")


# Derived columns ------------------------------------------------------------------------


@query(
    "clean_pv",
    "P06 F22",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('CASE WHEN view IS NULL OR click IS NULL THEN NULL ELSE greatest(0, view - click) END')} AS pv FROM hourly""",
)
def clean_pv(spark, sf):
    h = s.hourly_by_type(spark, sf)
    return h.select("ts", energy.clean_pv(F.col("view"), F.col("click")).alias("pv"))


@query(
    "hydro_dispatch",
    "P07",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('view + coalesce(click, 0)')} AS hydro FROM hourly""",
)
def hydro_dispatch(spark, sf):
    h = s.hourly_by_type(spark, sf)
    return h.select("ts", energy.dispatchable_hydro(F.col("view"), F.col("click")).alias("hydro"))


@query(
    "net_flow_null",
    "P09 P19",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('view + click - error')} AS net, {num('price - (view + click - error)')} AS generation,
 {num('CASE WHEN error IS NOT NULL THEN greatest(0, error - 50) END')} AS imports,
 {num('CASE WHEN error IS NOT NULL THEN greatest(0, 50 - error) END')} AS exports FROM hourly""",
)
def net_flow_null(spark, sf):
    h = s.hourly_by_type(spark, sf)
    net = energy.net_flow(F.col("view"), F.col("click"), -F.col("error"))
    flow = F.col("error") - F.lit(50.0)
    return h.select(
        "ts",
        net.alias("net"),
        energy.generation_from_load(F.col("price"), net).alias("generation"),
        energy.imports(flow).alias("imports"),
        energy.exports(flow).alias("exports"),
    )


@query(
    "row_sums_and_ranges",
    "A33 A34 P10 P11 P12 P18 F09 F26",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('coalesce(view, 0) + coalesce(click, 0)')} AS sum_zero,
 {num('CASE WHEN coalesce(view, click) IS NOT NULL THEN coalesce(view, 0) + coalesce(click, 0) END')} AS sum_any,
 {num('CASE WHEN view BETWEEN 10 AND 60 THEN view END')} AS ranged, {num('nullif(floor(view / 40), 0)')} AS no_zero,
 {num('view - 273.15')} AS celsius, {num('view / 3600')} AS watts, {num('view * 1000')} AS mm,
 view IS NOT NULL AND click IS NOT NULL AS complete FROM hourly""",
)
def row_sums_and_ranges(spark, sf):
    from gridhour.functions import numbers as n

    h = s.hourly_by_type(spark, sf)
    v = F.col("view")
    return h.select(
        "ts",
        n.sum_null_as_zero(["view", "click"]).alias("sum_zero"),
        n.sum_if_any(["view", "click"]).alias("sum_any"),
        n.within(v, 10, 60).alias("ranged"),
        n.zero_to_null(F.floor(v / 40).cast("double")).alias("no_zero"),
        energy.to_celsius(v).alias("celsius"),
        energy.joules_to_watts(v).alias("watts"),
        energy.metres_to_mm(v).alias("mm"),
        none_null(["view", "click"]).alias("complete"),
    )


@query(
    "derived_columns",
    "P05 X01 X03",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('CASE WHEN view IS NULL OR click IS NULL THEN NULL ELSE greatest(0, view - click) END')} AS pv FROM hourly""",
)
def derived_columns(spark, sf):
    from gridhour.plans.bronze import add_derived
    from gridhour.registry import DerivedSpec

    specs = (
        DerivedSpec("pv", ("view", "click"), energy.clean_pv),
        DerivedSpec("skipped", ("view", "not_there"), energy.clean_pv),
    )
    return add_derived(s.hourly_by_type(spark, sf), specs).select("ts", "pv")


@query(
    "programme_without_bilateral",
    "P25",
    f"""WITH {s.HOURLY} SELECT {stamp('ts')} AS ts, {num('view - click')} AS "pdbc_view" FROM hourly""",
)
def programme_without_bilateral(spark, sf):
    from gridhour.plans.feeds import without_bilateral

    h = s.hourly_by_type(spark, sf)
    return without_bilateral(h.select("ts", "view"), h.select("ts", F.col("click").alias("bil")), {"view": "bil"})


@query(
    "half_even_rounding",
    "P22",
    f"""SELECT {big('p_partkey')} AS p_partkey, {num('round_even(p_partkey / 8.0, 2)')} AS even, {num('round(p_partkey / 8.0, 2)')} AS up FROM part""",
)
def half_even_rounding(spark, sf):
    from gridhour.functions.numbers import half_even, half_up

    x = F.col("p_partkey") / F.lit(8.0)
    return table(spark, sf, "part").select("p_partkey", half_even(x).alias("even"), half_up(x).alias("up"))


@query(
    "keep_last_of_resampled",
    "W11 A01",
    f"""WITH {s.READINGS} SELECT {day("ts")} AS day, {num('arg_max(value, (ts, event_id))')} AS last_value FROM readings GROUP BY CAST(ts AS DATE), {day("ts")}""",
)
def keep_last_of_resampled(spark, sf):
    r = s.readings(spark, sf).select(F.to_date("ts").alias("day"), "ts", "event_id", F.col("value").alias("last_value"))
    return dedupe.keep_last(r, ["day"], ["ts", "event_id"]).select("day", "last_value")


@query(
    "registry_columns",
    "P23 X02",
    f"""WITH {s.MODEL_TABLES} SELECT {stamp('datetime')} AS datetime, {num('demanda_prev_mw')} AS demanda_prev_mw,
 {num('gen_wind_prev_mw')} AS gen_wind_prev_mw FROM esios_forecast_da""",
)
def registry_columns(spark, sf):
    from gridhour import registry as reg

    t = s.hourly_table(s.hourly_by_type(spark, sf), "esios_forecast_da").withColumn(reg.LEAKING_COLUMNS[0], F.lit(0.0))
    safe = t.select("datetime", *[c for c in reg.FORECAST_COLUMNS if c not in reg.LEAKING_COLUMNS])
    return safe.select("datetime", "demanda_prev_mw", "gen_wind_prev_mw")
