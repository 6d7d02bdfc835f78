"""Profiles, statistics and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridhour.functions import clock
from gridhour.operators import profile, quality
from gridhour.queries import surrogates as s
from gridhour.queries.base import big, day, day_length, ldate, lhour, num, query, stamp, table

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SERIES = ["view", "signup", "error", "click", "purchase"]


def _stack(sql_of, cols: list[str], frm: str) -> str:
    """UNION ALL of one SELECT per column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {sql_of(c)} FROM {frm}" for c in cols)


# Counts and profiles --------------------------------------------------------------------


@query(
    "coverage_by_column",
    "A11 A12 A13 A14 F24",
    f"WITH {s.HOURLY} " + _stack(
        lambda c: f"{big('count(*)')} AS n_rows, {stamp('min(ts)')} AS first_ts, {stamp('max(ts)')} AS last_ts, "
        f"{big(f'count({c})')} AS n_values, {num(f'100.0 * count({c}) / count(*)')} AS pct_filled",
        SERIES, "hourly",
    ),
)
def coverage_by_column(spark, sf):
    return profile.coverage(s.hourly_by_type(spark, sf), "ts", SERIES)


@query(
    "null_profile_bands",
    "A24 A12 F21 O03",
    f"WITH {s.HOURLY} " + _stack(
        lambda c: f"{big('count(*)')} AS n_rows, {big(f'count({c})')} AS n_values, {big(f'count(*) - count({c})')} AS n_nulls, "
        f"{num(f'100.0 * (count(*) - count({c})) / count(*)')} AS pct_null, "
        f"CASE WHEN 100.0 * (count(*) - count({c})) / count(*) <= 5 THEN 'ok' WHEN 100.0 * (count(*) - count({c})) / count(*) <= 20 THEN 'review' ELSE 'alert' END AS level",
        SERIES, "hourly",
    ),
)
def null_profile_bands(spark, sf):
    return profile.null_bands(s.hourly_by_type(spark, sf), SERIES).orderBy(F.desc("pct_null"))


@query(
    "exact_quantile",
    "A22",
    f"SELECT {num('0.99')} AS prob, {num('quantile_cont(l_extendedprice, 0.99)')} AS q FROM lineitem",
)
def exact_quantile(spark, sf):
    return profile.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.99])


@query(
    "exact_quantiles_by_group",
    "A22",
    " UNION ALL ".join(
        f"SELECT l_returnflag, {num(p)} AS prob, {num(f'quantile_cont(l_extendedprice * (1 - l_discount), {p})')} AS q FROM lineitem GROUP BY 1"
        for p in (0.05, 0.5, 0.95)
    ),
)
def exact_quantiles_by_group(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return profile.exact_quantiles(li, "net", [0.05, 0.5, 0.95], ("l_returnflag",))


_PCT = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query(
    "describe_percentiles",
    "A21",
    _stack(
        lambda c: f"{big(f'count({c})')} AS n, {num(f'avg({c})')} AS mean, {num(f'stddev_samp({c})')} AS std, {num(f'min({c})')} AS min, "
        f"{num(f'max({c})')} AS max, " + ", ".join(f"{num(f'quantile_cont({c}, {p})')} AS {n}" for n, p in _PCT.items()),
        LINE_COLUMNS, "lineitem",
    ),
)
def describe_percentiles(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), LINE_COLUMNS, _PCT)


def _outliers_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, {num('any_value(q1)')} AS q1, {num('any_value(q3)')} AS q3, "
        f"{big(f'count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))')} AS n_outliers "
        f"FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) q"
    )


@query("iqr_outliers", "A23 O03", " UNION ALL ".join(_outliers_sql(c) for c in LINE_COLUMNS))
def iqr_outliers(spark, sf):
    return profile.iqr_outliers(table(spark, sf, "lineitem"), LINE_COLUMNS)


@query(
    "constant_columns",
    "A26",
    f"""SELECT 'fixed' AS column_name, {num('5')} AS constant_value, {big('count(*)')} AS n_values FROM lineitem""",
)
def constant_columns(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"fixed": F.lit(5.0), "empty": F.lit(None).cast("double")})
    return profile.constant_columns(li, [*LINE_COLUMNS, "fixed", "empty"])


@query("empty_columns", "A27 Q19", f"SELECT 'empty' AS column_name, {big('count(*)')} AS n_rows FROM lineitem")
def empty_columns(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"fixed": F.lit(5.0), "empty": F.lit(None).cast("double")})
    return profile.empty_columns(li, [*LINE_COLUMNS, "fixed", "empty"])


@query(
    "distinct_counts",
    "A25",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS column_name, {big(f'count(DISTINCT {c})')} AS n_distinct, {big(f'count({c})')} AS n_values FROM lineitem GROUP BY 1"
        for c in ("l_partkey", "l_suppkey")
    ),
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ("l_returnflag",))


@query(
    "value_counts",
    "A28 Q17",
    f"""WITH {s.HOURLY} SELECT {big(lhour('ts'))} AS hour_local, {big('count(*)')} AS n FROM hourly WHERE view < 20 GROUP BY {lhour('ts')}""",
)
def value_counts(spark, sf):
    return quality.hours_of(s.hourly_by_type(spark, sf), "ts", F.col("view") < 20).orderBy("hour_local")


@query(
    "zero_share",
    "A37",
    _stack(lambda c: f"{num(f'avg(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)')} AS zero_share", ["l_discount", "l_tax"], "lineitem"),
)
def zero_share(spark, sf):
    return profile.zero_share(table(spark, sf, "lineitem"), ["l_discount", "l_tax"])


@query(
    "conditional_describe",
    "A38",
    f"""WITH {s.HOURLY} SELECT click IS NULL AS other_missing, {big('count(view)')} AS n, {num('avg(view)')} AS mean,
 {num('stddev_samp(view)')} AS std, {num('min(view)')} AS min, {num('max(view)')} AS max FROM hourly WHERE view IS NOT NULL GROUP BY 1""",
)
def conditional_describe(spark, sf):
    return profile.conditional_describe(s.hourly_by_type(spark, sf), "view", "click")


@query(
    "missing_together",
    "A39",
    f"""WITH {s.HOURLY} SELECT {big('count(*) FILTER (WHERE view IS NULL AND click IS NOT NULL)')} AS n_missing_while_present FROM hourly""",
)
def missing_together(spark, sf):
    return profile.missing_together(s.hourly_by_type(spark, sf), "view", "click")


@query(
    "monthly_mean",
    "A18",
    f"""SELECT l_returnflag, {day("date_trunc('month', l_shipdate)")} AS month, {num('avg(l_quantity)')} AS l_quantity,
 {num('avg(l_extendedprice)')} AS l_extendedprice FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate)""",
)
def monthly_mean(spark, sf):
    return profile.monthly_mean(table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], ("l_returnflag",))


@query(
    "last_18_months",
    "O06 A18",
    f"""WITH m AS (SELECT date_trunc('month', l_shipdate) AS m, avg(l_quantity) AS q FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 18)
 SELECT {day('m')} AS month, {num('q')} AS l_quantity FROM m""",
)
def last_18_months(spark, sf):
    monthly = profile.monthly_mean(table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity"])
    return monthly.orderBy(F.desc("month")).limit(18)


@query(
    "yearly_summary",
    "A17",
    f"""SELECT {big('year(l_shipdate)')} AS year, {big('count(l_quantity)')} AS l_quantity_n, {num('avg(l_quantity)')} AS l_quantity_mean,
 {num('min(l_quantity)')} AS l_quantity_min, {num('max(l_quantity)')} AS l_quantity_max FROM lineitem GROUP BY year(l_shipdate)""",
)
def yearly_summary(spark, sf):
    return profile.yearly_summary(table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity"])


_RES = "l_extendedprice - 1400 * l_quantity - 5000 * l_discount"


def _residual_sql(by: str) -> str:
    head = f"{by}, " if by else ""
    return (
        f"SELECT {head}{num('avg(r)')} AS mean, {num('stddev_samp(r)')} AS std, {num('min(r)')} AS min, {num('max(r)')} AS max, "
        f"{num('avg(abs(r))')} AS mean_abs, {big('count(*)')} AS n FROM (SELECT {big('year(l_shipdate)')} AS year, "
        f"CASE WHEN l_tax > 0 THEN {_RES} END AS r FROM lineitem) x WHERE r IS NOT NULL" + (f" GROUP BY {by}" if by else "")
    )


def _residual():
    return F.when(F.col("l_tax") > 0, F.col("l_extendedprice") - 1400 * F.col("l_quantity") - 5000 * F.col("l_discount"))


@query("balance_residual", "A15", _residual_sql(""))
def balance_residual(spark, sf):
    return profile.residual_summary(table(spark, sf, "lineitem"), _residual(), [])


@query("yearly_residual", "A16", _residual_sql("year"))
def yearly_residual(spark, sf):
    return profile.residual_summary(table(spark, sf, "lineitem"), _residual(), [F.year("l_shipdate").alias("year")])


@query(
    "hour_profile",
    "A19",
    f"""WITH {s.HOURLY} SELECT {big(lhour('ts'))} AS hour_local, {num('avg(view)')} AS "view", {num('avg(click)')} AS click FROM hourly GROUP BY {lhour('ts')}""",
)
def hour_profile(spark, sf):
    return profile.hour_profile(s.hourly_by_type(spark, sf), "ts", ["view", "click"])


@query(
    "daily_coverage",
    "A30",
    f"""WITH {s.HOURLY} SELECT {day('ts')} AS day, {num('avg(CASE WHEN view IS NULL THEN 0 ELSE 1 END)')} AS "view",
 {num('avg(CASE WHEN click IS NULL THEN 0 ELSE 1 END)')} AS click FROM hourly GROUP BY {day('ts')}""",
)
def daily_coverage(spark, sf):
    return profile.daily_coverage(s.hourly_by_type(spark, sf), "ts", ["view", "click"])


@query(
    "correlations",
    "A20",
    f"""SELECT l_returnflag, {num('corr(l_quantity, l_extendedprice)')} AS c1, {num('corr(l_quantity, l_discount)')} AS c2 FROM lineitem GROUP BY 1""",
)
def correlations(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.corr("l_quantity", "l_extendedprice").alias("c1"), F.corr("l_quantity", "l_discount").alias("c2")
    )


@query(
    "before_after_cut",
    "W19",
    f"""WITH {s.HOURLY}, p AS (SELECT {ldate('ts')} >= DATE '2024-01-18' AS late, view AS a, click AS b, view - click AS d FROM hourly
 WHERE view IS NOT NULL AND click IS NOT NULL)
 SELECT {big('count(*)')} AS n, {num('corr(a, b) FILTER (WHERE NOT late)')} AS corr_before, {num('corr(a, b) FILTER (WHERE late)')} AS corr_after,
 {num('avg(d) FILTER (WHERE NOT late)')} AS mean_before, {num('avg(d) FILTER (WHERE late)')} AS mean_after,
 {num('stddev_samp(d) FILTER (WHERE NOT late)')} AS std_before, {num('stddev_samp(d) FILTER (WHERE late)')} AS std_after,
 {num('avg(d) FILTER (WHERE late) - avg(d) FILTER (WHERE NOT late)')} AS jump FROM p""",
)
def before_after_cut(spark, sf):
    h = s.hourly_by_type(spark, sf).withColumn("fecha", clock.local_date(F.col("ts")))
    return profile.before_after(h, "fecha", "view", "click", "2024-01-18")


_MONTHLY_DIFF = """m AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate) AS m, avg(l_quantity) - 25.5 AS d FROM lineitem GROUP BY 1, 2)"""


@query(
    "sustained_break",
    "W15",
    f"""WITH {_MONTHLY_DIFF}, x AS (SELECT *, bool_and(abs(d) > 0.01) OVER (PARTITION BY flag ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM m)
 SELECT flag, {day('coalesce(min(m) FILTER (WHERE rest), min(m) FILTER (WHERE abs(d) > 0.01))')} AS break_month,
 min(m) FILTER (WHERE rest) IS NOT NULL AS sustained FROM x GROUP BY flag""",
)
def sustained_break(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag"))
    monthly = profile.monthly_mean(li, "l_shipdate", ["l_quantity"], ("flag",)).withColumn("d", F.col("l_quantity") - 25.5)
    return profile.sustained_break(monthly, "month", "d", 0.01, ("flag",))


@query(
    "split_share_after_cut",
    "A36",
    f"""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, CASE WHEN l_shipdate <= DATE '1998-12-31' THEN 'train' WHEN l_shipdate <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END AS split FROM lineitem)
 SELECT split, {big('count(*)')} AS n, {day('min(d)')} AS first_day, {day('max(d)')} AS last_day,
 {num("avg(CASE WHEN d >= DATE '2000-06-01' THEN 1 ELSE 0 END)")} AS share_after FROM d GROUP BY split""",
)
def split_share_after_cut(spark, sf):
    from gridhour.operators.align import split_label

    li = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return profile.share_from(li.withColumn("split", split_label(F.col("d"), "1998-12-31", "2000-12-31")), "d", "split", "2000-06-01")


@query(
    "yearly_mean_range",
    "W20",
    f"""SELECT {num('max(v) - min(v)')} AS mean_range FROM (SELECT year(l_shipdate) AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1)""",
)
def yearly_mean_range(spark, sf):
    yearly = profile.yearly_summary(table(spark, sf, "lineitem"), "l_shipdate", ["l_extendedprice"])
    return profile.mean_range(yearly, "l_extendedprice_mean")


# Completeness ---------------------------------------------------------------------------

_DAYS = f"""{s.HOURLY}, span AS (SELECT min({ldate('ts')}) AS a, max({ldate('ts')}) AS z FROM hourly),
 days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
 got AS (SELECT {ldate('ts')} AS d, count(*) AS n_rows, count(*) FILTER (WHERE view IS NOT NULL AND click IS NOT NULL) AS n_complete,
 count(view) AS view, count(click) AS click FROM hourly GROUP BY 1),
 st AS (SELECT d, {day_length('d')} AS n_expected, coalesce(n_rows, 0) AS n_rows, coalesce(n_complete, 0) AS n_complete,
 coalesce(view, 0) AS view, coalesce(click, 0) AS click FROM days LEFT JOIN got USING (d))"""


@query(
    "day_status",
    "Q01",
    f"""WITH {_DAYS} SELECT {day('d')} AS day, {big('n_expected')} AS n_expected, {big('n_rows')} AS n_rows, {big('n_complete')} AS n_complete,
 n_rows >= n_expected AND n_complete >= n_expected AS is_complete FROM st""",
)
def day_status(spark, sf):
    return quality.day_status(s.hourly_by_type(spark, sf), "ts", ["view", "click"])


@query(
    "gaps_by_column",
    "Q03",
    f"""WITH {_DAYS}, l AS (SELECT d, n_expected, 'view' AS column_name, view AS n_filled FROM st UNION ALL SELECT d, n_expected, 'click', click FROM st)
 SELECT {day('d')} AS day, {big('n_expected')} AS n_expected, column_name, {big('n_filled')} AS n_filled, {big('n_expected - n_filled')} AS n_missing
 FROM l WHERE n_expected > n_filled""",
)
def gaps_by_column(spark, sf):
    return quality.gaps_by_column(s.hourly_by_type(spark, sf), "ts", ["view", "click"])


_SERIES_DAYS = f"""got AS (SELECT event_type AS series, {ldate('ts')} AS d, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1, 2),
 span AS (SELECT series, min(d) AS a, max(d) AS z FROM got GROUP BY 1),
 days AS (SELECT series, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span)"""


@query(
    "day_status_by_series",
    "Q01",
    f"""WITH {_SERIES_DAYS} SELECT series, {day('d')} AS day, {day_length('d')} AS n_expected, {big('coalesce(n, 0)')} AS n_rows,
 {big('coalesce(n, 0)')} AS n_complete, coalesce(n, 0) >= {day_length('d')} AS is_complete FROM days LEFT JOIN got USING (series, d)""",
)
def day_status_by_series(spark, sf):
    from gridhour.operators.resample import to_hour

    hourly = to_hour(s.readings(spark, sf), "ts", {"value": "avg"}, ("series",))
    return quality.day_status(hourly, "ts", ["value"], ("series",))


@query(
    "day_status_policy",
    "Q02",
    f"""WITH {_DAYS}, m AS (SELECT d, n_expected, n_rows, greatest(n_expected - view, 0) AS mv, greatest(n_expected - click, 0) AS mc FROM st)
 SELECT {day('d')} AS day, {big('n_expected')} AS n_expected, {big('n_rows')} AS n_rows, {big('mv')} AS missing_critical,
 {big('0')} AS missing_recoverable, {big('mc')} AS missing_sporadic, mv <= 1 AS critical_ok, mv <= 1 AND n_rows >= n_expected AS is_complete FROM m""",
)
def day_status_policy(spark, sf):
    return quality.policy_status(s.hourly_by_type(spark, sf), "ts", ["view", "click"], {"view": 1}, {"click"})


@query(
    "complete_days",
    "A40",
    f"""WITH {s.HOURLY}, c AS (SELECT {ldate('ts')} AS d, count(price) AS n FROM hourly GROUP BY 1)
 SELECT {day('d')} AS day, {big('n')} AS n FROM c WHERE n >= {day_length('d')}""",
)
def complete_days(spark, sf):
    return quality.complete_days(s.hourly_by_type(spark, sf), "ts", "price")


# Coherence ------------------------------------------------------------------------------


@query(
    "coherence_three_sources",
    "Q04 A13",
    f"""WITH {s.HOURLY} SELECT {big('count(*)')} AS n_hours, {big('count(*) FILTER (WHERE abs(view - error) > 10)')} AS n_diff_view,
 {big('count(*) FILTER (WHERE abs(click - error) > 10)')} AS n_diff_click, {num('max(greatest(abs(view - error), abs(click - error)))')} AS max_diff
 FROM hourly WHERE view IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL""",
)
def coherence_three_sources(spark, sf):
    return quality.source_coherence(s.hourly_by_type(spark, sf), "error", ["view", "click"], 10.0)


_PAIRS = f"""{s.HOURLY}, p AS (SELECT ts, coalesce(view, 0) + coalesce(signup, 0) AS winner, coalesce(click, 0) AS loser,
 abs(coalesce(view, 0) + coalesce(signup, 0) - coalesce(click, 0)) AS diff_abs FROM hourly),
 q AS (SELECT quantile_cont(diff_abs, 0.99) AS threshold FROM p), f AS (SELECT p.*, threshold, diff_abs > threshold AS suspect FROM p, q)"""


def _marked(spark, sf):
    h = s.hourly_by_type(spark, sf)
    diff = quality.pair_difference(h, h, ["view", "signup"], ["click"])
    return quality.flag_above_quantile(diff)


@query(
    "pair_control_p99",
    "Q05 A22 A33",
    f"""WITH {_PAIRS} SELECT {big('count(*)')} AS n_hours, {num('max(threshold)')} AS threshold, {big('count(*) FILTER (WHERE suspect)')} AS n_suspect,
 {num('100.0 * count(*) FILTER (WHERE suspect) / count(*)')} AS pct_suspect FROM f""",
)
def pair_control_p99(spark, sf):
    return quality.pair_summary(_marked(spark, sf))


@query(
    "worst_days",
    "A31 O02",
    f"""WITH {_PAIRS}, g AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, avg(diff_abs) AS m, max(diff_abs) AS x FROM f WHERE suspect GROUP BY 1 ORDER BY n DESC, d LIMIT 5)
 SELECT {day('d')} AS day, {big('n')} AS n_suspect, {num('m')} AS diff_mean, {num('x')} AS diff_max FROM g""",
)
def worst_days(spark, sf):
    return quality.worst_days(_marked(spark, sf))


_CONTROL = {"one": ("view", "click"), "two": ("error", "signup")}


@query(
    "control_report",
    "C16 U05 Q05",
    f"WITH {s.HOURLY}, p AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS variable, ts, coalesce({a}, 0) AS winner, coalesce({b}, 0) AS loser, abs(coalesce({a}, 0) - coalesce({b}, 0)) AS diff_abs FROM hourly"
        for n, (a, b) in _CONTROL.items()
    ) + f"""), q AS (SELECT variable, quantile_cont(diff_abs, 0.99) AS threshold FROM p GROUP BY 1)
 SELECT variable, {stamp('ts')} AS ts, {day('ts')} AS day, {num('winner')} AS winner, {num('loser')} AS loser, {num('diff_abs')} AS diff_abs,
 {num('threshold')} AS threshold FROM p JOIN q USING (variable) WHERE diff_abs > threshold""",
)
def control_report(spark, sf):
    from gridhour.plans.reports import control_report as report

    h = s.hourly_by_type(spark, sf)
    return report({"h": h}, {n: ("h", (a,), "h", (b,)) for n, (a, b) in _CONTROL.items()})


@query(
    "column_report",
    "C16 A24 A26 A27 A37",
    f"WITH {s.HOURLY} " + _stack(
        lambda c: f"'hourly' AS table_name, {big('count(*)')} AS n_rows, {big(f'count({c})')} AS n_values, {num(f'min({c})')} AS lo, {num(f'max({c})')} AS hi, "
        f"{big(f'count(*) FILTER (WHERE {c} = 0)')} AS n_zero, {num(f'100.0 * (count(*) - count({c})) / count(*)')} AS pct_null, "
        f"CASE WHEN 100.0 * (count(*) - count({c})) / count(*) <= 5 THEN 'ok' WHEN 100.0 * (count(*) - count({c})) / count(*) <= 20 THEN 'review' ELSE 'alert' END AS level, "
        f"count({c}) = 0 AS is_empty, coalesce(min({c}) = max({c}) AND count({c}) > 100, false) AS is_constant",
        SERIES, "hourly",
    ),
)
def column_report(spark, sf):
    from gridhour.plans.reports import column_report as report

    return report(s.hourly_by_type(spark, sf), SERIES, "hourly")


@query(
    "zone_spread",
    "Q06 O07",
    f"""WITH {s.HOURLY}, l AS (SELECT ts, 'click' AS zone, click AS v, view AS b FROM hourly UNION ALL SELECT ts, 'error', error, view FROM hourly
 UNION ALL SELECT ts, 'signup', signup, view FROM hourly)
 SELECT zone, {big('count(*)')} AS n, {num('corr(v, b)')} AS corr, {num('avg(v - b)')} AS spread_mean, {num('stddev_samp(v - b)')} AS spread_std,
 {num('100.0 * count(*) FILTER (WHERE abs(v - b) > 1) / count(*)')} AS pct_split FROM l WHERE v IS NOT NULL AND b IS NOT NULL GROUP BY zone""",
)
def zone_spread(spark, sf):
    h = s.hourly_by_type(spark, sf)
    long = h.unpivot("ts", ["click", "error", "signup"], "zone", "value")
    return quality.zone_spread(long, h.select("ts", F.col("view").alias("value")), "zone", "ts", "value").orderBy(F.desc("corr"))


@query(
    "revised_after_publication",
    "Q07",
    f"""WITH {s.STORED_FRESH} SELECT {day(ldate('ts'))} AS day, {big('count(*)')} AS n_compared,
 {big('count(*) FILTER (WHERE o.a IS NULL OR abs(o.a - n.a) > 0.5)')} AS n_revised
 FROM stored o JOIN fresh n USING (ts) WHERE n.a IS NOT NULL GROUP BY {day(ldate('ts'))}""",
)
def revised_after_publication(spark, sf):
    stored, fresh = s.stored_and_fresh(spark, sf)
    return quality.revised_after_publication(stored, fresh, "ts", "a")


@query(
    "revision_samples",
    "O04 Q07",
    f"""WITH {s.STORED_FRESH} SELECT {stamp('ts')} AS ts, {num('o.a')} AS old_a, {num('n.a')} AS new_a, true AS diff_a FROM stored o JOIN fresh n USING (ts)
 WHERE n.a IS NOT NULL AND (o.a IS NULL OR abs(o.a - n.a) > 0.5) ORDER BY ts LIMIT 3""",
)
def revision_samples(spark, sf):
    from gridhour.operators.joins import compare_values

    stored, fresh = s.stored_and_fresh(spark, sf)
    return compare_values(stored, fresh, ["ts"], ["a"], 0.5).where("diff_a").orderBy("ts").limit(3)


@query(
    "off_grid_hours",
    "Q08 F23",
    f"""WITH {s.HOURLY} SELECT {big("count(*) FILTER (WHERE extract('hour' FROM ts) % 3 <> 0)")} AS n_off_grid, {big('count(*)')} AS n_rows,
 {num("100.0 * count(*) FILTER (WHERE extract('hour' FROM ts) % 3 <> 0) / count(*)")} AS pct_off_grid FROM hourly""",
)
def off_grid_hours(spark, sf):
    return quality.off_grid_hours(s.hourly_by_type(spark, sf), "ts")


@query(
    "range_overlap",
    "Q09",
    f"""SELECT {day('min(o_orderdate)')} AS a_first, {day('max(o_orderdate)')} AS a_last,
 {day('(SELECT min(l_shipdate) FROM lineitem)')} AS b_first, {day('(SELECT max(l_shipdate) FROM lineitem)')} AS b_last,
 max(o_orderdate) >= (SELECT min(l_shipdate) FROM lineitem) AS overlap FROM orders""",
)
def range_overlap(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    b = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return quality.range_overlap(a, b, "d")


@query(
    "against_reference",
    "Q10",
    f"""WITH y AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1)
 SELECT {big('y')} AS year, {num('v')} AS v, {num('CASE y WHEN 1996 THEN 250000 WHEN 1998 THEN 260000 END')} AS reference,
 {num('CASE y WHEN 1996 THEN 100.0 * (v - 250000) / 250000 WHEN 1998 THEN 100.0 * (v - 260000) / 260000 END')} AS pct_deviation FROM y""",
)
def against_reference(spark, sf):
    yearly = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    return quality.against_reference(yearly, "year", "v", {1996: 250000, 1998: 260000})


_EQ = f"""{s.HOURLY}, p AS (SELECT ts, view, click, error, view - click AS d1, view - (click + error) AS d2 FROM hourly
 WHERE view IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL),
 y AS (SELECT max(m) - min(m) AS r FROM (SELECT month(ts) AS k, avg(d1) AS m FROM p GROUP BY 1)),
 st AS (SELECT median(d2) AS ms, stddev_samp(d2) AS ss, median(d1) AS m1, stddev_samp(d1) AS s1 FROM p)"""


@query(
    "source_equivalence",
    "Q12",
    f"""WITH {_EQ} SELECT {num('ms')} AS median_sum, {num('ss')} AS std_sum, {num('m1')} AS median_one, {num('s1')} AS std_one, {num('r')} AS offset_range,
 CASE WHEN abs(ms) < 50 AND ss < 200 THEN 'equivalent_to_sum' WHEN abs(m1) < 50 AND s1 < 200 THEN 'equivalent_to_one' WHEN r < 150 THEN 'stable_offset' ELSE 'not_equivalent' END AS verdict
 FROM st, y""",
)
def source_equivalence(spark, sf):
    h = s.hourly_by_type(spark, sf).dropna(subset=["view", "click", "error"])
    d = h.withColumn("one", F.col("view") - F.col("click")).withColumn("sum", F.col("view") - (F.col("click") + F.col("error")))
    stats = profile.describe(d, ["one", "sum"], {"p50": 0.5})
    pick = lambda n, c: F.max(F.when(F.col("column_name") == n, F.col(c)))
    offset = profile.mean_range(d.groupBy(F.month("ts").alias("k")).agg(F.avg("one").alias("m")), "m")
    out = stats.agg(
        pick("sum", "p50").alias("median_sum"),
        pick("sum", "std").alias("std_sum"),
        pick("one", "p50").alias("median_one"),
        pick("one", "std").alias("std_one"),
    ).withColumn("offset_range", offset.select("mean_range").scalar())
    verdict = quality.equivalence_verdict(*[F.col(c) for c in ("median_sum", "std_sum", "median_one", "std_one", "offset_range")])
    return out.withColumn("verdict", verdict)


@query(
    "break_verdict",
    "Q13",
    f"""WITH m AS (SELECT l_returnflag AS flag, avg(l_extendedprice - 38000) FILTER (WHERE l_shipdate < DATE '1999-01-01') AS a,
 avg(l_extendedprice - 38000) FILTER (WHERE l_shipdate >= DATE '1999-01-01') AS b FROM lineitem GROUP BY 1)
 SELECT flag, {num('a')} AS mean_before, {num('b - a')} AS jump, coalesce(abs(a) < 150 AND abs(b - a) > 300, false) AS breaks FROM m""",
)
def break_verdict(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("d", F.col("l_extendedprice") - 38000)
    late = F.to_date("l_shipdate") >= F.lit("1999-01-01").cast("date")
    m = d.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.avg(F.when(~late, F.col("d"))).alias("mean_before"), F.avg(F.when(late, F.col("d"))).alias("_after")
    )
    jump = F.col("_after") - F.col("mean_before")
    return m.select("flag", "mean_before", jump.alias("jump"), quality.break_verdict(F.col("mean_before"), jump).alias("breaks"))


@query(
    "additivity_residual",
    "Q14 A09",
    f"""WITH {s.READINGS}, d AS (SELECT CAST(ts AS DATE) AS d, avg(value) FILTER (WHERE series = 'view') AS a, avg(value) FILTER (WHERE series = 'click') AS b,
 avg(value) FILTER (WHERE series = 'error' AND qty > 60) AS c FROM readings GROUP BY 1)
 SELECT {day('d')} AS day, {num('a')} AS a, {num('b')} AS b, {num('c')} AS c, {num('b + coalesce(c, 0)')} AS parts_sum, {num('a - (b + coalesce(c, 0))')} AS residual FROM d""",
)
def additivity_residual(spark, sf):
    r = s.readings(spark, sf)
    cell = lambda c: F.avg(F.when(c, F.col("value")))
    daily = r.groupBy(F.to_date("ts").alias("day")).agg(
        cell(F.col("series") == "view").alias("a"),
        cell(F.col("series") == "click").alias("b"),
        cell((F.col("series") == "error") & (F.col("qty") > 60)).alias("c"),
    )
    return quality.additivity(daily, "a", ["b", "c"], ("c",))


@query(
    "frozen_by_year",
    "Q15",
    f"""SELECT l_linestatus AS status, {big('year(l_shipdate)')} AS year, {big('count(v)')} AS n, {num('min(v)')} AS min, {num('max(v)')} AS max,
 min(v) = max(v) AS frozen FROM (SELECT l_linestatus, l_shipdate, CASE WHEN year(l_shipdate) = 1997 THEN 5.0 ELSE l_quantity END AS v FROM lineitem) x GROUP BY 1, 2""",
)
def frozen_by_year(spark, sf):
    v = F.when(F.year("l_shipdate") == 1997, F.lit(5.0)).otherwise(F.col("l_quantity"))
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), "l_shipdate", v.alias("v"))
    return quality.frozen_years(li, "l_shipdate", "v", ("status",))


@query(
    "snapshot_has_next_day",
    "Q16",
    f"""WITH {s.SNAPSHOTS} SELECT {day('run_date')} AS run_date,
 count(*) FILTER (WHERE target_date = run_date + 1 AND coalesce(nuclear_mw, ccgt_mw) IS NOT NULL) > 0 AS has_next_day FROM snapshots GROUP BY run_date""",
)
def snapshot_has_next_day(spark, sf):
    return quality.has_next_day(s.snapshots(spark, sf), ["nuclear_mw", "ccgt_mw"])


@query(
    "genuine_nulls",
    "Q18",
    f"WITH {s.HOURLY} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {num(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS null_share, "
        f"{num(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) - avg(CASE WHEN error IS NULL THEN 1 ELSE 0 END)')} AS genuine_share FROM hourly"
        for c in ("view", "click")
    ),
)
def genuine_nulls(spark, sf):
    return quality.genuine_nulls(s.hourly_by_type(spark, sf), "error", ["view", "click"])


@query(
    "table_inventory",
    "Q19",
    f"""SELECT 'orders' AS table_name, {big('count(*)')} AS n_rows, CAST(NULL AS VARCHAR) AS superseded_by FROM orders
 UNION ALL SELECT 'customer', {big('count(*)')}, 'orders' FROM customer""",
)
def table_inventory(spark, sf):
    return quality.table_inventory(
        {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")}, {"customer": "orders"}
    )
