"""Bronze: column-pruned extraction and the union on a local-time calendar."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.operators import calendar, joins
from gridhour.operators.resample import union_all
from gridhour.sources import tables as src

log = logging.getLogger(__name__)


def normalized(tables: dict[str, DataFrame], specs: dict[str, reg.TableSpec] = reg.BRONZE_TABLES) -> dict[str, DataFrame]:
    """Registered tables with their registered columns and a common time key."""
    out = {}
    for name, spec in specs.items():
        if name not in tables:
            log.warning("table %s is missing and is left out of the union", name)
            continue
        out[name] = src.normalize_time(tables[name].select(spec.time_col, *spec.columns), spec)
    return out


def extract_bronze(spark: SparkSession, root: str, out: str, names: list[str] | None = None) -> list[str]:
    """Write each registered table in normalised form; tables can be refreshed one by one."""
    done = []
    for name in names or list(reg.BRONZE_TABLES):
        spec = reg.BRONZE_TABLES[name]
        df = src.normalize_time(src.scan(spark, f"{root}/{name}", spec.time_col, spec.columns), spec)
        df.write.mode("overwrite").parquet(f"{out}/{name}_raw")
        done.append(name)
    return done


def add_derived(df: DataFrame, specs: tuple[reg.DerivedSpec, ...] = reg.BRONZE_DERIVED) -> DataFrame:
    """Derived columns whose inputs are there; the others are skipped with a warning."""
    new = {}
    for spec in specs:
        if set(spec.inputs) <= set(df.columns):
            new[spec.name] = spec.column()
        else:
            log.warning("derived column %s skipped: inputs missing", spec.name)
    return df.withColumns(new) if new else df


def bronze_union(
    tables: dict[str, DataFrame],
    bounds: DataFrame | None = None,
    specs: dict[str, reg.TableSpec] = reg.BRONZE_TABLES,
    derived: tuple[reg.DerivedSpec, ...] = reg.BRONZE_DERIVED,
    anchor: str = reg.ANCHOR_TABLE,
    cal: DataFrame | None = None,
) -> DataFrame:
    """All normalised tables on one hourly calendar; nothing is filled in.

    The calendar follows ``bounds`` or else the span of the anchor table, never the
    accident of which other tables exist. ``cal`` is a calendar that is stored already: where it
    and the hourly tables share buckets of the instant, they join without a shuffle.
    """
    if cal is None:
        if anchor not in tables:
            raise ValueError(f"the calendar needs the anchor table {anchor}")
        cal = calendar.hourly_calendar(calendar.hour_bounds(tables[anchor], "ts_utc") if bounds is None else bounds)
    return add_derived(joins.join_grains(cal, [(specs[n].grain, df) for n, df in tables.items()]), derived)


def bronze_concat(tables: dict[str, DataFrame]) -> DataFrame:
    """Heterogeneous union with the table name in ``source_df``; absent columns are NULL."""
    return union_all([src.tag_source(df, name) for name, df in tables.items()])


def clean_generation(entsoe: DataFrame, esios: DataFrame, ts: str = "datetime") -> DataFrame:
    """Clean generation table from its two sources on their common hours."""
    from gridhour.functions import energy

    a = entsoe.select(
        ts, "solar_mw", "hydro_reservoir_mw", "pumping_gen_mw",
        *[F.col(c).alias(o) for o, (s, c) in reg.GENERATION_OUTPUT.items() if s == "entsoe"],
    )
    b = esios.select(ts, *[F.col(c).alias(o) for o, (s, c) in reg.GENERATION_OUTPUT.items() if s == "esios"])
    return joins.pair_on_key(a, b, [ts]).select(
        ts,
        energy.clean_pv(F.col("solar_mw"), F.col("ree_gsolter")).alias("c_gsolar"),
        energy.dispatchable_hydro(F.col("hydro_reservoir_mw"), F.col("pumping_gen_mw")).alias("c_ghydrodispatch"),
        *list(reg.GENERATION_OUTPUT),
    )


def generation_refresh(entsoe: DataFrame, esios: DataFrame, stored: DataFrame, days: int = 7, ts: str = "datetime") -> DataFrame:
    """Derived generation table after refreshing its most recent days.

    Both sources and the stored table are cut to those days before they meet; older rows pass by
    without a join.
    """
    from gridhour.operators import merge

    bound = stored.agg((F.max(ts) - F.make_dt_interval(F.lit(days))).alias("b")).scalar()
    recent = [joins.newer_than_window(df, stored, ts, days) for df in (entsoe, esios)]
    newer = F.coalesce(F.col(ts) > bound, F.lit(False))
    fresh = merge.merge_frames(stored.where(newer), clean_generation(*recent, ts), [ts], merge.UPSERT)
    return stored.where(~newer).unionByName(fresh)
