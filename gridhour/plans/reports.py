"""Quality reports that put several checks into one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhour import registry as reg
from gridhour.functions.numbers import sum_null_as_zero
from gridhour.operators import joins, profile, quality
from gridhour.operators.resample import union_all


def column_report(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Per column: filled, NULL level, constant value, zeros. One aggregation of the table."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("n_values"),
            F.min(F.col(c).cast("double")).alias("lo"),
            F.max(F.col(c).cast("double")).alias("hi"),
            F.count_if(F.col(c) == 0).alias("n_zero"),
        )
        for c in cols
    ]
    one = df.agg(F.count("*").alias("n_rows"), F.array(*cells).alias("cells"))
    rows = one.select(F.lit(name).alias("table_name"), "n_rows", F.explode("cells").alias("x"))
    out = rows.select("table_name", "n_rows", "x.*")
    pct = F.try_divide(F.lit(100.0) * (F.col("n_rows") - F.col("n_values")), F.col("n_rows"))
    return (
        out.withColumn("pct_null", pct)
        .withColumn("level", F.when(pct <= 5, "ok").when(pct <= 20, "review").otherwise("alert"))
        .withColumn("is_empty", (F.col("n_rows") > 0) & (F.col("n_values") == 0))
        .withColumn("is_constant", F.coalesce((F.col("lo") == F.col("hi")) & (F.col("n_values") > 100), F.lit(False)))
    )


def control_report(tables: dict[str, DataFrame], pairs: dict = reg.CONTROL_PAIRS, prob: float = 0.99) -> DataFrame:
    """Flagged hours of every source pair, labelled by pair; one threshold per pair."""
    return marked_pairs(tables, pairs, prob).where("suspect").drop("suspect")


def control_differences(tables: dict[str, DataFrame], pairs: dict = reg.CONTROL_PAIRS) -> DataFrame:
    """``ts, day, variable, winner, loser, diff_abs`` of all source pairs, tables as they are scanned.

    The time column of a table is that of the registry, else ``ts``. Pairs between the same two
    tables share one join, which carries the row sums of all of them, so each table is read once
    however many pairs it is in.
    """
    between: dict[frozenset, list] = {}
    for name, (kept, kept_cols, other, other_cols) in pairs.items():
        between.setdefault(frozenset((kept, other)), []).append((name, kept, kept_cols, other, other_cols))

    def sums(table: str, group: list) -> DataFrame:
        spec = reg.BRONZE_TABLES.get(table)
        ts = spec.time_col if spec is not None and spec.time_col in tables[table].columns else "ts"
        cells = {f"{name}_{side}": cols for name, *both in group for side, t, cols in (("winner", *both[:2]), ("loser", *both[2:])) if t == table}
        return tables[table].select(F.col(ts).alias("ts"), *[sum_null_as_zero(list(cols)).alias(n) for n, cols in cells.items()])

    frames = []
    for ends, group in between.items():
        sides = [sums(t, group) for t in sorted(ends)]
        both = joins.pair_on_key(*sides, ["ts"]) if len(sides) == 2 else sides[0]
        cells = [F.struct(F.lit(n).alias("variable"), F.col(f"{n}_winner").alias("winner"), F.col(f"{n}_loser").alias("loser")) for n, *_ in group]
        frames.append(both.select("ts", F.explode(F.array(*cells)).alias("x")).select("ts", F.to_date("ts").alias("day"), "x.*"))
    return union_all(frames).withColumn("diff_abs", F.abs(F.col("winner") - F.col("loser")))


def marked_pairs(tables: dict[str, DataFrame], pairs: dict = reg.CONTROL_PAIRS, prob: float = 0.99) -> DataFrame:
    return quality.flag_above_quantile(control_differences(tables, pairs), prob, ("variable",))


def control_summary(marked: DataFrame, n: int = 5) -> DataFrame:
    """Per pair: hours, threshold, flagged hours, and its ``n`` worst days, worst first."""
    days = quality.worst_days(marked, n, ("variable",))
    listed = days.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("place", "day", "n_suspect", "diff_mean", "diff_max"))).alias("worst"))
    return quality.pair_summary(marked, ("variable",)).join(listed, "variable", "left")


def price_report(df: DataFrame, cols: list[str], base: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coverage with means per price column, and coherence of the sources of one zone."""
    return profile.coverage(df, "ts", cols), quality.source_coherence(df, base, others)
