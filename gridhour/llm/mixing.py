"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the exponential key ``-ln(u) / quality``; within a source the documents
with the smallest keys are drawn first, which draws in proportion to quality. A source whose
target is larger than its size is first taken whole as often as it fits; the rest of the
target is the prefix of its documents, by key, whose summed size comes nearest to it.

No source is ever sorted as a whole. Prefix sums are taken over bins of the key, then over
sub-bins of the one bin where the target is reached, and only the rows of one sub-bin are
ordered. Bins are equal steps of ``ln(key)``: whatever the quality weights are, the densest
step of 1/64 holds under 0.6 % of its source and a sub-bin under 1 in 700,000.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import count_chars, n_words, query, stored, table

BINS, SUB_BINS = 64, 4096
QUALITY_SYMBOLS = "[#*$%&|<>]"


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Targets of all sources from ``(source, source_size)``, one row for each source.

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all
    sizes. A share above ``cap`` times the source's size is cut to it and the excess goes to
    the others by weight. Sorted by ``cap * size / weight``, the cut sources are a prefix, so
    one running sum finds the level at which the others end.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.lit(cap) * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    cut = F.lit(cap) * F.col("source_size") / F.col("weight") < F.col("level")
    # the first source that is not cut has the highest level of those and fixes it for all
    return (
        ranked.withColumn("level", level)
        .withColumn("cut", cut)
        .withColumn("level", F.max(F.when(~F.col("cut"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("cut"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("level")))
        .drop("weight", "level", "cut")
    )


def _edge(rows: DataFrame, cuts: DataFrame, bin_name: str) -> DataFrame:
    """``cuts`` with the bin in which each source's budget is reached and what is left there."""
    upto = F.sum("in_bin").over(Window.partitionBy("key_of_source").orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("key_of_source", bin_name).agg(F.sum("size").alias("in_bin")).withColumn("upto", upto)
    reached = (F.col("left") > F.col("upto") - F.col("in_bin")) & (F.col("left") <= F.col("upto"))
    kept = [c for c in cuts.columns if c != "left"]
    return sums.join(cuts, "key_of_source").where(reached).select(*kept, bin_name, (F.col("left") - F.col("upto") + F.col("in_bin")).alias("left"))


def mix(
    docs: DataFrame,
    size: Column,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    quality: Column | None = None,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: str = "",
    salt: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Documents with their source's target and what the mix takes of each.

    Returns ``doc_id, source, size, source_size, target, epochs, selected, taken``: ``epochs``
    counts the whole passes over the source, ``selected`` says that the fractional pass draws
    the document, ``taken`` is ``size`` times both. Whole documents are taken, so a source
    misses its target by at most half of one document.

    A null size counts 0; a quality that is null, not a number or not above 0 counts 1e-6. A
    null source is a source. Null and repeated ids are allowed: equal ids draw equal numbers
    and are ordered by size, equal rows are interchangeable. Rows without an id draw by ``salt``, a
    text that tells them apart. Only sizes of texts are used, however long they are. ``carry``
    names columns of ``docs`` that come along as ``carry_<column>``; others are ignored, whatever
    their names. No rows give no rows.
    """
    q = F.lit(1.0) if quality is None else quality.cast("double")
    q = F.when(F.isnan(q) | q.isNull() | (q <= 0), F.lit(1e-6)).otherwise(q)
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.lit("") if salt is None else salt)))), 1, 13), 16, 10)
    drawn = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        (-F.log((digits.cast("double") + 0.5) / F.lit(float(1 << 52))) / q).alias("draw"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    rows = stored(drawn, "mix-rows")
    step = F.log("draw") * BINS
    rows = rows.withColumns(
        {
            "key_of_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "bin": F.floor(step),
            "sub_bin": F.floor((step - F.floor(step)) * SUB_BINS),
        }
    )
    brought = [f"carry_{c}" for c in carry]
    sizes = rows.groupBy("key_of_source", "source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = source_targets(sizes, weights, cap).withColumn("epochs", epochs)
    targets = stored(targets.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    cuts = targets.where("left > 0").select("key_of_source", "left")
    first = stored(_edge(rows, cuts, "bin"), "mix-bins")
    at_edge = rows.join(first.select("key_of_source", "bin"), ["key_of_source", "bin"], "left_semi")
    edges = _edge(at_edge, first, "sub_bin").select("key_of_source", F.col("bin").alias("edge"), F.col("sub_bin").alias("sub_edge"), F.col("left").alias("budget"))
    plan = stored(targets.drop("source", "left").join(edges, "key_of_source", "left"), "mix-plan")

    placed = rows.join(plan, "key_of_source")
    split = (F.col("bin") == F.col("edge")) & (F.col("sub_bin") == F.col("sub_edge"))
    inside = (F.col("bin") < F.col("edge")) | (F.col("bin") == F.col("edge")) & (F.col("sub_bin") < F.col("sub_edge"))
    ahead = Window.partitionBy("key_of_source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(ahead)
    clear = placed.where(~F.coalesce(split, F.lit(False))).withColumn("selected", F.coalesce(inside, F.lit(False)))
    ordered = placed.where(split).withColumn("selected", 2 * upto - F.col("size") <= 2 * F.col("budget"))
    taken = F.col("size") * (F.col("epochs") + F.col("selected").cast("long"))
    return clear.unionByName(ordered).select("doc_id", "source", "size", "source_size", "target", "epochs", "selected", taken.alias("taken"), *brought)


def text_quality(text: Column) -> Column:
    """Share of words among words and symbols: 1 for clean prose, near 0.2 for symbol noise."""
    size = n_words(text)
    symbols = count_chars(F.coalesce(text, F.lit("")), QUALITY_SYMBOLS)
    return F.when(size == 0, F.lit(1.0)).otherwise(size.cast("double") / (size + symbols))


def mix_documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """:func:`mix` of a ``documents`` table by its words and the quality of its texts."""
    salt = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return mix(docs, n_words(F.col("text")), quality=text_quality(F.col("text")), salt=salt, carry=carry)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS salt, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '', 'g')) AS symbols
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || salt)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN size = 0 THEN 1.0 ELSE CAST(size AS DOUBLE) / (size + symbols) END AS draw FROM d),
s AS (SELECT source, sum(size) AS source_size FROM k GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST) AS i FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lv FROM o),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight < lv AS cut FROM l),
t AS (SELECT source, source_size, CASE WHEN cut THEN 3.0::DOUBLE * source_size ELSE weight * max(CASE WHEN NOT cut THEN lv END) OVER () END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query("op1_source_mix", SQL)
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
