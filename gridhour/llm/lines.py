"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate and stays in one place only: the document
with the least id that has it. How many sites a line has is first estimated by HyperLogLog
sketches, which merge inside map tasks, so a line on a third of all documents costs one
sketch a task. Only where the estimate is too near the threshold to trust are the line's
sites counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.llm.common import query, stored, table

MIN_SITES = 5
#: Registers as a power of two; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this many standard errors of the threshold are counted exactly.
ERRORS = 5


def _keyed(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """Ids, site, text and two hashes of id and text that stand for the row."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.xxhash64(doc_id, text).alias("k1"),
        F.xxhash64(text, F.lit("row"), doc_id).alias("k2"),
    )


def _lines(keyed: DataFrame) -> DataFrame:
    """A row for each line with a word, under a 128-bit hash of the line."""
    split = keyed.select("doc_id", "site", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    split = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return split.select("doc_id", "site", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``h1, h2, home``: lines on ``min_sites`` sites or more and the document that keeps them."""
    band = ERRORS * 1.04 / 2 ** (lg_k / 2) * min_sites + 0.5
    home = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("home")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), home)
    spread = stored(spread.where(F.col("sites") > min_sites - band), "line-spread")
    sure = spread.where(F.col("sites") >= min_sites + band)
    near = spread.where(F.col("sites") < min_sites + band)
    sites = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return stored(sure.unionAll(near.join(exact, ["h1", "h2"], "left_semi")).select("h1", "h2", F.col("home.id").alias("home")), "line-boilerplate")


def line_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> tuple[DataFrame, str, str]:
    """``docs`` with boilerplate lines removed from ``text``, and the names of two added counts.

    Lines are the ``\\n``-separated parts, compared exactly; lines without a word are neither
    counted nor removed. The added columns hold the lines with a word and those removed.

    A null text stays null and has no lines. A null site is a site. A null id comes last when
    the keeping document is chosen. Rows equal in id and text keep the same lines, and lines
    repeated within the keeping document all stay. All other columns pass through; no rows
    give no rows. Every row stays, even one of which no line is left.
    """
    keyed = _keyed(docs, doc_id, text, source)
    lines = _lines(keyed)
    gone = lines.join(boilerplate(lines, min_sites, lg_k), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("home")))
    gone = stored(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")), "line-removed")
    n_lines, n_removed = _name(docs, "n_lines"), _name(docs, "n_removed")
    rows = docs.join(gone, (F.xxhash64(docs[doc_id], docs[text]) == gone["k1"]) & (F.xxhash64(docs[text], F.lit("row"), docs[doc_id]) == gone["k2"]), "left")
    parts = F.split(docs[text], "\n")
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone["gone"], i)), "\n")
    worded = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (
        rows.select(
            *[F.when(gone["gone"].isNull(), docs[c]).otherwise(left).alias(c) if c == text else docs[c] for c in docs.columns],
            F.when(docs[text].isNull(), F.lit(0)).otherwise(worded).cast("long").alias(n_lines),
            F.coalesce(F.when(gone["gone"].isNotNull(), F.size(gone["gone"])), F.lit(0)).cast("long").alias(n_removed),
        ),
        n_lines,
        n_removed,
    )


def _name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns} | {"k1", "k2", "gone"}
    while name in taken:
        name += "_"
    return name


SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT line, min(doc_id) AS home FROM w GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
c AS (
  SELECT w.doc_id, count(*) AS n_lines, count(b.line) FILTER (WHERE w.doc_id <> b.home) AS n_removed
  FROM w LEFT JOIN b ON w.line = b.line GROUP BY w.doc_id),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept
  FROM l LEFT JOIN b ON l.line = b.line WHERE b.line IS NULL OR l.doc_id = b.home GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


@query("op10_line_spread_dedup", SQL)
def op10_line_spread_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, n_lines, n_removed = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
