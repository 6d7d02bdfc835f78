"""A corpus pipeline: each stage rereads what the one before has written.

Stages: quality rules, line dedup, near-duplicate removal, benchmark decontamination, and
mixing of the sources to their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.llm.common import emptied, stored, table, unused
from gridhour.llm.decontaminate import drop_contaminated
from gridhour.llm.lines import line_dedup
from gridhour.llm.mixing import mix_documents
from gridhour.llm.quality import keep_good
from gridhour.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites (and the length brought up to date)."""
    cleaned, *added = line_dedup(docs)
    cleaned = cleaned.drop(*added)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents with the words that the mix takes of each; a target is that of the source."""
    mixed = mix_documents(docs, carry=docs.columns)
    added = {unused(docs, c): F.col(c) for c in ("size", "source_size", "target", "epochs", "selected", "taken")}
    return mixed.select(*[F.col(f"carry_{c}").alias(c) for c in docs.columns], *[v.alias(n) for n, v in added.items()])


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("source_mix", mix_stage),
]

#: Links of fingerprints reach any number of documents; SQL without recursion cannot follow them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``; of what stages have written only the last is kept.

    Null and repeated ids, repeated rows, null, empty and very long texts, and an empty table pass
    through every stage, as each states for its operator; columns beyond those of documents stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            emptied(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
