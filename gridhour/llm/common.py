"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhour.session import ensure_utc, scratch_path

#: A word is a run of characters other than these six kinds of white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def count_chars(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` lie in a regular-expression class such as ``[0-9]``."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class + "+", ""))


def id_bucket(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id written as text, modulo ``parts``; a null id is the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % parts


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a later loss of an executor rereads the files and does not repeat
    the text pass that made them, and several readers share one computation.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def emptied(*frames: DataFrame) -> None:
    """Free the disk of stored tables whose readers are done: what depends on them must be stored itself."""
    for df in frames:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.stored_at)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` with its SQL twin."""

    def add(build):
        REGISTRY[name] = Query(lambda spark, sf_dir: build(ensure_utc(spark), sf_dir), sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(columns: Iterable[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out
