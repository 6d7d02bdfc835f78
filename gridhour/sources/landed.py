"""Landed JSON documents whose fields come and go.

A document is parsed once into a VARIANT and kept. Registered fields become typed columns; fields
that nobody has registered stay with the row, so a later schema can read them from what has landed;
and a document that does not hold is set aside with the reason, never silently dropped or nulled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_documents(raw: DataFrame, text: str, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """``raw`` without ``text``, with ``doc`` (VARIANT), a column per field, ``extra`` and ``reason``.

    ``fields`` are names of top-level fields and their types. ``extra`` holds the other fields as
    ``map<string, variant>``, empty if there are none. ``reason`` is NULL for a document that holds;
    else it is ``malformed``, ``not an object``, ``missing <field>`` for a required field that is
    absent or null, or ``bad <field>`` for a value that does not convert, the first field first.
    """
    kept = [c for c in raw.columns if c != text]
    parsed = raw.withColumn("_doc", F.try_parse_json(text))
    object_ = F.try_variant_get("_doc", "$", "map<string,variant>")
    known = F.array(*[F.lit(f) for f in fields])
    rest = F.map_filter(F.col("_all"), lambda k, _: ~F.array_contains(known, k))
    typed = parsed.withColumn("_all", object_).select(*kept, "_doc", "_all", *[F.try_variant_get("_doc", f"$.{f}", kind).alias(f"_f_{f}") for f, kind in fields.items()])

    def there(f: str) -> Column:
        value = F.element_at("_all", F.lit(f))
        return F.coalesce(value.isNotNull() & ~F.is_variant_null(value), F.lit(False))

    reason = F.when(F.col("_doc").isNull(), "malformed").when(F.col("_all").isNull(), "not an object")
    for f in fields:
        if f in required:
            reason = reason.when(~there(f), f"missing {f}")
        reason = reason.when(there(f) & F.col(f"_f_{f}").isNull(), f"bad {f}")
    return typed.select(*kept, F.col("_doc").alias("doc"), *[F.col(f"_f_{f}").alias(f) for f in fields], rest.alias("extra"), reason.alias("reason"))


def accepted(read: DataFrame) -> DataFrame:
    return read.where(F.col("reason").isNull()).drop("reason")


def rejects(read: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, reason and the document as text, as far as it could be parsed."""
    return read.where(F.col("reason").isNotNull()).select(*keys, "reason", F.to_json("doc").alias("document"))


def extra_fields(read: DataFrame) -> DataFrame:
    """Unregistered fields and the types they come in, with their number of documents."""
    each = read.where(F.col("reason").isNull()).select(F.explode("extra").alias("field", "value"))
    return each.groupBy("field", F.schema_of_variant("value").alias("type")).agg(F.count("*").alias("n"))


def promote(read: DataFrame, field: str, kind: str) -> DataFrame:
    """Read a field that has landed as extra, as a typed column; NULL where it is absent or does not convert."""
    return read.withColumn(field, F.try_variant_get("doc", f"$.{field}", kind))
