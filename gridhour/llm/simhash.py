"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at 4 or fewer differing bits. Such a pair agrees up to 2 bits in the
upper or in the lower half, so within that half some value lies at most 1 bit from both. Each
fingerprint therefore emits, for either half, the values within 1 bit (33), shuffles on them,
and those that meet are verified on all 64 bits: 66 rows a fingerprint instead of the 2,081
of the radius-2 ball on the whole fingerprint, and every link is found.

Where more than ``DENSE`` fingerprints share a value, comparing them would cost more than the
full ball does. They are compared by the full ball instead: two fingerprints that meet there
are at most 2 + 2 bits apart, so each meeting is a link, nothing is verified, and the cost is
linear in the group. A pair that meets only in such crowds has both ends in the full ball, so
no link is lost. Meetings give the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import query, stored, table
from gridhour.llm.graph import components

SHINGLE, RADIUS = 4, 4
#: About where comparing within a group costs as much as its full ball.
DENSE = 8192
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 4-word shingles of a UTF-8 text; no words give 0."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    runs = [tokens[i:] for i in range(SHINGLE)] if len(tokens) >= SHINGLE else [[t] for t in tokens]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*runs)), repeat(42)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, text_hash``: the fingerprint as a signed long, and a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp), b["text_hash"]], names=["doc_id", "fp", "text_hash"])

    return rows.mapInArrow(run, schema)


def _half_keys(fp: Column) -> Column:
    """The 66 half values within one bit, each with its side in bit 32."""
    upper, lower = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    masks = [0, *(1 << i for i in range(32))]
    keys = [half.bitwiseXOR(F.lit(m + side).cast("long")) for half, side in ((upper, 1 << 32), (lower, 0)) for m in masks]
    return F.array(*keys)


def _meet(dense: int):
    """Sorted ``(key, fp)`` rows to forest edges ``(a, b)``; ``b`` is null for a crowd's members."""

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(keys)) - 1
        bits = fps.view(np.uint64)  # counting the bits of a signed number counts those of its amount
        label, at, shift = np.arange(len(keys)), np.flatnonzero(left > 0), 1
        while len(at):
            near = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= RADIUS]
            a, b = label[near], label[near + shift]
            while (differ := a != b).any():
                near, a, b = near[differ], a[differ], b[differ]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[near], label[near + shift]
            shift += 1
            at = at[left[at] >= shift]
        moved = np.flatnonzero(label != np.arange(len(keys)))
        return fps[moved], fps[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, crowd = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in _with_end(batches):
            if b is not None:
                key = np.concatenate([key, b["key"].to_numpy()])
                fp = np.concatenate([fp, b["fp"].to_numpy()])
            # the last key may go on in the next batch
            cut = len(key) if b is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                sizes = np.diff(np.append(np.flatnonzero(np.diff(key[:cut], prepend=key[0] - 1)), cut))
                large = np.repeat(sizes, sizes) > dense
                if crowd is not None:
                    large |= key[:cut] == crowd
                a, to = links(key[:cut][~large], fp[:cut][~large])
                yield _edges(a, to)
                yield _edges(fp[:cut][large], None)
                key, fp = key[cut:], fp[cut:]
            if len(key) > dense:  # one key so far: pass its members on, hold none
                crowd = key[0]
                yield _edges(fp, None)
                key, fp = key[:0], fp[:0]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _edges(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), right], names=["a", "b"])


def link_edges(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` at 4 bits or fewer."""
    keyed = distinct.select(F.explode(_half_keys(F.col("fp"))).alias("key"), "fp")
    met = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(dense), "a long, b long"), "simhash-links")
    edges, crowd = met.where("b is not null").distinct(), met.where("b is null").select(F.col("a").alias("fp")).distinct()
    if met.where("b is null").isEmpty():
        return edges
    masks = [sum(1 << i for i in chosen) for n in range(RADIUS // 2 + 1) for chosen in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = crowd.select("fp", F.explode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: m.bitwiseXOR(F.col("fp")))).alias("key"))
    least = stored(ball.groupBy("key").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "simhash-balls")
    return edges.unionAll(ball.join(least, "key").where("fp <> least").select("fp", "least")).distinct()


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """``doc_id, fp, text_hash, root``: documents of equal ``root`` are linked, near or far.

    A null, empty or blank text has fingerprint 0 and links like any other. Repeated rows and
    equal fingerprints share their root. No rows give no rows; other columns are ignored.
    """
    found = stored(fingerprints(docs, doc_id=doc_id, text=text), "simhash")
    roots = components(link_edges(found.select("fp").distinct(), dense))
    roots = stored(roots.select(F.col("node").alias("fp"), "root"), "simhash-roots")
    return found.join(roots, "fp", "left").select("doc_id", "fp", "text_hash", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``.

    ``component_id`` is the least id that links reach; null ids count only where a group has
    no other.
    """
    groups = stored(near_groups(docs, doc_id=doc_id, text=text, dense=dense), "simhash-groups")
    least = stored(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.join(least, "root").select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the least id stays.

    Null ids come last, equal ids are told apart by the text's hash, and of equal rows one
    stays. All columns are kept as they are.
    """
    groups = near_groups(docs, doc_id=doc_id, text=text)
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("text_hash"))).alias("w")
    copies = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    winners = stored(copies.groupBy("root").agg(chosen).select(F.col("w.doc_id").alias("id_"), F.col("w.text_hash").alias("hash_")), "simhash-winners")
    many = stored(copies.where("n > 1").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct(), "simhash-copies")
    match = lambda side: docs[doc_id].eqNullSafe(side["id_"]) & (F.xxhash64(docs[text]) == side["hash_"])
    kept = docs.join(winners, match(winners), "left_semi")
    on = lambda side: kept[doc_id].eqNullSafe(side["id_"]) & (F.xxhash64(kept[text]) == side["hash_"])
    single, repeated = kept.join(many, on(many), "left_anti"), kept.join(many, on(many), "left_semi")
    return single.unionAll(repeated.dropDuplicates([doc_id, text]))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
