"""Hard negatives by angular triangle filtering.

A vector becomes integers, its norm, and its angles to a few reference directions. The angle
between an anchor and a row lies between the difference and the sum of their angles to any
reference, so every reference gives an interval of cosines. The narrowest one times both norms,
widened by more than rounding can shift it, bounds their integer inner product. Only rows whose
interval overlaps the wanted window of scores are scored.

Rows are dealt once into blocks of bounded size; anchors are sent to every block and pass through
it in a stream, so a task holds one block and one batch of anchors. Blocks give their best rows
for each anchor, and these are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import query, stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, OF = 30, 90, 100
LABELS, SHIFT_EVERY, ANCHOR_EVERY = 10, 7, 100
#: References are picked from this many rows of least hash; they decide speed, never results.
SAMPLE, REFERENCES = 1024, 8
#: A block has at most so many rows; tables of few rows have smaller blocks, so that all cores work.
BLOCK, SMALL_BLOCK, FEW = 1 << 17, 1 << 11, 64
#: Pairs of anchors and rows whose bounds are held at a time, 32 MB an array.
CELLS = 1 << 22
#: Stored angles and products of doubles are far more exact than this share of both norms.
ROUNDING = 1e-6
LONG = (1 << 63) - 1
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)


def valid_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, x`` of the rows that take part, equal rows once, shifted labels as asked."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    moved = F.when(F.col("id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    taken = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    taken = taken.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    return taken.withColumn("label", moved).distinct()


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of doubles as rows; shorter ones end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lists)), lengths)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return x


def _integers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``; Python integers where doubles could not tell neighbours apart."""
    if x.size and np.abs(x).max() >= EXACT / SCALE:
        whole = [int(v) * SCALE if abs(v) >= EXACT / SCALE else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
        return np.array(whole, dtype=object).reshape(x.shape)
    return np.floor(x * SCALE)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


def _whole(m: np.ndarray) -> np.ndarray:
    return m if m.dtype == object else np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products: exact in doubles where these hold every partial sum, else in Python integers.

    Products beyond a long count as the nearest long.
    """
    a, b = _same_width(a, b)
    if object in (a.dtype, b.dtype) or a.size and b.size and a.shape[1] * np.abs(a).max() * np.abs(b).max() >= EXACT:
        return np.clip(_whole(a).dot(_whole(b).T), -LONG, LONG).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _norms(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    most = np.abs(q).max(axis=1, initial=0.0)
    return most * np.sqrt(np.square(q / np.where(most > 0, most, 1)[:, None]).sum(axis=1))


def _angles(q: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit references; a vector without a direction is at a right angle to all."""
    unit, references = _same_width(q.astype(np.float64) / np.where(norm > 0, norm, 1)[:, None], references)
    return np.arccos(np.clip(unit @ references.T, -1, 1))


def reference_directions(vectors: DataFrame, sample: int = SAMPLE, references: int = REFERENCES) -> np.ndarray:
    """Unit directions far apart, from the ``sample`` rows of least key (at most that many reach the driver)."""
    rows = [r["x"] for r in vectors.select("key", "x").orderBy("key", "x").limit(sample).collect()]
    q = _integers(_matrix(pa.array(rows, pa.list_(pa.float64()))))
    norm = _norms(q)
    unit = q.astype(np.float64)[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.zeros((0, 0))
    chosen, near = [0], np.abs(unit @ unit[0])
    while len(chosen) < min(references, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, np.abs(unit @ unit[chosen[-1]]))
    return unit[chosen]


def with_angles(vectors: DataFrame, references: np.ndarray) -> DataFrame:
    """Adds ``norm`` and ``angles``, the angle to each reference direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _integers(_matrix(b["x"]))
            norm = _norms(q)
            found = _angles(q, norm, references) if len(references) else np.zeros((len(q), 0))
            offsets = pa.array(np.arange(len(q) + 1) * found.shape[1], pa.int32())
            angles = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm), angles], names=[*b.schema.names, "norm", "angles"])

    return vectors.mapInArrow(run, "id long, label long, x array<double>, key long, norm double, angles array<double>")


def _bounds(a: dict, rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible product of every anchor with every row."""
    low = np.full((len(a["norm"]), len(rows["norm"])), -1.0)
    high = np.ones_like(low)
    for k in range(a["cos"].shape[1]):
        c, s = np.outer(a["cos"][:, k], rows["cos"][:, k]), np.outer(a["sin"][:, k], rows["sin"][:, k])
        np.maximum(low, c - s, out=low)
        np.minimum(high, c + s, out=high)
    size = np.outer(a["norm"], rows["norm"])
    return low * size - ROUNDING * size - 1, high * size + ROUNDING * size + 1


def _unpack(b: pa.RecordBatch) -> dict:
    angles, none = _matrix(b["angles"]), b["id"].is_null().to_numpy(zero_copy_only=False)
    # a row without an id comes after all others
    ids = b["id"].fill_null(LONG).to_numpy()
    return {"q": _integers(_matrix(b["x"])), "norm": b["norm"].to_numpy(), "cos": np.cos(angles), "sin": np.sin(angles), "label": b["label"].to_numpy(), "key": b["key"].to_numpy(), "id": ids, "none": none}


def _top(score: np.ndarray, rows: dict, at: np.ndarray, n: int) -> np.ndarray:
    """Which of the rows ``at`` have the ``n`` highest scores, best first, ties by id."""
    keep = np.arange(len(at))
    if len(at) > n:
        keep = np.flatnonzero(score >= np.partition(score, len(at) - n)[len(at) - n])
    order = np.lexsort((rows["id"][at[keep]], rows["none"][at[keep]], -score[keep]))
    return keep[order[:n]]


def _near_same(a: dict, rows: dict, low: np.ndarray, high: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of the anchor's label: a row whose upper bound is below enough lower bounds is not scored."""
    itself = (rows["key"] == a["key"][i]) & (rows["id"] == a["id"][i])
    at = np.flatnonzero((rows["label"] == a["label"][i]) & ~itself)
    if len(at) > POSITIVES:
        at = at[high[i, at] >= np.partition(low[i, at], len(at) - POSITIVES)[len(at) - POSITIVES]]
    score = _products(a["q"][i : i + 1], rows["q"][at])[0]
    keep = _top(score, rows, at, POSITIVES)
    return at[keep], score[keep]


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a hard negative; empty for a negative score."""
    return -(-LOW * positive // OF), HIGH * positive // OF


def _near_other(a: dict, rows: dict, low: np.ndarray, high: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of other labels for each window of scores; rows whose bounds overlap none are not scored."""
    windows = {w for w in map(window, a["scores"][i]) if w[0] <= w[1]}
    if not windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    overlap = (high[i] >= float(min(w[0] for w in windows))) & (low[i] <= float(max(w[1] for w in windows)))
    at = np.flatnonzero(overlap & (rows["label"] != a["label"][i]))
    score = _products(a["q"][i : i + 1], rows["q"][at])[0]
    found = [np.zeros(0, np.int64)]
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        found.append(inside[_top(score[inside], rows, at[inside], NEGATIVES)])
    keep = np.unique(np.concatenate(found))
    return at[keep], score[keep]


def _meet(choose):
    """Block after block: its rows come first, then the anchors in batches."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for b in batches:
            keys = np.stack([b["block"].to_numpy(), b["anchor"].to_numpy(zero_copy_only=False)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if end > start:
                    yield int(keys[start][0]), bool(keys[start][1]), b.slice(start, end - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = None, [], None
        for number, anchor, part in parts(batches):
            if number != block:
                block, held, rows = number, [], None
            if not anchor:
                held.append(part)
            elif held or rows:
                if rows is None:
                    rows, held = _unpack(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                step = max(1, CELLS // len(rows["id"]))
                for start in range(0, part.num_rows, step):
                    piece = part.slice(start, step)
                    a = _unpack(piece) | {"scores": piece["scores"].to_pylist()}
                    low, high = _bounds(a, rows)
                    out = [choose(a, rows, low, high, i) for i in range(piece.num_rows)]
                    who = pa.array(np.repeat(np.arange(piece.num_rows), [len(x[0]) for x in out]), pa.int64())
                    at = np.concatenate([x[0] for x in out])
                    ids = pa.array(rows["id"][at], pa.int64(), mask=rows["none"][at])
                    yield pa.RecordBatch.from_arrays(
                        [piece["id"].take(who), piece["key"].take(who), ids, pa.array(np.concatenate([x[1] for x in out]), pa.int64())],
                        names=["anchor_id", "anchor_key", "other_id", "score"],
                    )

    return run


def _in_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, choose) -> DataFrame:
    """``anchor_id, anchor_key, other_id, score`` of the rows that ``choose`` takes of each block for each anchor."""
    layout = ["block", "anchor", "id", "label", "x", "key", "norm", "angles", "scores"]
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("long")).withColumn("anchor", F.lit(False)).withColumn("scores", F.lit(None).cast("array<long>"))
    sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("anchor", F.lit(True))
    met = dealt.select(*layout).unionAll(sent.select(*layout)).repartition(blocks, "block").sortWithinPartitions("block", "anchor")
    return met.mapInArrow(_meet(choose), "anchor_id long, anchor_key long, other_id long, score long")


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``ANCHOR_EVERY``. Each has as positives its
    ``POSITIVES`` best other rows of its label, and for each positive the ``NEGATIVES`` best rows of
    other labels whose score is between ``LOW`` and ``HIGH`` percent of the positive's.

    Rows with a null label or vector, or a null or non-finite component, take no part. Rows equal
    in id, label and vector count once; rows that share only the id are different rows, and
    different anchors. A row without an id is no anchor and comes last among equal scores. Vectors
    of other lengths end in zeros, so an empty one scores 0. A product beyond a long counts as the
    nearest long. No rows give no rows; other columns are ignored.
    """
    taken = valid_vectors(rows, vec_id=vec_id, vector=vector, label=label).withColumn("key", F.xxhash64("id", "label", "x"))
    taken = stored(taken, "vectors")
    table_ = stored(with_angles(taken, reference_directions(taken)), "vector-angles")
    n = table_.count()
    blocks = max(1, -(-n // block), min(FEW, -(-n // SMALL_BLOCK)))
    anchors = table_.where(F.col("id") % ANCHOR_EVERY == 0)
    near = _in_blocks(table_, anchors.withColumn("scores", F.lit(None).cast("array<long>")), blocks, _near_same)
    positives = stored(_ranked(near, ["anchor_id", "anchor_key"], POSITIVES), "positives")
    listed = positives.groupBy("anchor_id", "anchor_key").agg(F.collect_list("score").alias("scores"))
    scored = anchors.join(listed, (anchors["id"] == listed["anchor_id"]) & (anchors["key"] == listed["anchor_key"]))
    others = _in_blocks(table_, scored, blocks, _near_other)
    pairs = positives.select("anchor_id", "anchor_key", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    met = others.join(pairs, ["anchor_id", "anchor_key"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    fits = (LOW * wide("positive_score") <= OF * wide("score")) & (OF * wide("score") <= HIGH * wide("positive_score"))
    best = _ranked(met.where(fits), ["anchor_id", "anchor_key", "place"], NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
