"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is counted as terms of three kinds: its lower-cased words and its letter trigrams, both
hashed, and its shape: three-letter patterns of character classes, and whether its words repeat.
Term counts are weighted by tf-idf within their kind and projected on the leading singular directions
of a bounded sample of labelled texts. The sample's vectors go to every task; each batch of
documents is multiplied with all of them, exactly, in one blocked product, and the labels of
the nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import id_bucket, query, table

#: Labelled rows that the model is fitted on at most: the broadcast is SAMPLE x DIMENSIONS.
SAMPLE, DIMENSIONS, NEIGHBOURS = 2000, 48, 25
CUT = 0.7
# Class of each byte: letters by case, digits, spaces, line ends, stops and other marks apart.
_MARKS = {ord(c): 5 + i for i, c in enumerate(".,!?|#&")}
CLASS = np.array(
    [1 if 65 <= c <= 90 else 0 if 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else 4 if c == 10 else 3 if c <= 32 else _MARKS.get(c, 12 if c in b"$%*" else 13) for c in range(256)],
    dtype=np.int64,
)
BASE = 14
SHAPES = BASE**3 + 3
WORDS, LETTERS = 8192, 2048
TERMS = SHAPES + WORDS + LETTERS
#: Where each kind of terms lies: shapes have part 1 in a text's vector, words and letters one of PARTS.
KINDS = [(0, SHAPES), (SHAPES, SHAPES + WORDS), (SHAPES + WORDS, TERMS)]
PARTS = (0.2, 0.3, 0.5, 1.0)


def term_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Term ids of a UTF-8 text and how often each occurs."""
    shape = CLASS[np.frombuffer(text or b"", np.uint8)]
    grams = np.bincount(shape[:-2] * BASE * BASE + shape[1:-1] * BASE + shape[2:], minlength=SHAPES) if len(shape) > 2 else np.zeros(SHAPES, np.int64)
    words = (text or b"").split()
    same = sum(map(bytes.__eq__, words, words[1:]))
    grams[BASE**3 :] = same, len(words) - len(set(words)) - same if words else 0, len(set(words))
    lower = (text or b"").decode(errors="replace").lower().encode()
    said = np.zeros(WORDS, np.int64)
    for w, n in Counter(lower.split()).items():
        said[zlib.crc32(w.strip(b".,;:!?\"'()")) % WORDS] += n
    b = np.frombuffer(lower, np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    inside = letter[:-2] & letter[1:-1] & letter[2:]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21)
    counts = np.concatenate([grams, said, np.bincount(mixed[inside], minlength=LETTERS)])
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Idf of the terms, projection, unit vectors and labels of the sample, and their mean."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    part: float = PARTS[0]

    def project(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(_weigh(counts, self.idf, self.part) @ self.axes)

    def vote(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the prior where none is near."""
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        cosine = vectors @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** 8
        whole = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.where(whole > 0, whole, 1)
        return np.clip(np.where(whole > 1e-9, share, self.prior), 0.0, 1.0)


def _weigh(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, part: float) -> np.ndarray:
    out = np.zeros((len(counts), TERMS), np.float32)
    for row, (at, n) in zip(out, counts, strict=True):
        row[at] = np.sqrt(n) * idf[at]
        for kind, (low, high) in enumerate(KINDS):
            row[low:high] *= (part if kind else 1.0) / max(float(np.linalg.norm(row[low:high])), 1e-12)
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their id.

    ``docs`` has ``doc_id, text`` and ``labels`` has ``doc_id, label``. Null ids and labels
    are not learned from; of several labels of one id the least counts.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(chosen, "doc_id")
    schema = "doc_id string, label double, at array<int>, n array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [term_counts(t.as_py()) for t in b["text"]]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], *columns], names=["doc_id", "label", "at", "n"])

    # of several texts of one id the one of least hash counts, so that reruns agree
    once = joined.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    rows = once.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("double").alias("label"), F.coalesce("text", F.lit(b"")).alias("text")).mapInArrow(count, schema)
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["label"], r["at"], r["n"]))
    counts = [(np.array(r["at"], np.int64), np.array(r["n"], np.int64)) for r in rows]
    found = np.array([r["label"] for r in rows])
    if not rows:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), found, 0.5)
    return build(counts, found, best_part(counts, found, dimensions), dimensions)


def build(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, part: float, dimensions: int = DIMENSIONS) -> Model:
    """Latent-semantic vectors of labelled texts: tf-idf projected on its leading axes."""
    df = np.bincount(np.concatenate([at for at, _ in counts]), minlength=TERMS)
    idf = np.log((1 + len(counts)) / (1 + df)) + 1
    x = _weigh(counts, idf, part)
    values, left = np.linalg.eigh(x @ x.T)
    lead = np.argsort(-values)[: min(dimensions, len(counts))]
    axes = x.T @ (left[:, lead] / np.sqrt(np.maximum(values[lead], 1e-9)))
    model = Model(idf.astype(np.float32), axes.astype(np.float32), np.zeros((0, 1)), labels, float(labels.mean()), part)
    model.vectors = model.project(counts)
    return model


def best_part(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int) -> float:
    """The part of words and letters in a vector that predicts a third of the learning rows best from the others.

    Ties go to the first of ``PARTS``; rows outside the learning set have no say.
    """
    told = np.arange(len(counts)) % 3 > 0
    if not told.any() or told.all():
        return PARTS[0]
    of = lambda mask: [c for c, m in zip(counts, mask, strict=True) if m]
    errors = []
    for part in PARTS:
        model = build(of(told), labels[told], part, dimensions)
        guess = model.vote(model.project(of(~told)))
        errors.append((round(float(np.square(guess - labels[~told]).mean()), 9), -len(errors)))
    return PARTS[-min(errors)[1]]


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for each row: 0 to 1, higher where label 1 is likelier.

    Texts of any length are read whole. A null, empty or very short text has no terms and gets the sample's mean label. Repeated
    rows get equal scores; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(**sent.value)
        for b in batches:
            out = []
            for i in range(0, len(b), 256):
                counts = [term_counts(t.as_py()) for t in b["text"][i : i + 256]]
                out.append(fitted.vote(fitted.project(counts)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, schema)


@query("op8_knn_quality")
def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(id_bucket(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    found = score(docs, fit(docs.select("doc_id", "text"), learned))
    held = id_bucket(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
