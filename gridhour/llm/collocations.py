"""Phrase collocations by Toivonen's sampling method.

A sample of the documents proposes phrases that may be frequent. One pass over all documents then
counts the proposed phrases and their negative border exactly: phrases that were not proposed
although all their parts were. If no phrase of the border is frequent, no other phrase can be. A
border phrase that is frequent after all extends the proposal, and a further pass counts the new
border only, until a pass finds no such failure.

The border is never listed. Which words and pairs are proposed is kept in bitmaps of a fixed
size, which are all that is broadcast: a pair is counted if both its words are proposed, a triple
if both its pairs are. Two phrases that share a bit cost a count too many, never one too few.

Tasks count on word numbers in numpy, a bounded number of words at a time, so a frequent phrase
is one row a chunk before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import query, stored, table

MIN_COUNT, MAX_WORDS = 10, 3
TOP, SCORE_SCALE = 2000, 1_000_000
#: A phrase goes if a longer one around it has at least this percentage of its count.
SWALLOWED = 50
#: One document in so many is in the sample; there a phrase is proposed from this count on.
SAMPLE, PROPOSED = 8, 2
#: Bits of a bitmap as a power of two: 8 MB each, four in the broadcast, whatever the corpus has.
BITS = 26
#: Words that a task counts at a time, and bytes of a text that it splits at a time.
CHUNK, SLICE = 1 << 22, 1 << 22
#: Shares in which a language's phrases are ranked before they meet.
SHARES = 256
#: Bits of one bitmap row of Spark's ``bitmap_construct_agg``.
ROW_BITS = 1 << 15

SEPARATOR = b"."
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = SEPARATOR[0]
_TABLE = bytes(_TABLE)
COUNTED = "lang binary, size int, phrase binary, key long, n long"


@dataclass
class Proposal:
    """Bitmaps of the proposed words and pairs; none proposes nothing, ``every`` everything."""

    words: np.ndarray | None = None
    pairs: np.ndarray | None = None
    every: bool = False

    def has(self, which: str, keys: np.ndarray) -> np.ndarray:
        if self.every:
            return np.ones(len(keys), dtype=bool)
        bits = getattr(self, which)
        if bits is None:
            return np.zeros(len(keys), dtype=bool)
        at = keys & np.uint64((len(bits) << 3) - 1)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


class _Numbers(dict):
    """Words to numbers as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class _Buffer:
    numbers: _Numbers = field(default_factory=lambda: _Numbers({SEPARATOR: 0}))
    parts: list = field(default_factory=list)


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about ``SLICE`` bytes, cut where pieces end."""
    text = text.translate(_TABLE)
    start = 0
    while len(text) - start > SLICE:
        cut = text.find(SEPARATOR, start + SLICE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each stands there."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[starts], np.diff(np.append(starts, len(sorted_keys)))


def _count(buffer: _Buffer, lang: bytes, now: Proposal, before: Proposal | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that ``now`` asks for and ``before`` did not; words and their sum (as size 0) only if ``before`` is none."""
    text = np.concatenate(buffer.parts)
    words = pa.array(list(buffer.numbers), pa.binary())
    v = len(words)
    keys = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in buffer.numbers), dtype=np.uint64, count=v) ^ np.uint64(xxhash.xxh64_intdigest(lang, 7))

    def batch(size: int, phrase: pa.Array, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.binary()).take(pa.array(np.zeros(k, np.int64))), pa.array(np.full(k, size, np.int32)), phrase, pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
            names=["lang", "size", "phrase", "key", "n"],
        )

    if before is None:
        n = np.bincount(text, minlength=v)[1:]
        if len(n):
            yield batch(1, words[1:], keys[1:], n)
            yield batch(0, pa.array([b""], pa.binary()), np.zeros(1, np.uint64), n.sum(keepdims=True))
    left, right = text[:-1], text[1:]
    inner = (left != 0) & (right != 0)
    known = now.has("words", keys)
    pair = inner & known[left] & known[right]
    at = np.flatnonzero(pair)
    if before is not None:
        old = before.has("words", keys)
        at = at[~(old[left[at]] & old[right[at]])]
    code, n = _runs(np.sort(left[at] * v + right[at]))
    if len(n):
        a, b = code // v, code % v
        yield batch(2, pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), b" "), _pair_keys(keys[a], keys[b]), n)
    if now.every:
        return
    # a triple needs both its pairs
    at = np.flatnonzero(pair)
    pair_key = _pair_keys(keys[left[at]], keys[right[at]])
    flag = np.zeros(len(text), dtype=bool)
    flag[at] = now.has("pairs", pair_key)
    at3 = np.flatnonzero(flag[:-2] & flag[1:-1])
    if before is not None:
        flag[:] = False
        flag[at] = before.has("pairs", pair_key) & old[left[at]] & old[right[at]]
        at3 = at3[~(flag[at3] & flag[at3 + 1])]
    if len(at3):
        head = left[at3] * v + right[at3]
        distinct, _ = _runs(np.sort(head))
        code, n = _runs(np.sort(np.searchsorted(distinct, head) * v + text[at3 + 2]))
        head, c = distinct[code // v], code % v
        phrase = pc.binary_join_element_wise(words.take(pa.array(head // v)), words.take(pa.array(head % v)), words.take(pa.array(c)), b" ")
        yield batch(3, phrase, np.zeros(len(n), np.uint64), n)


def _counter(now: Proposal, before: Proposal | None, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[bytes, _Buffer] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, buffer in buffers.items():
                yield from _count(buffer, lang, now, before)
            buffers.clear()

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                for part in _slices(text.as_py()):
                    if lang not in buffers:
                        buffers[lang] = _Buffer()
                    buffer = buffers[lang]
                    found = part.replace(SEPARATOR, b" . ").split()
                    found.append(SEPARATOR)
                    buffer.parts.append(np.fromiter(map(buffer.numbers.__getitem__, found), dtype=np.int64, count=len(found)))
                    held += len(found)
                    if held >= chunk:
                        yield from flush()
                        held = 0
        yield from flush()

    return run


def count_phrases(docs: DataFrame, now: Proposal, before: Proposal | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """``lang, size, phrase, key, n``: exact counts of the phrases ``now`` asks for beyond ``before``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counter(*sent.value, chunk)(batches)

    # chunks are counted already, so a second count before the shuffle would only fill memory
    found = docs.mapInArrow(run, COUNTED).repartition("lang", "phrase")
    return found.groupBy("lang", "size", "phrase").agg(F.min("key").alias("key"), F.sum("n").alias("n"))


def bitmap(frequent: DataFrame, size: int, bits: int = BITS) -> np.ndarray:
    """The low bits of the keys of phrases of ``size`` words, as one bitmap of ``2 ** bits`` bits (so much reaches the driver)."""
    at = frequent.where(F.col("size") == size).select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("row")).agg(F.bitmap_construct_agg((F.col("at") % ROW_BITS).cast("int")).alias("bits"))
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in rows.collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["row"] * (ROW_BITS >> 3) :][: len(part)] = part
    return out


def _prepared(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.xxhash64(F.col(doc_id).cast("string"), F.xxhash64(text)).alias("h"),
    )


def frequent_phrases(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, sample: int = SAMPLE, bits: int = BITS, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, int]:
    """All phrases of 1 to ``MAX_WORDS`` words that stand ``min_count`` times in a language, its number of words, and the full passes taken.

    The phrases are ``lang, size, phrase, key, n``; the totals ``lang, n``. The sample and the
    bitmap's size decide which passes are needed, never the counts.
    """
    rows = _prepared(docs, doc_id, text, lang)
    chosen = rows.where(F.pmod("h", F.lit(sample)) == 0).drop("h")
    rows = rows.drop("h")
    proposed = stored(count_phrases(chosen, Proposal(every=True), chunk=chunk).where(F.col("n") >= PROPOSED), "phrases-proposed")
    now, before = Proposal(bitmap(proposed, 1, bits), bitmap(proposed, 2, bits)), None
    found, totals, passes = None, None, 0
    while True:
        kept = stored(count_phrases(rows, now, before, chunk=chunk).where((F.col("n") >= min_count) | (F.col("size") == 0)), "phrases-counted")
        passes += 1
        if totals is None:
            totals = kept.where(F.col("size") == 0).select("lang", "n")
        new = kept.where(F.col("size") > 0)
        found = new if found is None else found.unionAll(new)
        more = Proposal(now.words | bitmap(new, 1, bits), now.pairs | bitmap(new, 2, bits))
        if (more.words == now.words).all() and (more.pairs == now.pairs).all():
            return found, totals, passes
        now, before = more, now


def collocations(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, sample: int = SAMPLE, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 or 3 words.

    A phrase's count ``a`` and those of its parts ``l`` and ``r`` are exact; the score is that of
    its lowest cut. Phrases that mostly stand inside a longer one are left out.

    Null texts have no words; a null language is ``und``. Repeated rows count each time, texts
    of any length count whole, equal scores go by count and then by the bytes of the phrase.
    Languages without a phrase, and an empty table, give no rows; other columns are ignored.
    """
    found, totals, _ = frequent_phrases(docs, doc_id=doc_id, text=text, lang=lang, min_count=min_count, sample=sample, bits=bits, chunk=chunk)
    lang_ = F.col("lang").cast("string").alias("lang")
    found, totals = found.select(lang_, "size", F.col("phrase").cast("string").alias("phrase"), "n"), totals.select(lang_, "n")
    phrases = found.where("size > 1").withColumnRenamed("n", "a")
    first, last, head, tail = (F.substring_index("phrase", " ", n) for n in (1, -1, 2, -2))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1, first, last))).otherwise(F.array(cut(1, first, tail), cut(2, head, last)))
    parts = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut"))
    count = lambda name: found.select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(f"{name}_n"))
    parts = parts.select("lang", "phrase", "a", "cut.k", "cut.left", "cut.right").join(count("left"), ["lang", "left"]).join(count("right"), ["lang", "right"])
    a, both = F.col("a").cast("decimal(13,0)"), F.col("left_n").cast("decimal(13,0)") * F.col("right_n").cast("decimal(13,0)")
    parts = parts.withColumn("top", F.lit(SCORE_SCALE).cast("decimal(7,0)") * a * a).withColumn("both", both).withColumn("score", F.expr("top div both"))
    lowest = F.min(F.struct("score", "k", "left_n", "right_n")).alias("w")
    scored = parts.groupBy("lang", "phrase", "a").agg(lowest)
    inside = phrases.where("size = 3").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(F.array(head, tail))).alias("phrase"))
    swallowed = inside.join(phrases.where("size = 2").select("lang", "phrase", "a"), ["lang", "phrase"]).where(100 * F.col("longer") >= SWALLOWED * F.col("a"))
    kept = scored.join(swallowed.select("lang", "phrase").distinct(), ["lang", "phrase"], "left_anti")
    # first within shares, so that no task holds all phrases of a language
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("w.score"), F.desc("a"), F.asc("phrase"))
        kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("w.left_n").alias("l"), F.col("w.right_n").alias("r"), "n", F.col("w.score").alias("score")
    )


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY lang, size, phrase),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS p, n AS a FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, p[1] AS x, array_to_string(p[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM c WHERE size = 3),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.n AS l, y.n AS r,
    (1000000::HUGEINT * cuts.a::HUGEINT * cuts.a::HUGEINT) // (x.n::HUGEINT * y.n::HUGEINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS z FROM s) WHERE z = 1),
gone AS (
  SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c t ON t.lang = b.lang AND t.size = 3 AND b.size = 2
    AND b.phrase IN (t.p[1] || ' ' || t.p[2], t.p[2] || ' ' || t.p[3]) AND 100 * t.a >= 50 * b.a),
r AS (
  SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM low WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = low.lang AND gone.phrase = low.phrase)),
n AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
