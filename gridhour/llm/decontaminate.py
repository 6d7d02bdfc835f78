"""Benchmark decontamination by a distributed positional inverted index.

The index stores postings (term, document, position) of the training texts. Each benchmark
window looks up its rarest term, which proposes where the window would have to start; the
postings of its other terms, shifted by their offset in the window, must all agree.

A window can only occur where every two neighbouring words are neighbours in some benchmark
item too. As long as the benchmark's words fit the stated bound, the set of its word pairs is
sent to the tasks and postings outside such runs are not stored, which leaves little more
than the contaminated passages. A larger benchmark is joined instead: every posting of its
terms is stored, and the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import query, stored, table

WINDOW = 10
#: Most benchmark words whose pairs are sent to the tasks: about 200 MB in each.
MAX_SENT_WORDS = 1_000_000
# A byte of a word lower-cased, every other byte a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters (lower-cased) and non-ASCII."""
    return (text or b"").translate(FOLD).split()


def _spans(n: int, window: int) -> list[tuple[int, int]]:
    return [(i, i + window) for i in range(n - window + 1)] if n >= window else [(0, n)] if n else []


def windows(items: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, win, size, offset, term``: the words of all windows, equal windows once.

    ``win`` is a 128-bit hash of the window's words; an item with several equal windows, or
    several items with one window, share it.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))
    fields = [rows.schema["item_id"], T.StructField("words", T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b["item_id"], b["text"], strict=True):
                words = [w.decode() for w in tokens(t.as_py())]
                for lo, hi in _spans(len(words), window):
                    ids.append(i.as_py())
                    found.append(words[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b["item_id"].type), pa.array(found, pa.list_(pa.string()))], names=["item_id", "words"])

    found = rows.mapInArrow(run, T.StructType(fields))
    return found.select("item_id", F.md5(F.array_join("words", " ")).alias("win"), F.size("words").alias("size"), "words").distinct()


def _neighbours(items: DataFrame, text: str) -> tuple[set[bytes], set[tuple[bytes, bytes]]] | None:
    """The benchmark's words and word pairs, or nothing if it is beyond the bound."""
    words = F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    if (items.agg(F.sum(words)).first()[0] or 0) > MAX_SENT_WORDS:
        return None
    terms: set[bytes] = set()
    pairs: set[tuple[bytes, bytes]] = set()
    for (t,) in items.select(F.col(text).cast("string").cast("binary")).distinct().toLocalIterator():
        words = tokens(t)
        terms.update(words)
        pairs.update(zip(words, words[1:]))
    return terms, pairs


def index(docs: DataFrame, vocabulary: DataFrame, near: tuple | None, shortest: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, n_words, terms, positions``: each text's postings, one row a document.

    With ``near`` only runs of at least ``shortest`` words whose neighbours are benchmark
    neighbours are kept, otherwise all words; postings of terms outside ``vocabulary`` are
    dropped when the postings are read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            rows.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(near)

    def kept(words: list[bytes]) -> np.ndarray:
        if sent.value is None or not words:
            return np.arange(len(words))
        terms, pairs = sent.value
        known = np.fromiter((w in terms for w in words), bool, len(words))
        joined = np.fromiter(map(pairs.__contains__, zip(words, words[1:])), bool, len(words) - 1)
        starts = np.append(True, ~joined)
        run = np.cumsum(starts) - 1
        long = np.bincount(run) >= shortest
        return np.flatnonzero(long[run] & known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, terms, positions = [], [], []
            for t in b["text"]:
                words = tokens(t.as_py())
                at = kept(words)
                sizes.append(len(words))
                terms.append([words[i].decode() for i in at])
                positions.append(at)
            yield pa.RecordBatch.from_arrays(
                [b["row"], b["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(positions, pa.list_(pa.int32()))],
                schema=pa.schema([("row", pa.int64()), ("doc_id", b["doc_id"].type), ("n_words", pa.int64()), ("terms", pa.list_(pa.string())), ("positions", pa.list_(pa.int32()))]),
            )

    return rows.mapInArrow(run, schema)


def postings(indexed: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``row, term, pos`` of an index, of the terms of ``vocabulary`` only if one is given."""
    flat = indexed.select("row", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos"))
    return flat if vocabulary is None else flat.join(vocabulary, "term", "left_semi")


def phrase_matches(posted: DataFrame, wins: DataFrame, slop: int = 0) -> DataFrame:
    """``win, size, row, start`` of the windows found in the postings.

    The rarest term of each window (the one with the fewest postings; windows with a term
    that has none cannot match) proposes starts. With ``slop`` 0 every term must stand at its
    exact offset: an exact phrase match. With a larger one each term may stand up to ``slop``
    words before or after its place: a proximity match.
    """
    words = wins.select("win", "size", "words").distinct().select("win", "size", F.posexplode("words").alias("offset", "term"))
    counts = stored(posted.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "index-counts")
    ranked = words.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("win", "size").agg(F.min(F.struct("n", "offset", "term")).alias("r")).where("r.n > 0")
    rarest = stored(rarest.select("win", "size", F.col("r.offset").alias("offset"), F.col("r.term").alias("term")), "index-rarest")
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    # the rarest term itself may be displaced, even to before the window's place or the text's start
    proposed = posted.join(rarest, "term").select("win", "size", "row", "pos", "offset", shifts.alias("shift"))
    proposed = proposed.select("win", "size", "row", (F.col("pos") - F.col("offset") - F.col("shift")).alias("start")).where("start >= 0" if not slop else f"start >= -{slop}")
    proposed = stored(proposed.distinct(), "index-starts")
    words = stored(words, "index-words")
    wanted = proposed.join(words.select("win", "offset", "term"), "win")
    wanted = wanted.select("win", "size", "row", "start", "offset", "term", shifts.alias("shift")).withColumn("pos", F.col("start") + F.col("offset") + F.col("shift"))
    agreed = wanted.join(posted, ["row", "pos", "term"]).groupBy("win", "size", "row", "start").agg(F.countDistinct("offset").alias("n") if slop else F.count(F.lit(1)).alias("n"))
    return agreed.where("n = size").select("win", "size", "row", "start")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW):
    """The index of ``docs`` (its rows name the documents), the windows, and exact matches."""
    wins = stored(windows(items, item_id=item_id, text=item_text, window=window), "index-windows")
    shortest = wins.agg(F.min("size")).first()[0] or 1
    vocabulary = wins.select(F.explode("words").alias("term")).distinct()
    near = _neighbours(items, item_text)
    indexed = stored(index(docs, vocabulary, near, shortest, doc_id=doc_id, text=text), "index")
    posted = stored(postings(indexed, None if near is not None else vocabulary), "index-postings")
    return indexed, wins, stored(phrase_matches(posted, wins), "index-matches")


def contamination(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, contaminated``, one row for each row of ``docs``.

    A document word inside any occurrence of a window is hit; ``item_ids`` are the items with
    an occurring window, as strings in string order. A null text has no words, and neither
    does a null item; an item shorter than a window is one window. Null item ids are listed
    nowhere but their words count. Repeated rows count each; an empty benchmark hits nothing.
    """
    indexed, wins, found = search(docs, items, **names)
    spots = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    hits = spots.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = found.select("row", "win").distinct().join(wins.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "win")
    named = pairs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    both = stored(hits.join(named, "row", "left"), "index-hits")
    rows = indexed.select("row", "doc_id", "n_words").join(both, "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, slop: int, *, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, start`` of windows whose words all stand within ``slop`` of their place.

    ``start`` is where the window's first word would have its exact place, which may lie up to
    ``slop`` before the text. All postings of the windows' words are stored for this, while
    :func:`search` stores only those that can be part of an exact match.
    """
    wins = stored(windows(items, window=window), "index-windows")
    vocabulary = wins.select(F.explode("words").alias("term")).distinct()
    indexed = stored(index(docs, vocabulary, None, 1), "index")
    found = phrase_matches(stored(postings(indexed, vocabulary), "index-postings"), wins, slop)
    named = found.join(wins.select("win", "item_id").distinct(), "win").join(indexed.select("row", "doc_id"), "row")
    return named.select("doc_id", "item_id", "start").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns as they are."""
    keyed = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id"), F.col(text).alias("text"))
    indexed, _, found = search(keyed, items, item_id=item_id, item_text=item_text)
    ids = indexed.join(found.select("row").distinct(), "row", "left_semi").select("doc_id.*").distinct()
    hit = stored(ids.select(F.col("id").alias("id_"), F.col("hash").alias("hash_")), "index-hit-ids")
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["id_"]) & (F.xxhash64(docs[text]) == hit["hash_"]), "left_anti")


SQL = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
m AS (SELECT g.doc_id, g.i, g.size, win.item_id FROM g JOIN win USING (win, size)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM m) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op7_benchmark_decontamination", SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")
