"""Document fingerprints by spot signatures.

A spot is a very common word; its signature is the chain of the next content words after it. The
set of a text's signatures ignores menus, lists and numbers, which have few common words, and a
change of one word touches few chains. Two sets are as alike as their Jaccard coefficient.

Near-duplicates are found without comparing everything. Sets are partitioned by their size: sets
whose sizes differ by more than the threshold allows cannot be alike, so a set meets its own and
the next partition only. Within these, sets meet on the rarest signatures they hold, as few as the
threshold needs, and a pair is dropped as soon as its sizes and the positions of the shared
signature bound it below the threshold. What is left is compared exactly.

Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import query, stored, table

# The commonest function words, by language.
ANCHORS = {
    "en": "the a an of and to in is was that for with as on by be are it this from or at not were",
    "de": "der die das und von den zu ist im ein eine nicht mit auf des dem sich für auch als",
    "fr": "le la les de des du et un une est dans que qui pour pas sur au en il ne",
    "es": "el los las y del que en un una es por con para se no su al lo como más",
    "it": "il di che e la per non un con sono gli dei nel della",
    "pt": "o os da do não uma em para com mais dos das ao",
    "nl": "het een van en dat niet op te zijn voor met",
    "ru": "и в не на что с по это как из у за к от",
}
SPOTS = sorted({w for listed in ANCHORS.values() for w in listed.split()})
#: Scripts without spaces. In a text of two bytes a character or more each of these characters is a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
#: Content words in a chain.
CHAIN = 2
THRESHOLD = 0.8
#: Signatures are shown as so many hexadecimal digits, hence have four times as many bits.
DIGITS = 12
#: Documents that one task puts in order, and at most how many parts there are.
PART, PARTS, NONE_PARTS = 1 << 11, 1 << 16, 1 << 10


def tokens(text: Column) -> Column:
    """Lower-case words of letters, marks and digits, in order; a text without any has one empty word."""
    lower = F.lower(text)
    wide = F.octet_length(text) >= 2 * F.length(text)
    spaced = F.when(wide, F.regexp_replace(lower, UNSPACED, " $0 ")).otherwise(lower)
    return F.split(F.trim(F.regexp_replace(spaced, BETWEEN, " ")), " ")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, as longs of ``4 * DIGITS`` bits.

    A text without a complete chain takes each of its words as a spot; one of too few words for
    that has a single signature of all its words, and one without words that of its characters,
    so that only equal sequences are alike. A null text is an empty one. The work grows with the
    number of words, however long the text.
    """
    text = F.coalesce(text, F.lit(""))
    mark = lambda *of: F.shiftrightunsigned(F.xxhash64(*of), 64 - 4 * DIGITS)
    # one-element arrays bind an intermediate result once for the lambdas that use it often
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    spot = lambda w: w.isin(SPOTS)

    def chains(r: Column) -> Column:
        # the words before the j-th spot, at i, are j spots and i - j content words
        last = F.size(r["c"]) - chain
        found = F.transform(r["at"], lambda i, j: F.when(i - j <= last, mark(F.get(r["t"], i), *[F.get(r["c"], i - j + k) for k in range(chain)])))
        return F.struct(r["t"].alias("t"), F.array_compact(found).alias("s"))

    def parts(t: Column) -> Column:
        at = F.filter(F.transform(t, lambda w, i: F.when(spot(w), i)), lambda i: i.isNotNull())
        return F.struct(t.alias("t"), at.alias("at"), F.filter(t, lambda w: ~spot(w)).alias("c"))

    every = lambda t: F.array_compact(F.transform(t, lambda w, i: F.when(i + chain < F.size(t), mark(w, *[F.get(t, i + k) for k in range(1, chain + 1)]))))
    whole = lambda t: F.array(mark(F.lit("all"), t, F.when(F.get(t, F.lit(0)) == "", text)))
    pick = lambda r: F.when(F.size(r["s"]) > 0, r["s"]).when(F.size(r["t"]) > chain, every(r["t"])).otherwise(whole(r["t"]))
    return F.array_sort(F.array_distinct(once(once(once(tokens(text), parts), chains), pick)))


def fingerprint(found: Column) -> Column:
    """A set of signatures as text, ``DIGITS`` hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda s: F.lower(F.lpad(F.hex(s), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets of signatures, 0 to 1; sets are never empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


# ---- near-duplicates


def size_part(size: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of a set's size: alike sets lie in one partition or in neighbours."""
    return F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def _needed(size: Column, threshold: float) -> Column:
    """How many of its rarest signatures a set shows: two alike sets share one of these."""
    return size - F.ceil(size * threshold - 1e-9).cast("int") + 1


def near_pairs(sets: DataFrame, *, key: str = "key", spots: str = "spots", threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, likeness`` of all pairs ``a < b`` of different sets that are ``threshold`` alike or more.

    ``key`` is unique. Give each set once: copies of a set would pair with one another. No sets
    give no rows; other columns are ignored.
    """
    sets = sets.select(F.col(key).alias("key"), F.col(spots).alias("spots"))
    shown = sets.select("key", F.size("spots").alias("size"), F.explode("spots").alias("spot"))
    rarity = stored(shown.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spot-counts")
    ranked = shown.join(rarity, "spot", "left").groupBy("key", "size").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "spot"))).alias("by")
    )
    # a signature that no other set has leads to no pair
    rows = ranked.select("key", "size", size_part(F.col("size"), threshold).alias("part"), F.posexplode(F.slice("by", F.lit(1), _needed(F.col("size"), threshold))).alias("pos", "s"))
    rows = stored(rows.where("s.n > 1").select("key", "size", "part", "pos", F.col("s.spot").alias("spot")), "spot-index")
    right = rows.select(F.col("key").alias("other"), F.col("size").alias("size2"), F.col("pos").alias("pos2"), "spot", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    met = rows.join(right, ["spot", "part"]).where("size < size2 OR size = size2 AND key < other")
    # at most the signatures from the shared one on can be shared
    least = F.ceil(threshold / (1 + threshold) * (F.col("size") + F.col("size2")) - 1e-9)
    bound = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
    met = met.where((F.col("size") >= threshold * F.col("size2") - 1e-9) & (bound >= least)).select("key", "other").distinct()
    left = met.join(sets, "key").withColumnRenamed("spots", "spots1")
    both = left.join(sets.select(F.col("key").alias("other"), F.col("spots").alias("spots2")), "other")
    found = both.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), likeness(F.col("spots1"), F.col("spots2")).alias("likeness"))
    return found.where(F.col("likeness") >= threshold - 1e-9)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``doc_id, class_id`` of every row of ``docs``, and the alike pairs ``a, b, likeness`` of classes.

    Texts with equal signatures are one class, whose id is a hash of the set. Nulls and empty texts
    share the class of no words. Repeated rows stay; equal texts are never expanded into pairs.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text)).alias("spots"))
    marked = stored(marked.withColumn("class_id", F.xxhash64("spots")), "spots")
    sets = marked.groupBy("class_id").agg(F.first("spots").alias("spots"))
    return marked.select("doc_id", "class_id"), near_pairs(stored(sets, "spot-sets"), key="class_id", threshold=threshold)


# ---- each document against the next


def _bounds(docs: DataFrame, parts: int) -> list:
    """Ids that cut the documents into ``parts`` of about equal size, ascending, as far as they differ."""
    shares = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx("id", F.array(*[F.lit(s) for s in shares]), max(10000, 20 * parts)).alias("b")).first()["b"] if shares else None
    return sorted(set(got or []))


def _part(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key, found in two steps over about their square root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    at_or_below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_or_below(F.array(*[F.lit(b).cast("long") for b in bounds[::step]]))
    fine = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_or_below(F.slice(fine, (coarse - 1) * step + 1, F.lit(step))))


def with_next(docs: DataFrame, columns: list[str], *, part: int = PART) -> DataFrame:
    """Adds ``next_<column>`` of the next row by descending ``id``; after the last comes the first.

    ``docs`` has ``id`` (a long) and ``h``, a hash that orders rows of one id; rows without an id
    come last, by ``h``. The rows are cut into parts, those without an id by their hash, and are
    sent once; the first row of a part goes to the part before it as well. Rows equal in id and
    hash follow one another in one part.
    """
    parts = min(PARTS, max(1, -(-docs.count() // part)))
    bounds = _bounds(docs, parts)
    top = F.shiftrightunsigned("h", 48)
    # parts count upwards in reading order: from the greatest id down, then rows without one
    none = len(bounds) + 1 + F.floor(top * min(parts, NONE_PARTS) / (1 << 16))
    part_ = F.when(F.col("id").isNull(), none).otherwise(len(bounds) - _part(F.col("id"), bounds)).cast("long")
    order = F.struct(F.col("id").isNull().alias("z"), F.bitwise_not("id").alias("id"), top.alias("top"), F.col("h").alias("h"))
    placed = docs.withColumn("part", part_).withColumn("order", order)
    # a row for each part: at most PARTS + NONE_PARTS
    ring = Window.orderBy("part")
    firsts = placed.groupBy("part").agg(F.min("order").alias("first"))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    sent = placed.join(F.broadcast(stored(firsts, "first-rows")), "part")
    own = F.struct(F.col("part"), F.lit(False).alias("extra"))
    also = F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))
    to = F.when(F.col("order").eqNullSafe(F.col("first")), F.array(own, also)).otherwise(F.array(own))
    dealt = sent.select(*docs.columns, "order", F.explode(to).alias("to"))
    in_part = Window.partitionBy("to.part").orderBy("to.extra", "order")
    follow = [F.lead(c).over(in_part).alias(f"next_{c}") for c in columns]
    return dealt.select(*docs.columns, "to", *follow).where(~F.col("to.extra")).drop("to")


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The edited text has its last third replaced by as many first characters of the next document,
    by descending id (after the last: the first). Rows without an id come last; rows of one id are
    ordered by a hash of their text, and equal rows follow one another. A null text is empty, texts
    of any length are read whole, no rows give no rows, and other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("long").alias("id"), body.alias("body"))
    rows = rows.select("doc_id", "id", "body", F.xxhash64("body").alias("h"), signatures(F.col("body")).alias("spots"))
    both = with_next(rows, ["body", "spots"], part=part).withColumn("n", F.length("body"))
    cut = F.floor(F.col("n") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("body", F.lit(1), F.col("n") - cut), F.substring("next_body", F.lit(1), cut)))
    both = both.withColumn("edited_spots", signatures(F.col("edited")))
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


@query("op12_spot_fingerprints")
def op12_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
