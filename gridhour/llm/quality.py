"""Quality rules: counts within a text and its divergence from the language's usual shape.

Three histograms describe a text: its characters by class, the marks between its words, and its
words by the language's commonest short words. Each is compared with the reference of the text's
language by the Jensen-Shannon distance; a text is rejected if one is too far. Short texts have
noisy histograms, so each test has a minimum length below which it passes.

Every language with enough texts has a reference, taken from all its documents: its commonest short
words by an exact count, and the medians of the three histograms. The limits come from the spread of
the language's own texts near the minimum length: no limit on words is so wide that a text without a
single common word passes, unless the language's own texts are as far off. A language without a
reference is not judged by its shape. A text that does not name its language is compared with the
references of all languages whose characters are as wide in UTF-8, and passes if one is near.

The common words cost one pass over the texts, the counts another; the counts are stored and read again.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import count_chars, query, stored, table, words

# Character classes.
UPPER = r"\p{Lu}"
MARKS = {"c_digit": "[0-9]", "c_stop": "[.,;:]", "c_mark": r"[!?'\"()\-]", "c_symbol": "[#*$%&|<>]"}
UNTOLD = ["", "und"]
#: A language has a reference from so many texts of at least so many characters on.
MIN_TEXTS, MIN_CHARS = 30, 250
#: The bins of the histogram of words: this many words of at most this many letters; all other words fall into the rest.
COMMON, LETTERS = 12, 5

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The limit on words is the median distance and so many times the step to the upper quartile,
SPREAD = 5
#: but no less and no more than these shares of the distance of a text with no common word.
LEAST_SHARE, MOST_SHARE = 0.75, 0.9


@dataclass(frozen=True)
class Histogram:
    """Counted bins, the count they are a part of, the guard on it, and the largest distance.

    Distances lie in 0 (same shape) to 1 (nothing in common). ``limit`` is the least that is
    measured for a language; without one it follows from the language's common words.
    """

    bins: list[str]
    whole: str
    at_least: int
    limit: float | None


HISTOGRAMS = {
    "class": Histogram(["c_upper", "c_space", *MARKS], "n_chars", 250, 0.28),
    "mark": Histogram(["c_space", "c_stop", "c_mark", "c_symbol"], "n_marks", 45, 0.33),
    "word": Histogram([f"w_{i}" for i in range(COMMON)], "n_words", 100, None),
}


def repeated_words(tokens: Column, hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the hashes of all windows.

    Sorting brings equal windows together; the flagged starts are then put in order and each
    adds the words that the one before does not cover. All of it stays within the row.
    """
    def flagged(ranked: Column) -> Column:
        same = lambda a, b: F.get(ranked, a)["h"] == F.get(ranked, b)["h"]
        at = F.filter(
            F.sequence(F.lit(0), F.size(ranked) - 1),
            lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
        )
        return F.sort_array(F.transform(at, lambda k: F.get(ranked, k)["i"]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one-element arrays bind an intermediate result once for the lambdas that use it often
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    n = once(ranked, lambda r: covered(flagged(r)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(n)


def _spaced(text: Column) -> Column:
    """Lower-case words of letters, each between two spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", "  "), F.lit(" "))


def common_words(docs: DataFrame, text: str, lang: str) -> dict[str, list[str]]:
    """The commonest short words of each language with enough texts, the largest language first.

    Words are counted inside map tasks, and each task sends its best of a language to the ranking,
    so neither a large language nor its words meet in one task. Every language with enough texts is
    listed; its one row reaches the driver.
    """
    named = docs.where(F.col(lang).isNotNull() & ~F.col(lang).isin(UNTOLD))
    sizes = named.where(F.length(text) >= MIN_CHARS).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    largest = [r["lang"] for r in sizes.where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "lang").collect()]
    if not largest:
        return {}
    said = named.where(F.col(lang).isin(largest)).select(F.col(lang).cast("string").alias("lang"), F.explode(F.split(_spaced(F.col(text)), " +")).alias("w"))
    counted = said.where(F.length("w").between(1, LETTERS)).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON)
    found = {r["lang"]: [x["w"] for x in r["found"]] for r in top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("found")).collect()}
    # fewer words than bins: the rest of the bins count a word that no text has
    return {k: [*found.get(k, []), *[" "] * COMMON][:COMMON] for k in largest}


def _literal(value: object, kind: str) -> Column:
    """A list or a map by language as one literal, however many languages there are."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _candidates(lang: Column, known: list[str]) -> Column:
    """Languages whose references a text is compared with."""
    several = lambda names: _literal(names, "array<string>")
    own = F.when(lang.isNull() | lang.isin(UNTOLD), several(known))
    return (own.when(lang.isin(known), F.array(lang.cast("string"))) if known else own).otherwise(several([]))


def text_counts(docs: DataFrame, common: dict[str, list[str]], *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text: words, symbols, repeated lines and words, and the histograms.

    ``common_counts`` has the counts of the common words for each language in ``compared``; the
    columns of ``carry`` come along as ``carry_<column>``.
    """
    kept = [F.col(c).alias(f"carry_{c}") for c in carry]
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), *kept, F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = raw.withColumns({"tokens": words(F.col("text")), "lines": lines, "compared": _candidates(F.col("lang"), list(common))})
    starts = F.when(F.size("tokens") >= WINDOW, F.sequence(F.lit(0), F.size("tokens") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("tokens"), i + k) for k in range(WINDOW)]))
    marks = F.regexp_replace("text", r"[\p{L}\p{M}\x20\x09-\x0D]+", "")
    split = split.withColumns({"hashes": hashes, "spaced": _spaced(F.col("text")), "marks": marks, "joined": F.array_join("tokens", "")})
    # of many languages' words only those that the text has are counted one by one
    some = sorted({w for ws in common.values() for w in ws if w.strip()})
    present = F.array_intersect(F.split("spaced", " +"), _literal(some, "array<string>"))
    split = split.withColumn("present", F.when(F.size("compared") > 1, present))
    lists = _literal(common, "map<string,array<string>>")
    bare = F.octet_length("spaced")
    times = lambda w: ((bare - F.octet_length(F.replace(F.col("spaced"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("int")
    none = F.array().cast("array<array<int>>")
    n_times = lambda w: F.when(F.col("present").isNull() | F.array_contains("present", w) | (F.trim(w) == ""), times(w)).otherwise(0)
    listed = F.transform("compared", lambda k: F.transform(F.element_at(lists, k), n_times)) if common else none
    counted = split.select(
        "doc_id",
        "lang",
        "compared",
        *[f"carry_{c}" for c in carry],
        F.size("tokens").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("tokens"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        F.round(F.octet_length("text") / F.greatest(F.length("text"), F.lit(1))).cast("int").alias("width"),
        count_chars(F.col("joined"), UPPER).alias("c_upper"),
        F.length("marks").alias("n_other"),
        *[count_chars(F.col("marks"), pattern).alias(n) for n, pattern in MARKS.items()],
        listed.alias("common_counts"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    return counted.withColumns(
        {"n_symbols": F.col("c_symbol").cast("long"), "c_space": space, "n_marks": space + F.col("n_other") - F.col("c_digit")}
    )


def shares(counts: Column, whole: Column) -> Column:
    """Counts and the rest of ``whole`` as an array of shares that sum to 1."""
    some = F.greatest(whole, F.lit(1)).cast("double")
    rest = F.greatest(whole - F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(0))
    return F.transform(F.concat(counts, F.array(rest.cast("int"))), lambda c: c / some)


def with_shapes(counts: DataFrame) -> DataFrame:
    """Adds ``h_<histogram>``: its shares for each language in ``compared``."""
    for k, h in HISTOGRAMS.items():
        if k == "word":
            found = F.transform("common_counts", lambda c: shares(c, F.col("n_words").cast("int")))
        else:
            one = shares(F.array(*[F.col(b).cast("int") for b in h.bins]), F.col(h.whole).cast("int"))
            found = F.array_repeat(one, F.size("compared"))
        counts = counts.withColumn(f"h_{k}", found)
    return counts


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


@dataclass(frozen=True)
class Reference:
    """A language's usual histograms, the limits on the distance to them, and its bytes for a character."""

    lang: str
    shapes: dict[str, list[float]]
    limits: dict[str, float]
    width: int


def references(counts: DataFrame, known: list[str]) -> list[Reference]:
    """Each language's usual histograms: the medians of its documents' shares, scaled to 1.

    Medians leave out what a minority of noisy documents does. They merge from per-task
    summaries; one row for each language with enough texts reaches the driver.
    """
    medians = [F.percentile_approx("width", 0.5).alias("width")]
    for k, h in HISTOGRAMS.items():
        for i in range(len(h.bins) + 1):
            share = F.when(F.col(h.whole) >= h.at_least, F.get(F.get(F.col(f"h_{k}"), F.lit(0)), F.lit(i)))
            medians.append(F.round(F.percentile_approx(share, 0.5, 10000), 4).alias(f"{k}_{i}"))
    found = {}
    if known:
        for r in counts.where(F.col("lang").isin(known)).groupBy("lang").agg(*medians).collect():
            shapes = {k: [r[f"{k}_{i}"] or 0.0 for i in range(len(h.bins) + 1)] for k, h in HISTOGRAMS.items()}
            # a histogram that no text is long enough for is not compared
            found[r["lang"]] = ({k: [v / sum(x) for v in x] for k, x in shapes.items() if sum(x)}, r["width"])
    spread = _spreads(counts, {k: v[0] for k, v in found.items()})
    return [Reference(k, shapes, {h: _limit(h, shapes[h], spread[k][h]) for h in shapes}, width) for k, (shapes, width) in ((k, found[k]) for k in known if k in found)]


def _spreads(counts: DataFrame, shapes: dict[str, dict[str, list[float]]]) -> dict[str, dict]:
    """Median and upper quartile of the distances of a language's own texts to its reference.

    The measured texts have less than twice the minimum length, where distances are largest.
    """
    if not shapes:
        return {}
    measured = []
    for k, h in HISTOGRAMS.items():
        usual = {lang: found[k] for lang, found in shapes.items() if k in found}
        short = F.col(h.whole).between(h.at_least, 2 * h.at_least - 1)
        own = distance(F.get(F.col(f"h_{k}"), F.lit(0)), F.element_at(_literal(usual, "map<string,array<double>>"), F.col("lang"))) if usual else F.lit(None).cast("double")
        measured.append(F.percentile_approx(F.when(short, own), [0.5, 0.75], 10000).alias(k))
    return {r["lang"]: r for r in counts.where(F.col("lang").isin(list(shapes))).groupBy("lang").agg(*measured).collect()}


def _limit(name: str, q: list[float], spread: list[float] | None) -> float:
    """The largest distance that is usual."""
    least = HISTOGRAMS[name].limit
    if least is not None:
        return max(least, spread[0] + SPREAD * (spread[1] - spread[0])) if spread else least
    # the distance of a text with no common word
    bare = math.sqrt(max(0.0, (sum(q[:-1]) + math.log2(2 / (1 + q[-1])) + (q[-1] * math.log2(2 * q[-1] / (1 + q[-1])) if q[-1] else 0.0)) / 2))
    mid, upper = spread or (0.0, bare)
    return min(max(mid + SPREAD * (upper - mid), LEAST_SHARE * bare), MOST_SHARE * bare) if upper < MOST_SHARE * bare else 1.0


def judge(counts: DataFrame, refs: list[Reference]) -> DataFrame:
    """Add ``base_failed``, the distances and ``kept`` to counts."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = counts.withColumn("base_failed", base)
    usual = []
    for k, h in HISTOGRAMS.items():
        own = {r.lang: {"q": r.shapes[k], "most": r.limits[k], "width": r.width} for r in refs if k in r.shapes}
        near = F.array().cast("array<struct<d:double,most:double>>")
        if own:
            ref = _literal(own, "map<string,struct<q:array<double>,most:double,width:int>>")
            # the language that a text names is its own; others have to write as wide
            alike = lambda x: x["ref"].isNotNull() & (F.col("lang").eqNullSafe(x["lang"]) | (x["ref"]["width"] == F.col("width")))
            pairs = F.zip_with("compared", f"h_{k}", lambda n, p: F.struct(n.alias("lang"), p.alias("p"), F.element_at(ref, n).alias("ref")))  # noqa: B023
            near = F.transform(F.filter(pairs, alike), lambda x: F.struct(distance(x["p"], x["ref"]["q"]).alias("d"), x["ref"]["most"].alias("most")))
        counts = counts.withColumn(f"d_{k}", F.when(F.col(h.whole) >= h.at_least, near))
        counts = counts.withColumn(f"{k}_distance", F.array_min(F.transform(f"d_{k}", lambda x: x["d"])))
        usual.append(F.coalesce((F.size(f"d_{k}") <= 0) | F.exists(f"d_{k}", lambda x: x["d"] <= x["most"]), F.lit(True)))
    dropped = [f"{x}_{k}" for x in "hd" for k in HISTOGRAMS]
    return counts.withColumn("kept", reduce(lambda a, b: a & b, usual, ~F.col("base_failed"))).drop(*dropped, "common_counts", "compared", "width")


def _judged(docs: DataFrame, doc_id: str, text: str, lang: str, carry: tuple[str, ...] = ()) -> DataFrame:
    common = common_words(docs, text, lang)
    counts = stored(text_counts(docs, common, doc_id=doc_id, text=text, lang=lang, carry=carry), "quality-counts")
    counts = with_shapes(counts)
    return judge(counts, references(counts, list(common)))


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document with its counts, distances and verdict.

    A null text is empty: no words, so ``base_failed``. A null, empty or ``und`` language adds to no
    reference and is compared with those of all languages that write as wide. A language of fewer than
    ``MIN_TEXTS`` texts has no reference: its texts are judged by their counts only. Distances are null below the minimum lengths and without a
    reference. Repeated rows and ids are judged each for itself, very long texts as a whole; other
    columns are ignored; no rows give no rows.
    """
    return _judged(docs, doc_id, text, lang)


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns as they are.

    Rows travel with their counts, so nothing is joined back: null and repeated ids, repeated rows
    and columns of any name stay as they are, and no text is shuffled.
    """
    good = _judged(docs, doc_id, text, lang, carry=tuple(docs.columns)).where("kept")
    return good.select(*[F.col(f"carry_{c}").alias(c) for c in docs.columns])


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
