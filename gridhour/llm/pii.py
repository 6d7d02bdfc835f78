"""Personal data: exact base patterns, and further spans chosen by boosted trees.

The base patterns give emails, IP addresses, card and phone numbers. Beside them, generators
of high recall propose further spans (long numbers, opaque tokens, mail-like handles). Their
format and context are coded into a small grid of features. Spans that a precise rule already
vouches for (a base span, or a token that is assigned to a name like ``token`` or ``password``)
count as positive, the others as negative; these counts for each cell of the grid, taken over
all documents, are all that the trees are fitted on. Every span's cell is among them, so the
scored cells are the whole model. A cut is calibrated for each generator, and what it selects
outside base spans is added.

Positions come from splitting: the parts between the matches and the matches themselves, in
turn, add up to the text. Patterns are written so that a search never backs up over what it
has read: they begin only where a run of their characters begins, and repeat possessively.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhour.llm.common import query, stored, table

_RUN = r"(?:(?<![{0}])|\G)"
_LOCAL, _OPAQUE = r"A-Za-z0-9._%+-", r"A-Za-z0-9_+/=-"
# Base kinds in their fixed order.
BASE = {
    "email": _RUN.format(_LOCAL) + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + r"[0-9]++(?:\.[0-9]++){2}\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further spans.
WIDE = {
    "number": _RUN.format("0-9") + r"\+?[0-9](?:[\x20./()-]{0,2}[0-9])++",
    "secret": _RUN.format(_OPAQUE) + r"[A-Za-z0-9_+/=-]{16,}+",
    "handle": _RUN.format(_LOCAL) + r"[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?|@)[A-Za-z0-9-]++",
}
KINDS = [*BASE, *WIDE]
NAMES = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|credential)s?[\"']?\x20?[=:]\x20?[\"']?$"
CONTEXT = r"(?i)(?:token|key|secret|passw|pwd|auth|tel|phone|fon|call|fax|card|iban|account|konto|ssn|passport|mail|contact|id)"
#: Characters before a span that count as its context.
BEFORE = 24
ROUNDS, DEPTH, SHRINK = 40, 2, 0.3
#: Least share of positives among the spans that a cut selects, and least probability of each.
PRECISION = 0.9
FEATURES = ["kind", "size", "digits", "hex", "parted", "cased", "named", "assigned"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: Column, found: Column) -> Column:
    """Whether a match passes the check of its kind; failing matches are dropped, not retried."""
    digits = _digits(found)
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
    ip = F.forall(F.split(found, r"\."), lambda p: part(p) & small(p))
    n = F.length(digits)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "number", n >= 9)
        .when(kind == "secret", (n > 0) & found.rlike("[A-Za-z]"))
        .otherwise(F.lit(True))
    )


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """All documents as ``row, doc_id`` (and ``whole``, the text, if asked for), and their valid matches of every kind.

    Matches have ``row, kind, rank, start, stop, found, before``; positions are code points,
    ``stop`` is exclusive. Texts without a digit or an at-sign are read once and hold none.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [F.col(text).cast("string").alias("whole")] if keep_text else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *kept, F.when(t.rlike(r"[0-9@]|[\[(](?:at|AT)[\])]"), t).alias("text"))

    def pieces(pattern: str) -> Column:
        gaps = F.split("text", pattern, -1)
        short = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("before")))
        return F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), short.alias("gap"))

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), pieces(p).alias("pieces")) for i, (k, p) in enumerate({**BASE, **WIDE}.items())])
    shown = ["row", "doc_id", *["whole"][: len(kept)]]
    held = stored(rows.select(*shown, F.when(F.col("text").isNotNull(), kinds).alias("kinds")), "pii-matches")
    each = held.where("kinds is not null").select("row", F.explode("kinds").alias("k"))
    each = each.select("row", "k.kind", "k.rank", F.posexplode("k.pieces").alias("i", "p")).where("p.found is not null")
    each = each.select("row", "kind", "rank", "i", F.col("p.found").alias("found"), F.col("p.gap.gap").alias("gap"), F.col("p.gap.before").alias("before"))
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("found")).over(order)
    placed = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("found"))
    return held.select(*shown), placed.where(_valid(F.col("kind"), F.col("found"))).drop("i", "gap")


def _marked(spans: DataFrame) -> DataFrame:
    """Spans with ``base`` and ``touches``: whether a base span of the row overlaps them."""
    base = F.col("rank") < len(BASE)
    order = Window.partitionBy("row").orderBy("start", "stop", "rank")
    before = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touches = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False))
    return spans.withColumns({"base": base, "touches": touches})


def _featured(marked: DataFrame) -> DataFrame:
    """Proposed spans with their cell of the feature grid and the weak label."""
    found, n = F.col("found"), F.length("found")
    share = F.length(_digits(found)) / n
    cells = {
        "f_kind": F.col("rank") - len(BASE),
        "f_size": F.least(F.floor(n / 6), F.lit(7)).cast("int"),
        "f_digits": F.floor(share * 4).cast("int"),
        "f_hex": found.rlike("^[0-9a-fA-F]+$").cast("int"),
        "f_parted": found.rlike(r"[^A-Za-z0-9]").cast("int"),
        "f_cased": (found.rlike("[a-z]") & found.rlike("[A-Z]")).cast("int"),
        "f_named": F.col("before").rlike(CONTEXT).cast("int"),
        "f_assigned": F.col("before").rlike("[=:\"']\\x20?$").cast("int"),
    }
    rule = F.col("touches") | (F.col("kind") == "secret") & F.col("before").rlike(NAMES)
    return marked.where(~F.col("base")).withColumns({**cells, "positive": rule})


@dataclass
class Tree:
    """A split ``feature <= at`` with two subtrees, or a leaf with a value."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.low.predict(x), self.high.predict(x))


def _grow(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int) -> Tree:
    gain = lambda m: slope[m].sum() ** 2 / (bend[m].sum() + 1.0)
    leaf = Tree(float(SHRINK * slope.sum() / (bend.sum() + 1.0)))
    if depth == 0 or len(x) < 2:
        return leaf
    whole, best = gain(np.ones(len(x), bool)), (1e-6, -1, 0)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= at
            best = max(best, (float(gain(low) + gain(~low) - whole), f, int(at)))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(0.0, best[1], best[2], _grow(x[low], slope[low], bend[low], depth - 1), _grow(x[~low], slope[~low], bend[~low], depth - 1))


def boost(
    x: np.ndarray, positive: np.ndarray, negative: np.ndarray, held_positive: np.ndarray, held_negative: np.ndarray
) -> tuple[list[Tree], dict[int, float]]:
    """Trees of the log-odds, and for each generator the least score that is precise enough.

    The trees are fitted on the first two counts of each cell; precision is that of the held ones,
    which come from other rows. A generator without held spans adds nothing.
    """
    trees, score = [], np.zeros(len(x))
    for _ in range(ROUNDS if positive.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        slope, bend = positive - (positive + negative) * p, (positive + negative) * p * (1 - p)
        trees.append(_grow(x, slope, bend, DEPTH))
        score = score + trees[-1].predict(x)
    cuts = {}
    for kind in range(len(WIDE)):
        mine = x[:, 0] == kind if len(x) else np.zeros(0, bool)
        for cut in np.unique(score[mine])[::-1] if trees else []:
            chosen = mine & (score >= cut)
            held = (held_positive + held_negative)[chosen].sum()
            if cut >= np.log(PRECISION / (1 - PRECISION)) and held and held_positive[chosen].sum() >= PRECISION * held:
                cuts[kind] = float(cut)
    return trees, cuts


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``.

    ``spans`` is an array of ``rank, start, stop, kind, base`` in that order. Added spans
    overlap no base span, and of overlapping ones the longest stays. A null text is empty.
    Repeated rows are searched each; other columns are ignored; no rows give no rows; texts of any
    length are searched whole, each by one task. The trees see at most one count for each cell of the feature grid (every feature has fewer than 16 values, all but three only two).
    """
    found = _found(docs, doc_id, text)
    return found.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


SPANS = "array<struct<rank:int,start:bigint,stop:bigint,kind:string,base:boolean>>"
#: One row in so many is held out to calibrate the cuts.
HELD = 4


def _found(docs: DataFrame, doc_id: str, text: str, keep_text: bool = False) -> DataFrame:
    """Every row with its spans, null where it has none."""
    rows, spans = find_spans(docs, doc_id=doc_id, text=text, keep_text=keep_text)
    marked = stored(_marked(spans), "pii-spans")
    featured = _featured(marked)
    told, yes = F.pmod(F.xxhash64("row"), F.lit(HELD)) > 0, F.col("positive")
    four = [F.count_if(told & yes).alias("p"), F.count_if(told & ~yes).alias("n"), F.count_if(~told & yes).alias("hp"), F.count_if(~told & ~yes).alias("hn")]
    counts = featured.groupBy(*[f"f_{f}" for f in FEATURES]).agg(*four)
    cells = sorted(tuple(r) for r in counts.collect())
    grid = np.array(cells, np.int64).reshape(-1, len(FEATURES) + 4)
    trees, cuts = boost(grid[:, :-4], *grid[:, -4:].astype(float).T)

    score = sum((t.predict(grid[:, :-4]) for t in trees), np.zeros(len(grid)))
    picked = [c[:-4] for c, s in zip(cells, score, strict=True) if s >= cuts.get(c[0], np.inf)]
    code = lambda values: sum(v * 16**i for i, v in enumerate(values))
    chosen = code(F.col(f"f_{f}").cast("long") for f in FEATURES).isin([code(c) for c in picked])
    added = featured.where(~F.col("touches")).where(chosen)
    longest = Window.partitionBy("row").orderBy("start", F.desc("stop"), "rank")
    beyond = F.max("stop").over(longest.rowsBetween(Window.unboundedPreceding, -1))
    added = added.withColumn("beyond", beyond).where("beyond is null or start >= beyond")
    listed = marked.where("base").select("row", "rank", "start", "stop", "kind", "base").unionByName(added.select("row", "rank", "start", "stop", "kind", "base"))
    grouped = listed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "stop", "kind", "base"))).alias("spans"))
    return rows.join(stored(grouped, "pii-found"), "row", "left")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, redacted``, a row for each row of ``docs``: every span replaced by its kind in angle brackets.

    Base spans of different kinds may overlap; overlapping spans become one replacement. Spans stay
    with the row they were found in, so null, repeated and equal ids do no harm. A null text stays null.
    """
    found = _found(docs, doc_id, text, keep_text=True)
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>").alias("cut"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(F.greatest(s["start"], acc["at"]).alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))
        return F.when(-s["end"] > acc["at"], F.struct((-s["end"]).alias("at"), F.concat(acc["cut"], F.array(new)).alias("cut"))).otherwise(acc)

    cuts = found.select("doc_id", "whole", F.aggregate(by_place, empty, step)["cut"].alias("cut"))
    # the part before each cut and the one after the last; a part is read from the text once
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("cut", i - 1)["stop"])
    piece = lambda s, i: F.concat(F.substring("whole", (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
    tail = F.substring("whole", (F.get("cut", F.size("cut") - 1)["stop"] + 1).cast("int"), F.length("whole"))
    hidden = F.concat(F.array_join(F.transform("cut", piece), ""), tail)
    return cuts.select("doc_id", F.when(F.size("cut") > 0, hidden).otherwise(F.col("whole")).alias("redacted"))


@query("op6_pii_boosted")
def op6_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
