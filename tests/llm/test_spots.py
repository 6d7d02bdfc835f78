"""Spot signatures, their likeness and near pairs against plain loops."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm import spots as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def plain_signatures(text):
    """The chains themselves instead of their hashes."""
    text = text or ""
    lower = text.lower()
    t = regex.findall(r"[\p{L}\p{M}\p{N}]+", UNSPACED.sub(r" \g<0> ", lower) if len(text.encode()) >= 2 * len(text) else lower)

    def chains(spot):
        found = set()
        for i, w in enumerate(t):
            if spot(w):
                after = [x for x in t[i + 1 :] if spot is ANY or not spot(x)][: S.CHAIN]
                if len(after) == S.CHAIN:
                    found.add((w, *after))
        return found

    found = chains(lambda w: w in S.SPOTS)
    if not found and len(t) > S.CHAIN:
        found = chains(ANY)
    return found or {(None, *t) if t else (None, text)}


def fast_signatures(text):
    """As above for spaced texts with chains, in one pass from the end."""
    found, after = set(), []
    for w in reversed(regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())):
        if w not in S.SPOTS:
            after = [w, *after][: S.CHAIN]
        elif len(after) == S.CHAIN:
            found.add((w, *after))
    return found


def ANY(w):
    return True


def alike(a, b):
    return len(a & b) / len(a | b)


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = plain_signatures(text)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(own, plain_signatures(edited)), alike(own, plain_signatures(after))))
    return sorted(out, key=repr)


def prose(rng, n):
    words = ["the", "of", "and", "in", "der", "la"] * 6 + ["Wort%d" % i for i in range(80)] + ["naïve", "Éa", "x-ray", "7"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n))


def made(n=300, seed=1):
    rng = random.Random(seed)
    return [(i * 7 % 1009, prose(rng, rng.randrange(0, 80))) for i in range(n)]


@pytest.mark.parametrize("part", [7, 2048])
def test_values_equal_plain_loops(spark, part):
    rows = made() + [(5000, ""), (5001, None), (5002, "的一是不了人我在有他这为之大来以个中上们"), (5003, "of the"), (5004, "one"), (5005, "?!"), (5006, "??"), (5007, "😀 the 😀 deep blue sea")]
    got = S.edited_fingerprints(spark.createDataFrame(rows, SCHEMA), part=part)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    assert sorted(((r[0], r[1], r[2], r[5], r[6]) for r in got), key=repr) == plain(rows)
    for r in got:
        shown = [r["fingerprint"][i : i + S.DIGITS] for i in range(0, len(r["fingerprint"]), S.DIGITS)]
        assert shown == sorted(set(shown)) and len(shown) == len(plain_signatures(dict(rows)[r["doc_id"]]))


def test_equal_texts_have_equal_fingerprints_whatever_follows(spark):
    rows = made(50) + [(3000 + i, made(50)[i % 3][1]) for i in range(30)]
    got = S.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = dict(rows)
    by_text, by_print = {}, {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        by_print.setdefault(r["fingerprint"], set()).add(frozenset(plain_signatures(texts[r["doc_id"]])))
    assert all(len(v) == 1 for v in by_text.values()) and all(len(v) == 1 for v in by_print.values())


def test_null_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(None, prose(rng, 20)) for _ in range(40)] + [(7, prose(rng, 20)) for _ in range(40)] + [(7, "same of the big day")] * 20 + [(None, None)] * 5 + [(-(2**63), "least of all things"), (2**63 - 1, "most of all things")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [S.edited_fingerprints(d, part=p).collect() for d, p in ((df, 2048), (df.repartition(5), 3))]
    assert len(got[0]) == len(rows)
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert len(texts) > 80


def test_one_row_no_row_and_clashing_columns(spark):
    one = S.edited_fingerprints(spark.createDataFrame([(4, "the quick brown fox of the north")], SCHEMA)).collect()
    assert [(r["near_next"], r["n_chars"]) for r in one] == [(1.0, 32)]
    assert S.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(made(20), SCHEMA)
    more = df.selectExpr("*", "1 AS id", "2 AS h", "'x' AS body", "3 AS part", "4 AS spots", "5 AS `order`", "6 AS n")
    assert sorted(S.edited_fingerprints(more).collect()) == sorted(S.edited_fingerprints(df).collect())


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, prose(rng, 60000)), (2, prose(rng, 60000))]
    monkeypatch.setitem(globals(), "plain_signatures", fast_signatures)
    got = S.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r[0], r[1], r[2], r[5], r[6]) for r in got), key=repr) == plain(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_near_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(400), rng.randrange(1, 30))) for _ in range(120)]
    for _ in range(200):  # near copies of one another
        base = set(rng.choice(sets))
        for _ in range(rng.randrange(0, 4)):
            base.discard(rng.choice(sorted(base)) if base else 0)
            base.add(rng.randrange(400))
        sets.append(sorted(base))
    sets = sorted({tuple(s) for s in sets})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "key long, spots array<long>")
    got = {(r["a"], r["b"]): r["likeness"] for r in S.near_pairs(df, threshold=threshold).collect()}
    exact = {(i, j): alike(set(a), set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
    assert got == {k: v for k, v in exact.items() if v >= threshold - 1e-9} and got
    assert S.near_pairs(df.limit(0)).collect() == []


def test_near_duplicates_give_classes_and_links(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(1, base), (2, base), (3, base + " the last new words of it all"), (4, prose(rng, 300)), (None, None), (6, "")]
    classes, pairs = S.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    by_id = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert by_id[1] == by_id[2] != by_id[3] and by_id[None] == by_id[6] and len(by_id) == 6
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == {frozenset((by_id[1], by_id[3]))}


def test_size_parts_hold_alike_sets_together():
    for threshold in (0.5, 0.8, 0.9):
        import math

        part = lambda n: math.floor(math.log(n) / -math.log(threshold) + 1e-9)
        for n in range(1, 400):
            for m in range(n, int(n / threshold + 1e-9) + 1):
                assert part(m) - part(n) in (0, 1)


def test_signatures_column_alone(spark):
    df = spark.createDataFrame([("the big red the dog",)], "t string").select(S.signatures(F.col("t")).alias("s"))
    assert len(df.first()["s"]) == len(plain_signatures("the big red the dog")) == 1
