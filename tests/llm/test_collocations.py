"""Phrase counts and scores against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from gridhour.llm import collocations as C

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def counts(rows):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, least=10, top=2000):
    out = []
    for lang, f in counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        frequent = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        kept = []
        for p, a in frequent.items():
            if len(p) == 2 and any(100 * v >= 50 * a for q, v in frequent.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def made(seed, n=400, vocabulary=60):
    rng = random.Random(seed)
    words = ["the", "Of", "in", "straße", "naïve", "x\x00y"] + ["w%d" % i for i in range(vocabulary)]
    texts = []
    for i in range(n):
        w = rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "; "]) for x in w)
        texts.append((i, text, rng.choice(["en", "en", "de", None])))
    return texts


def run(spark, rows, **how):
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("sample", [1, 3, 1000])
def test_scores_equal_plain_loops_for_any_sample(spark, sample):
    rows = made(1)
    assert run(spark, rows, sample=sample, bits=16, chunk=700) == brute(rows)


def test_border_failures_lead_to_further_passes(spark):
    # words and phrases that only documents outside the sample hold
    rows = made(2, 200) + [(1000 + i, "alpha beta gamma. beta gamma delta", "en") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    found, totals, passes = C.frequent_phrases(df, sample=10**9, bits=18)
    assert passes >= 3
    got = {(bytes(r["lang"]).decode(), tuple(bytes(r["phrase"]).decode().split(" "))): r["n"] for r in found.collect()}
    assert got == {(lang, p): v for lang, f in counts(rows).items() for p, v in f.items() if v >= 10}
    everything, _, one = C.frequent_phrases(df, sample=1, bits=18)
    assert one <= passes and everything.count() == found.count()
    assert {bytes(r["lang"]).decode(): r["n"] for r in totals.collect()} == {lang: sum(v for p, v in f.items() if len(p) == 1) for lang, f in counts(rows).items()}


def test_crowded_bitmaps_change_nothing(spark):
    rows = made(3, 150)
    assert run(spark, rows, bits=15, sample=4) == brute(rows)


def test_edge_rows(spark):
    rows = [(None, None, None), (None, "", "en"), (1, "a b " * 30, None), (1, "a b " * 30, "und"), (2, "...,;", ""), (3, "z " * 25, ""), (3, "z " * 25, ""), (4, "é É é " * 12, "fr")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS n", "'x' AS phrase", "3 AS size", "4 AS key")
    assert sorted(tuple(r) for r in C.collocations(more).collect()) == brute(rows)


def test_very_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 1000)
    rng = random.Random(4)
    rows = [(1, " ".join(rng.choice("abcde") + rng.choice(["", "", "."]) for _ in range(40000)), "en"), (2, "q r " * 20000, "en")]
    assert b"".join(C._slices(rows[0][1].encode())) == rows[0][1].encode().translate(C._TABLE)
    assert run(spark, rows, chunk=5000) == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(1, "a b. " * 50000 + "a. " * 7 + "b. " * 3, "en")]
    assert run(spark, rows) == brute(rows)


def test_ties_and_top(spark):
    rows = [(i, "p%d q%d. " % (i % 30, i % 30) * 10, "en") for i in range(30)]
    assert run(spark, rows, top=7) == brute(rows, top=7)
