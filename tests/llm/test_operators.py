"""Edge rows and brute-force versions of the corpus operators on small tables."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gridhour.llm import decontaminate, knn_quality, language, licenses, lines, pii, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, row long, key string, `n_lines` int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "re", "th", "ou", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, null ids, and columns with clashing names."""
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, "", "en", "a"), (1, " \n\t\n", None, "a"), (2, "one", "en", None), (2, "one", "en", None)]
    rows += [(3, "word " * 30_000, "en", "b"), (3, "word\n" * 300, "de", "b"), (4, "x" * 200_000, "fr", "c"), (5, "é ß 😀 " * 50, "de", "c")]
    rows += [(10 + i, prose(rng, rng.randint(1, 300)), rng.choice(["en", "de"]), f"s{i % 6}") for i in range(20)]
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_quality_counts_equal_a_plain_count(spark, odd, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(odd).collect()}
    want = set()
    for r in odd.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, lined = {}, [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        n = len({p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)})
        want.add((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lined) - len(set(lined)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    assert got == want
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_long_gibberish_and_keyword_lists_are_rejected(spark):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    stop = {"en": ["the", "and", "of", "to", "in", "is"], "de": ["der", "die", "und", "von", "den", "zu"], "fr": ["de", "la", "le", "et", "les", "des"], "es": ["que", "el", "y", "los", "del", "las"]}

    def clean(lang, n):
        said = [rng.choice(stop[lang]) if rng.random() < 0.2 else word("abcdeilmnorstu") for _ in range(n)]
        return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in said)

    keys = [word("abcdeilmnorstu") + "x" for _ in range(60)]
    dotted = lambda ws: " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in ws)
    good = [(i, clean(k, rng.randint(100, 700)), k) for i, k in enumerate(["en", "de", "fr", "es"] * 40)]
    bad = [(1000 + i, dotted(word("bcdfghjklmnpqrstvwxz") + "q" for _ in range(n)), k) for i, (n, k) in enumerate([(100, "en"), (400, "de"), (3000, None), (400, "und")])]
    bad += [(2000 + i, dotted(rng.choice(keys) for _ in range(n)), k) for i, (n, k) in enumerate([(100, "fr"), (400, "es"), (3000, "")])]
    other = [(3000, dotted(word("abcdeilmnorstu") for _ in range(300)), "it")]  # no list tells its words
    docs = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    rows = quality.quality_rules(docs).collect()
    assert {r.doc_id for r in rows if r.base_failed} == set()
    assert {r.doc_id for r in rows if not r.kept} == {i for i, *_ in bad}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, *_ in good + other}


def made_in(lang, rng, n):
    """Clean texts in scripts with and without spaces."""
    if lang in ("zh", "ja"):
        common, rare = ("的一是不了人我在有他", [chr(0x4E00 + i) for i in range(600)]) if lang == "zh" else ("のにはをたがでてと", [chr(0x3042 + i) for i in range(70)] + [chr(0x5000 + i) for i in range(400)])
        line = lambda: "".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(rare) for _ in range(rng.randint(20, 100))) + "。"
        return "\n".join(line() for _ in range(n))
    common, letters = {"ru": (["и", "в", "не", "на", "что"], "абвгдежзиклмнопрст"), "it": (["di", "che", "il", "la", "per"], "abcdefgilmnopqrstuv")}[lang]
    word = lambda: rng.choice(common) if rng.random() < 0.25 else "".join(rng.choice(letters) for _ in range(rng.randint(3, 10)))
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in (word() for _ in range(n)))


def test_every_language_has_its_own_reference(spark):
    rng = random.Random(12)
    good = [(i, made_in(k, rng, rng.randint(12, 40) if k in ("zh", "ja") else rng.randint(100, 400)), k) for i, k in enumerate(["zh", "ja", "ru", "it"] * 40)]
    good += [(500, made_in("zh", rng, 14), None), (501, made_in("ja", rng, 15), "und"), (502, made_in("ru", rng, 300), ""), (503, made_in("it", rng, 300), None)]
    # a language that has too few texts for a reference
    good += [(600, "\n".join("สวัสดี" * rng.randint(3, 9) for _ in range(30)), "th")]
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(n))
    bad = [(1000, noise("бвгджзклмн", 400), "ru"), (1001, noise("bcdfghjklm", 400), "it"), (1002, noise("#|%0123", 300), "it"), (1003, noise("$#*&<>", 300), "zh"), (1004, noise("0123456789|", 300), None)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    rows = quality.quality_rules(docs).collect()
    assert not [r.doc_id for r in rows if r.base_failed]
    assert {r.doc_id for r in rows if not r.kept} == {i for i, *_ in bad}


def plain_distance(p, q):
    import math

    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def test_distances_and_verdicts_equal_plain_ones(spark):
    """The whole of the method again, in plain loops over the texts of one language."""
    import statistics
    import unicodedata

    rng = random.Random(13)
    rows = [(i, made_in("it", rng, rng.randint(20, 320)) + rng.choice(["", " 12 (3) - 4!", " #|#|" * rng.randint(0, 90)]), "it") for i in range(90)]
    rows += [(200 + i, " ".join("xq" * rng.randint(1, 4) for _ in range(n)), "it") for i, n in enumerate([99, 100, 150, 400])]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    letter = lambda c: unicodedata.category(c)[0] in "LM"
    blank = " \t\n\x0b\x0c\r"
    said = {i: "".join(c if letter(c) else " " for c in t.lower()).split() for i, t, _ in rows}
    counts = {}
    for ws in said.values():
        for w in ws:
            if len(w) <= quality.LETTERS:
                counts[w] = counts.get(w, 0) + 1
    common = sorted(counts, key=lambda w: (-counts[w], w))[: quality.COMMON]
    hists = {}
    for i, t, _ in rows:
        tokens = t.split()
        space = len(t) - sum(map(len, tokens))
        marks = [c for c in t if not letter(c) and c not in blank]
        n = {"c_upper": sum(unicodedata.category(c) == "Lu" for c in t), "c_space": space}
        n |= {"c_digit": sum(c in "0123456789" for c in t), "c_stop": sum(c in ".,;:" for c in t), "c_mark": sum(c in "!?'\"()-" for c in t), "c_symbol": sum(c in "#*$%&|<>" for c in t)}
        whole = {"n_chars": len(t), "n_words": len(tokens), "n_marks": space + len(marks) - n["c_digit"]}
        n |= {f"w_{j}": said[i].count(w) for j, w in enumerate(common)}
        for k, h in quality.HISTOGRAMS.items():
            if whole[h.whole] >= h.at_least:
                bins = [n[b] for b in h.bins]
                hists[i, k] = ([b / whole[h.whole] for b in [*bins, max(0, whole[h.whole] - sum(bins))]], whole[h.whole])
    for k, h in quality.HISTOGRAMS.items():
        long = {i: v for (i, name), v in hists.items() if name == k}
        low_median = lambda xs, p: sorted(xs)[max(0, -(-len(xs) * p // 100) - 1)]
        usual = [round(low_median([v[0][j] for v in long.values()], 50), 4) for j in range(len(h.bins) + 1)]
        usual = [u / sum(usual) for u in usual]
        for i in got:
            d = got[i][f"{k}_distance"]
            assert (d is None) == (i not in long)
            if d is not None:
                assert abs(d - plain_distance(long[i][0], usual)) < 1e-6, (k, i)
    limits = {r.lang: r.limits for r in _references(spark, rows)}["it"]
    for i, r in got.items():
        far = any(r[f"{k}_distance"] is not None and r[f"{k}_distance"] > limits[k] for k in limits)
        assert r.kept == (not r.base_failed and not far)
    assert not got[203].kept and not got[202].kept and sum(r.kept for r in got.values()) > 40
    assert statistics.median(got[i]["word_distance"] or 0 for i in range(90)) < limits["word"]


def _references(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = quality.common_words(docs, "text", "lang")
    return quality.references(quality.with_shapes(quality.text_counts(docs, common)), list(common))


def test_every_language_has_a_reference_and_meets_unnamed_texts(spark):
    """More languages than the 64 that a cap once left, and more than the 8 that unnamed texts once met."""
    rng = random.Random(17)
    names = [f"x{i:02d}" for i in range(67)]
    short = {n: [chr(97 + i // 26) * 2 + chr(97 + i % 26) + c for c in "abcdefghijkl"] for i, n in enumerate(names)}
    said = lambda n: " ".join(rng.choice(short[n]) if rng.random() < 0.4 else "".join(rng.choice("bdelmnorstu") for _ in range(7)) for _ in range(120))
    rows = [(1000 * i + j, said(n), n) for i, n in enumerate(names) for j in range(quality.MIN_TEXTS)]
    rows += [(-1 - i, said(n), None) for i, n in enumerate(names)]
    babble = [" ".join("".join(rng.choice("bdelmnorstu") for _ in range(6)) for _ in range(120)) for _ in range(2)]
    rows += [(-101, babble[0], names[-1]), (-102, babble[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = quality.common_words(docs, "text", "lang")
    assert {n: sorted(w) for n, w in common.items()} == {n: sorted(w) for n, w in short.items()}
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[-1 - i].kept for i in range(len(names)))
    assert not got[-101].kept and not got[-102].kept
    assert all(got[i].word_distance is not None for i, _, n in rows if n)


def test_near_groups_equal_all_pairs(spark, odd, none):
    rng = random.Random(5)
    base = prose(rng, 400).split()
    near = [(100 + i, " ".join(base[:i] + ["other"] + base[i + 1 :]), "en", "a", 0, "k", 0) for i in range(0, 60, 3)]
    docs = odd.unionAll(spark.createDataFrame(near, SCHEMA))

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in rows), key=repr)
    for dense in (simhash.DENSE, 2):
        assert sorted(map(tuple, simhash.near_duplicates(docs, dense=dense).collect()), key=repr) == want
    assert simhash.keep_one(docs).count() == len(set(root.values()))
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_contamination_equals_looking_up_windows(spark, odd, none):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (25, 12, 10, 4, 1)]
    bench = items(spark, [(i, p) for i, p in enumerate(passages)] + [(9, None), (10, ""), (None, passages[0]), (11, passages[1])])
    extra = [(200 + i, prose(rng, 8) + " " + p.upper().replace("É", "é") + "! " + prose(rng, 3) + " " + p[: len(p) // 2], "en", "a", 0, "k", 0) for i, p in enumerate(passages)]
    docs = odd.unionAll(spark.createDataFrame(extra, SCHEMA))
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for r in bench.collect():
        w = word(r.text)
        for lo in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[lo : lo + 10]), set()).add(r.item_id)
    want = []
    for r in docs.collect():
        w, hit, found = word(r.text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[tuple(w[i : i + size])]
        want.append((r.doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == sorted(want, key=repr)
    sent, decontaminate.MAX_SENT_WORDS = decontaminate.MAX_SENT_WORDS, 0
    try:
        assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == sorted(want, key=repr)
    finally:
        decontaminate.MAX_SENT_WORDS = sent
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(odd, items(spark, [])).where("contaminated").count()
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not c for *_, c in want)


def test_proximity_allows_shifted_words(spark):
    bench = items(spark, [(1, "a b c d e f g h i j")])
    docs = spark.createDataFrame([(1, "a b c d e x f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h g f e d c b a z")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity(docs, bench, 1).collect()} == {1, 2}


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_equals_all_starts(spark, slop):
    rng = random.Random(slop)
    words = "a b c d e f g".split()
    wins = [[rng.choice(words) for _ in range(4)] for _ in range(5)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(30)]
    texts += [[*w[1::-1], *w[2:]] for w in wins] + [["x", *w] for w in wins] + [[w[0], w[2], w[1], w[3]] for w in wins]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = items(spark, [(i, " ".join(w)) for i, w in enumerate(wins)])
    got = {tuple(r) for r in decontaminate.proximity(docs, bench, slop, window=4).collect()}
    near = lambda t, at, w: any(0 <= at + s < len(t) and t[at + s] == w for s in range(-slop, slop + 1))
    want = {(i, j, at) for i, t in enumerate(texts) for j, w in enumerate(wins) for at in range(-slop, len(t)) if all(near(t, at + k, x) for k, x in enumerate(w))}
    assert got == want and len(want) > 20


def test_lines_on_many_sites_stay_once(spark, odd, none):
    docs = spark.createDataFrame([(i, f"shared\nown {i}\n\nshared", "en", f"s{i}", 0, "k", 0) for i in (5, 3, 8, 9, 7)] + [(20, None, None, None, 0, "k", 0)], SCHEMA)
    cleaned, n_lines, n_removed = lines.line_dedup(docs)
    assert cleaned.columns[:7] == docs.columns and n_lines not in docs.columns
    got = {r.doc_id: (r.text, r[n_lines], r[n_removed]) for r in cleaned.collect()}
    assert got == {3: ("shared\nown 3\n\nshared", 3, 0), 20: (None, 0, 0)} | {i: (f"own {i}\n", 3, 2) for i in (5, 7, 8, 9)}
    assert lines.line_dedup(odd)[0].count() == odd.count() and lines.line_dedup(none)[0].count() == 0


def test_personal_data_equals_plain_patterns(spark, odd, none):
    text = "a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 0.00.000.1 x +1 (000) 555-1234 x 4111 1111 1111 1111 x 4111111111111112 token = 'ab12cd34ef56ab12cd34'"
    more = [(10 + i, text) for i in range(20)]  # cuts are calibrated on rows that the trees have not seen
    found = pii.personal_data(spark.createDataFrame([(1, text), (2, None), (3, "1" * 50_000), *more], "doc_id long, text string")).collect()
    found = [r for r in found if r.doc_id < 10]
    base = {r.doc_id: [(s.kind, text[s.start : s.stop]) for s in r.spans if s.base] for r in found}
    assert base == {1: [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "0.00.000.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (000) 555-1234")], 2: [], 3: []}
    assert [s.kind for r in found for s in r.spans if not s.base] == ["secret"]
    assert pii.personal_data(odd).count() == odd.count() and pii.personal_data(none).count() == 0
    hidden = pii.redact(spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.redacted for r in hidden} == {1: "mail <email> now", 2: None}


def test_language_on_held_out_texts_and_words(spark, odd, none):
    rng = random.Random(1)
    say = {"en": ["the", "thing", "with", "house", "ing"], "de": ["der", "schule", "und", "ich", "ung"]}
    text = lambda k: " ".join(rng.choice(say[k]) + rng.choice(["", "er", "s"]) for _ in range(30))
    rows = [(i, text(k), k) for i in range(60) for k in say]
    model = language.fit(spark.createDataFrame(rows[:80], "doc_id long, text string, lang string"))
    held = spark.createDataFrame(rows[80:], "doc_id long, text string, lang string")
    assert held.join(language.detect(held.drop("lang"), model).distinct(), "doc_id").where("lang = lang_pred").count() >= held.count()
    mixed = [k for _, k in model.label_words("the thing with house the und ich schule der und")]
    assert mixed == ["en"] * 5 + ["de"] * 5
    got = language.detect(odd, model)
    assert got.count() == odd.count() and got.where("lang_pred = 'und' and score = 0").count() == 3
    assert language.detect(odd, language.fit(none)).where("lang_pred <> 'und'").count() == 0 and language.detect(none, model).count() == 0


def test_a_rare_language_is_learned(spark):
    rng = random.Random(4)
    say = {"en": ["the", "thing", "with"], "de": ["der", "schule", "und"], "fi": ["talo", "yksi", "hyvä"]}
    text = lambda k: " ".join(rng.choice(say[k]) + rng.choice(["", "a", "s"]) for _ in range(20))
    rows = [(i, text(k), k) for i, k in enumerate(["en"] * 5000 + ["de"] * 2992 + ["fi"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sent, trained = [], language.train
    language.train = lambda texts, langs: sent.extend(langs) or trained(texts, langs)
    try:
        model = language.fit(docs, sample=90)
    finally:
        language.train = trained
    assert {k: sent.count(k) for k in say} == {"en": 30, "de": 30, "fi": 8}
    fresh = spark.createDataFrame([(i, text(k), k) for i, k in enumerate([*say] * 10)], "doc_id long, text string, lang string")
    assert fresh.join(language.detect(fresh.drop("lang"), model), "doc_id").where("lang <> lang_pred").count() == 0


def test_quality_votes_of_neighbours(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60).capitalize() + "." if i % 3 else prose(rng, 30).upper().replace(" ", "!! ")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("label"))
    model = knn_quality.fit(docs.where("doc_id < 60"), labels)
    held = knn_quality.score(docs.where("doc_id >= 60"), model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 != 0) for r in held)
    assert knn_quality.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert knn_quality.score(odd, knn_quality.fit(none, labels)).where("score = 0.5").count() == odd.count()
    assert knn_quality.score(none, model).count() == 0


def test_quality_votes_differ_by_words_of_one_shape(spark):
    rng = random.Random(8)
    say = [["cheap", "prize", "click", "bonus", "offer"], ["river", "stone", "house", "light", "water"]]
    rows = [(i, " ".join(rng.choice(say[i % 2]) for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = knn_quality.fit(docs.where("doc_id < 80"), docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")))
    assert all((r.score >= 0.7) == (r.doc_id % 2 == 1) for r in knn_quality.score(docs.where("doc_id >= 80"), model).collect())


def test_licences_are_found_and_inherited(spark, odd, none):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.txt", "some prose here"), (3, "r/a/y.txt", "text\nAll rights reserved."),
        (4, "r/c/COPYING", "Licensed under the Apache License, Version 2.0."), (5, "r/c/d/z", None), (6, None, "none"), (7, "top.txt", ""),
    ]
    docs = spark.createDataFrame([(i, t, p) for i, p, t in rows], "doc_id long, text string, path string")
    got = {r.doc_id: (r.own_license, r.license, r.license_folder) for r in licenses.scan(docs, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "r"), 3: ("proprietary", "proprietary", None), 4: ("Apache-2.0", "Apache-2.0", None),
        5: (None, "Apache-2.0", "r/c"), 6: (None, None, None), 7: (None, None, None),
    }
    path = licenses.id_path(F.col("doc_id"), F.col("source"))
    assert licenses.scan(odd, path).count() == odd.count() and licenses.scan(none, path).count() == 0


def plain_notices(text, share, templates, wide):
    """Best cosine of each template over all windows of its length, in plain arithmetic."""
    import math
    from collections import Counter

    weight = lambda t: 1 + math.log(1 / max(share.get(t, 0), licenses.LEAST_SHARE))
    words, best = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()), {}
    for name, wordings in templates.items():
        for wording in wordings:
            t = Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", wording.lower()))
            v = {k: n * weight(k) for k, n in t.items()}
            for i in range(max(1, len(words))):
                w = {k: n * weight(k) for k, n in Counter(words[i : i + sum(t.values())]).items()}
                length = math.sqrt(sum(x * x for x in v.values())) * math.sqrt(sum(x * x for x in w.values()))
                if length:
                    best[name] = max(best.get(name, 0), sum(x * v.get(k, 0) for k, x in w.items()) / length)
    return {k: x for k, x in best.items() if x >= wide}


NOTICES = [
    ("This project is released under the MIT License.", "MIT"), ("Acme: Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Copyright 2020 Acme. All rights reserved.", "proprietary"),
    ("# Redistribution and use in source and binary\n# forms, with or without\n#   modification, are permitted provided that the\n# following conditions are met:", "BSD-3-Clause"),
    ("prose before it. Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including", "MIT"),
    ("The rights of the public and the version of the law.", None), ("free of charge", None), ("", None),
]


def test_notices_keep_their_verdict_as_the_table_grows():
    share = {"the": 0.9, "of": 0.9, "and": 0.9, "to": 0.9, "in": 0.8, "all": 0.2, "this": 0.4, "is": 0.8, "under": 0.1, "license": 0.02, "rights": 0.01, "reserved": 0.01, "version": 0.02, "released": 0.01, "licensed": 0.01, "free": 0.05}
    told = []
    for n in (1_000, 10_000_000):
        known = {t for ws in licenses.TEMPLATES.values() for w in ws for t in licenses.terms(w)}
        scanner = licenses.Scanner({t: int(share.get(t, 0) * n) for t in known}, n, licenses.TEMPLATES)
        told.append([[(round(x, 6), name) for x, name in scanner.find(text)] for text, _ in NOTICES])
        for text, name in NOTICES:
            found = scanner.find(text)
            assert (found[0][1] if found else None) == name, text
            exact = plain_notices(text, share, licenses.TEMPLATES, licenses.LEAST)
            assert {k for _, k in found} <= set(exact)
            if found:
                assert abs(found[0][0] - max(exact.values())) < 1e-9
            else:
                assert not exact
    assert told[0] == told[1]


def test_notices_of_whole_texts_over_spark(spark, odd):
    rng = random.Random(9)
    rows = [(i, prose(rng, 50) + "\n" + text + "\n" + prose(rng, 50), f"r/{i}.txt") for i, (text, _) in enumerate(NOTICES * 3)]
    rows += [(100, None, "r/a"), (101, NOTICES[0][0] + "\n" + prose(rng, 30) + "\n" + NOTICES[1][0], "q/b"), (102, prose(rng, 20_000) + NOTICES[2][0], None)]
    got = {r.doc_id: (r.own_license, r.n_notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert got == {i: (name, int(name is not None)) for i, (_, name) in enumerate(NOTICES * 3)} | {100: (None, 0), 101: ("Apache-2.0", 2), 102: ("proprietary", 1)}


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], [], rng.normal(size=(3, 3)).astype(np.float32))
    lengths = np.array([4, 0, 1, 5])
    scores = rng.normal(size=(10, 3)) * 2
    each, pairs = model.marginals(scores, lengths)
    first, want, moved = 0, np.zeros((10, 3)), np.zeros((3, 3))
    for n in lengths:
        total, part, move = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)) if n else []:
            p = np.exp(sum(scores[first + i, k] for i, k in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, k in enumerate(path):
                part[i, k] += p
            for x, y in zip(path, path[1:]):
                move[x, y] += p
        if n:
            want[first : first + n], moved = part / total, moved + move / total
        first += n
    assert np.allclose(each, want, atol=1e-9) and np.allclose(pairs, moved, atol=1e-9)


def test_words_of_switched_texts(spark):
    """Passages of two languages in one text: each word is labelled by its own, held out."""
    rng = random.Random(21)
    letters = {"en": "thewingsoda", "de": "schundbrikö", "fr": "équlavmoisx"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 8))) for _ in range(300)] for k, v in letters.items()}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = language.train([say(k, rng.randint(5, 60)) for k in [*letters] * 60], [*letters] * 60)
    assert all(model.moves[i, j] != 0 for i in range(3) for j in range(3))
    right = total = 0
    for _ in range(40):
        a, b = rng.sample([*letters], 2)
        n, m = rng.randint(8, 30), rng.randint(8, 30)
        got = [k for _, k in model.label_words(say(a, n) + " " + say(b, m))]
        right, total = right + sum(x == y for x, y in zip(got, [a] * n + [b] * m)), total + n + m
    assert right >= 0.95 * total


def test_languages_are_bounded_and_signs_are_no_letters(spark, monkeypatch):
    monkeypatch.setattr(language, "LABELS", 3)
    rows = [(i, "abc def ghi " * 3, f"l{i % 40:02d}") for i in range(400)] + [(1000 + i, "the cat sat", "en") for i in range(50)] + [(2000 + i, "der hund und", "de") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["de", "en", "l00"]
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "12 34"), (3, "___"), (4, None), (5, "the ½")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.detect(odd, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}


def test_votes_equal_a_plain_cosine_vote(spark):
    import numpy as np

    rng = random.Random(31)
    texts = [prose(rng, rng.randint(5, 60)) + ("!!" * (i % 3)) for i in range(80)]
    counts = [knn_quality.term_counts(t.encode()) for t in texts]
    labels = np.array([float(i % 3 == 0) for i in range(60)])
    model = knn_quality.build(counts[:60], labels, 0.3, 20)
    vectors = model.project(counts[60:])
    got = model.vote(vectors, 7)
    for v, share in zip(vectors, got):
        near = sorted(((float(sum(x * y for x, y in zip(v.astype(float), u.astype(float)))), k) for u, k in zip(model.vectors, labels)), reverse=True)[:7]
        weight = [max(c, 0.0) ** 8 for c, _ in near]
        assert abs(share - sum(w * k for w, (_, k) in zip(weight, near)) / sum(weight)) < 1e-4
    assert knn_quality.best_part(counts[:60], labels, 20) in knn_quality.PARTS


def test_repeated_ids_learn_the_same_on_every_run(spark):
    rng = random.Random(32)
    rows = [(i % 40, prose(rng, 20), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for i, _, k in rows], "doc_id long, label int")
    a, b = (knn_quality.fit(d, labels) for d in (docs.repartition(7), docs.repartition(3)))
    assert (a.vectors == b.vectors).all() and a.part == b.part and len(a.labels) == 40


def test_redaction_follows_the_row(spark):
    rows = [(None, "mail a@b.cd now"), (2, "a@b.cd"), (2, "call +1 (555) 123-4567 now"), (2, "a@b.cd"), (3, None), (4, ""), (5, "x 1.2.3.4 y a@b.c_d@e.f z"), (None, "plain")]
    got = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(None, "mail <email> now"), (2, "<email>"), (2, "call <phone> now"), (2, "<email>"), (3, None), (4, ""), (5, "x <ip> y <email><email> z"), (None, "plain")]
    assert got == sorted(want, key=repr)


def test_base_spans_equal_plain_patterns_on_random_texts(spark):
    rng = random.Random(33)
    bits = ["a@b.cd", "@", ".", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "12-34", "+", " ", "  ", "\n", "é", "x_%+-", "0", "007", "(at)", "4111111111111111", "-"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s.base] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == [(k, m.start(), m.end()) for k, (p, ok) in plain.items() for m in re.finditer(p, t, re.ASCII) if ok(m[0])], t


def test_added_spans_find_planted_secrets(spark):
    """Recall and precision of what the method adds, on rows that name what they hold and rows that only look alike."""
    rng = random.Random(34)
    opaque = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    rows, planted = [], {}
    for i in range(600):
        value = opaque(rng.choice([20, 32, 40]))
        if i % 3 == 0:
            rows.append((i, f"{prose(rng, 8)} {rng.choice(['token', 'api_key', 'password', 'secret'])} = '{value}' {prose(rng, 5)}"))
            planted[i] = value
        elif i % 3 == 1:
            rows.append((i, f"{prose(rng, 8)} {opaque(5)}/{opaque(20)} {prose(rng, 5)}"))
        else:
            rows.append((i, prose(rng, 20)))
    text = dict(rows)
    found = {r.doc_id: [text[r.doc_id][s.start : s.stop] for s in r.spans if not s.base] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(any(v in f or f in v for f in found[i]) for i, v in planted.items())
    assert caught >= 0.95 * len(planted)
    assert sum(bool(found[i]) for i in text if i not in planted) <= 0.05 * len(rows)


def test_pipeline_stages_equal_their_rules(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = pipeline.table(spark, sf, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.stored(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = after
    bench = pipeline.table(spark, sf, "benchmark")
    assert not decontaminate.contamination(docs, bench).where("contaminated").count()
    assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count() == pipeline.run(spark, sf).count()




def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeats, long texts, clashing columns and an empty table through every stage."""
    import corpus_pipeline as pipeline

    rng = random.Random(41)
    clean = [(i, " ".join(prose(rng, 12).capitalize() + "." for _ in range(8)), "en", f"s{i % 7}", i, "k", 1) for i in range(60)]
    null_ids = [(None, t, lang, s, 0, "k", 1) for _, t, lang, s, *_ in clean[:4]]
    docs = odd.unionAll(spark.createDataFrame(clean + null_ids + clean[:3], SCHEMA))
    at = docs
    for name, stage in pipeline.STAGES:
        got = pipeline.stored(stage(spark, at, "/root/testdata/sf0.001"), name)
        if name == "source_mix":
            assert got.columns[: len(docs.columns)] == docs.columns and got.count() == at.count()
            assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, at.collect()))
        else:
            assert got.columns == docs.columns
            if name != "line_dedup":
                assert got.exceptAll(at).count() == 0
            else:
                assert got.count() == at.count()
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
        at = got if name != "source_mix" else at
    kept = {r.doc_id for r in at.collect()}
    assert set(range(60)) & kept and len(kept & set(range(60))) >= 55


def test_mix_carries_rows_and_draws_without_ids(spark):
    from gridhour.llm import mixing

    rows = [(None, "word " * (i % 9 + 1) + str(i), "a" if i % 2 else None, i) for i in range(300)] + [(5, "x y", "b", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_documents(docs, carry=docs.columns).collect()
    assert sorted((repr(r.carry_text), r.carry_size) for r in got) == sorted((repr(t), n) for _, t, _, n in rows)
    assert all(r["size"] == len(r.carry_text.split()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 10 for taken, target in by.values())
    assert len({r.selected for r in got if r.carry_source is None}) == 2 or by[None][1] % sum(r["size"] for r in got if r.source is None) < 10
