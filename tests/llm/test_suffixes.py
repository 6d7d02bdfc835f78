"""Repeated byte strings against a plain index of all windows."""

import hashlib
import random

import numpy as np
import pytest

from gridhour.llm import suffixes


def plain(rows):
    """``(id, text)`` rows to what each keeps, by looking up every 50-byte string."""
    last = suffixes.LAST_ID
    least = {}
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, last), i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((None if i == last else i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "re", "ß", "t", "he ", "o", "\n"]) for _ in range(rng.randint(1, 6)))
    parts = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(size):
        own = " ".join(word() for _ in range(rng.randint(0, 40)))
        rows.append((rng.randint(0, size), own + "".join(rng.sample(parts, rng.randint(0, 3))) + own[: rng.randint(0, 60)]))
    rows += [(None, parts[0] * 2), (None, parts[0] * 2), (3, None), (4, ""), (5, "x" * 49), (6, "x" * 500), (7, "x" * 60), (8, "ab" * 300), (9, "ba" * 40), rows[0], (rows[1][0], rows[0][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_looking_up_every_string(spark, seed):
    rows = corpus(seed, 60)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key long, spans int")
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=repr) == plain(rows)


def test_blocks_and_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 200)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = corpus(5, 40)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=repr) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"mississippi" * 9, b"aaaa" * 40, bytes(range(256)) * 2, b"\x00\x00\x01\x00" * 30])
def test_suffix_array_orders_by_fifty_bytes(text):
    order = suffixes.suffix_array(np.frombuffer(text, np.uint8))
    assert sorted(order.tolist()) == list(range(len(text)))
    ordered = [text[i:] for i in order]
    assert all(a[:50] <= b[:50] for a, b in zip(ordered, ordered[1:]))


def test_no_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def hot_corpus(size):
    """A third of the rows has one 16-byte header before distinct text, a third no id and few passages."""
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [own(120) for _ in range(3)]
    rows = [(i, f"Document-Id: #{i:03d}" + own(90)) for i in range(size)]
    rows += [(None, rng.choice(passages) + own(30)) for _ in range(size)] + [(None, passages[0])] * 20
    rows += [(1000 + i, own(60) + "Document-Id: #" + own(70) + (passages[i % 3] if i % 4 == 0 else "")) for i in range(size)]
    return rows


def test_hot_keys_are_routed_again_until_they_fit(spark, monkeypatch):
    rows = hot_corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks, marked = [], suffixes.least_ids
    kept = {}
    cut = suffixes.bounded_segments

    def watched(segments, bound):
        out = cut(segments, bound)
        once = out.groupBy("key", "mark").agg({"size": "max"}).withColumnRenamed("max(size)", "size")
        kept["largest"] = once.groupBy("key").agg({"size": "sum"}).agg({"sum(size)": "max"}).first()[0]
        return out

    monkeypatch.setattr(suffixes, "bounded_segments", watched)
    for bound in (1 << 19, 2000, 60):
        got = sorted(map(tuple, suffixes.remove_repeats(df, bound=bound).collect()), key=repr)
        assert got == plain(rows)
        blocks.append(kept["largest"])
    assert marked is suffixes.least_ids
    # the last bound is below two windows, so every key has one window there
    assert blocks[0] > 2000 >= blocks[1] and blocks[2] <= 60


def test_a_key_of_many_texts_is_two_rows_a_batch():
    import pyarrow as pa

    rng = random.Random(10)
    texts = [b"x" * 60 + bytes(rng.randrange(97, 120) for _ in range(80)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts, pa.binary())], names=["row", "text"])
    (out,) = suffixes._emit_keys(iter([batch]))
    sent = {}
    for k, r, known in zip(*(out[c].to_pylist() for c in ("key", "row", "known"))):
        sent.setdefault(k, []).append((r, known))
    assert max(len(v) for v in sent.values()) >= 500
    for v in sent.values():
        assert len({r for r, _ in v}) == len(v) and sum(not known for _, known in v) == min(2, len(v))


def test_ids_at_the_end_of_the_range_and_ids_that_are_no_numbers(spark):
    text = "some passage that is long enough to be a repeat of fifty bytes or more"
    rows = [(2**63 - 1, text), (5, text), (None, text)]
    got = sorted(map(tuple, suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain(rows) or {r[0]: r[2] for r in got} == {5: 0, None: len(text), 2**63 - 1: len(text)}
    named = spark.createDataFrame([("7", text), ("b", text), ("a", text)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffixes.remove_repeats(named).collect()} == {"7": 0, "a": len(text), "b": len(text)}


def test_very_long_text(spark):
    rng = random.Random(11)
    rows = [(1, "".join(rng.choice("abcde") for _ in range(60_000)))]
    rows.append((2, rows[0][1][10_000:50_000] + "z" * 500))
    got = sorted(map(tuple, suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain(rows)


def near_copies(n):
    """A text that repeats itself, after a beginning of its own and with a word changed in some of its copies."""
    rng = random.Random(12)
    rows = []
    for i in range(n):
        text = "Is onhe. " * 60
        at = rng.randrange(0, len(text), 9)
        rows.append((n - i, "".join(rng.choice("abcdef ") for _ in range(20)) + (text if i % 3 else text[:at] + "Was" + text[at:])))
    return rows


@pytest.mark.parametrize("bound", [1 << 19, 2000, 60])
def test_a_text_that_repeats_itself_is_routed_by_its_different_windows(spark, monkeypatch, bound):
    rows = near_copies(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut, seen = suffixes.bounded_segments, {}

    def watched(segments, bound):
        out = cut(segments, bound)
        seen["n"] = out.count()
        return out

    monkeypatch.setattr(suffixes, "bounded_segments", watched)
    assert sorted(map(tuple, suffixes.remove_repeats(df, bound=bound).collect()), key=repr) == plain(rows)
    different = sum(len({t[p : p + 50] for p in range(len(t) - 49)}) for _, t in rows)
    assert seen["n"] <= different < sum(len(t) - 49 for _, t in rows) / 2


def test_a_segment_has_one_mark_however_many_ids_it_meets():
    import pyarrow as pa

    rng = random.Random(13)
    base = bytes(rng.randrange(97, 123) for _ in range(84))
    key = int(suffixes.window_runs(base[17:67])[0][0])
    # each cut has the 50 bytes in the middle; the smaller the id, the shorter it is
    cuts = [(base[17 - k : 67 + k], 10 + k) for k in range(18)]
    names = ["key", "segment", "least_id", "last_id", "mark"]
    columns = [pa.array([key] * 18), pa.array([s for s, _ in cuts]), pa.array([i for _, i in cuts]), pa.array([50] * 18), pa.array(range(18))]
    (out,) = suffixes._mark(iter([pa.RecordBatch.from_arrays(columns, names=names)]))
    got = {r["mark"]: r for r in out.to_pylist()}
    assert len(got) == out.num_rows == 18
    for k in range(18):
        assert got[k]["others"] == [{"from_": 0, "to_": 2 * k + 1}]
        assert got[k]["all"] == ([{"from_": 1, "to_": 2 * k}] if k else [])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh "])
def test_segments_left_out_of_the_suffix_array_share_no_window(letters):
    rng = random.Random(len(letters))
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 120))) for _ in range(30)]
    texts = ["".join(rng.choice(parts) for _ in range(6)).encode() for _ in range(60)] + [b"x" * 200, b"x" * 90, b"xy" * 80, b"xyz" * 40]
    by_key = {}
    for t in texts:
        for k, f, e in zip(*suffixes.window_runs(t)):
            by_key.setdefault(int(k), set()).add(t[f : e + 49])
    rows = [(k, s) for k, found in sorted(by_key.items()) for s in sorted(found)]
    may = suffixes.may_repeat([s for _, s in rows], np.array([k for k, _ in rows], np.int64))
    met = {}
    for i, (_, s) in enumerate(rows):
        for p in range(len(s) - 49):
            met.setdefault(s[p : p + 50], set()).add(i)
    needed = set().union(*(x for x in met.values() if len(x) > 1))
    assert needed and needed <= set(np.flatnonzero(may).tolist())
    alone = [bytes(rng.randrange(256) for _ in range(80)) for _ in range(200)]
    cut = [s[f : e + 49] for s in alone for k, f, e in [max(zip(*suffixes.window_runs(s)), key=lambda x: x[2] - x[1])]]
    keys = np.array([suffixes.window_runs(s)[0][0] for s in cut])
    assert not suffixes.may_repeat(cut, keys).any()


def test_equal_segments_of_a_task_are_one_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "MERGED", 40)
    rng = random.Random(14)
    rows = [(rng.randrange(3), bytes([97 + rng.randrange(4)]) * 50, rng.randrange(1000)) for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7])], names=["key", "segment", "id"]) for i in range(0, 500, 7)]
    out = [r for b in suffixes._merge(iter(batches)) for r in b.to_pylist()]
    wanted = {}
    for k, s, i in rows:
        low, high = wanted.get((k, s), (i, i))
        wanted[k, s] = (min(low, i), max(high, i))
    assert {(r["key"], r["segment"]): (r["least_id"], r["last_id"]) for r in out} == wanted and len(out) == len(wanted)
