"""Removal of repeated byte strings with suffix arrays.

Every 50-byte string that also starts in a document with a smaller id is removed. Suffixes
of the whole corpus cannot meet in one task, so windows of 50 bytes are first routed: the key
of a window is the least hash among its 16-byte strings, which is the same wherever the
window stands, and neighbouring windows mostly share it. A run of windows with one key and
the bytes they cover is a segment.

1. Keys that stand in one text only cannot repeat. Only keys of two or more texts go on, and only
   those segments are cut out. A task that meets a key in several texts sends two of them to the
   key's task and passes the others by, so a key of very many texts is two rows a task.
2. Equal texts are grouped by their digest; all but the least id are removed as a whole and
   cut no segments.
3. Segments of a key meet. Where the different segments of a key exceed a bound, their windows are
   routed again by the next least hash, and where that is not enough by a hash of all 50 bytes, so
   that no task has to sort more than the bound at a time. Equal runs of a segment stay one row.
4. Equal segments are merged before the shuffle, so a passage on a third of all documents is
   one row a task. Those that agree with no other of their key beside its 16 bytes share no window.
   A suffix array over blocks of the others, built by two-stage sorting, brings equal
   windows together, and adjacent common prefixes of 50 bytes or more mark them. Each window gets
   the least id it starts in.
5. The marks, one for each different segment, are joined back to the segments and the removed runs
   to the documents.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import emptied, query, stored, table

LENGTH, GRAM = 50, 16
#: Bytes of segments that one suffix array covers: its words stay in the cache.
BLOCK = 1 << 18
#: A key whose different segments have more bytes is routed again; one suffix array has less than both together.
HOT = 1 << 19
#: Rows that a task holds while it merges segments.
MERGED = 200_000
MERGED_BYTES = 1 << 25
LAST_ID = (1 << 63) - 1


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    joined = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    return (joined ^ (joined >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _eights(buffer: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each position on as one number, ``<u8`` or ``>u8``."""
    buffer = np.ascontiguousarray(buffer)
    return np.ndarray((max(len(buffer) - 7, 0),), kind, buffer, strides=(1,)).astype(np.uint64)


def _grams(buffer: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    eight = _eights(buffer, "<u8")
    hashed = _mixed(eight[: -GRAM // 2], eight[GRAM // 2 :])
    return hashed ^ (hashed >> np.uint64(32))


def _least(hashed: np.ndarray) -> np.ndarray:
    """The least hash inside each 50-byte window."""
    width, n = LENGTH - GRAM + 1, len(hashed) - (LENGTH - GRAM)
    least, span = hashed, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def window_keys(text: bytes) -> np.ndarray:
    """The routing key of every 50-byte window of a text."""
    return _least(_grams(np.frombuffer(text, np.uint8))).view(np.int64)


def next_least(buffer: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Second routing key: the least hash of each window other than the first key (of each position)."""
    hashed = _grams(buffer)
    # hashed anew, so that what is frequent under the first order is not least under this one as well
    again = _mixed(hashed, hashed)
    again[hashed == key.view(np.uint64)[: len(hashed)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return _least(again)


def whole_window(buffer: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Last routing key: a hash of all bytes of each window."""
    hashed, n = _grams(buffer), len(buffer) - LENGTH + 1
    out = hashed[:n]
    for at in (GRAM, 2 * GRAM, LENGTH - GRAM):
        out = _mixed(out, hashed[at : at + n])
    return out


def window_runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one key: keys, first windows, and ends (exclusive)."""
    keys = window_keys(text)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], first, np.append(first[1:], len(keys))


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    return _eights(np.concatenate([buffer, np.zeros(63, np.uint8)]), ">u8")


def suffix_array(buffer: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a byte buffer by at least their first 50 bytes.

    Two-stage sorting: suffixes smaller than their successor are sorted directly, by words of
    eight bytes and only as far as they tie. The others follow: when the first letters are
    scanned in order, the suffix before each one met is next in the bucket of its own letter.
    """
    n = len(buffer)
    if n == 0:
        return np.empty(0, np.int64)
    letters = buffer.astype(np.int16)
    after = np.append(letters[1:], -1)
    turn = np.where(letters != after, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = letters[turn] < after[turn]

    word = _words(buffer)
    direct = np.flatnonzero(small)
    first = word[direct]
    order = np.argsort(first)
    direct, first = direct[order], first[order]
    tied = np.append(False, first[1:] == first[:-1]) if len(direct) else np.empty(0, bool)
    for depth in range(8, 56, 8):
        held = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(held):
            break
        group, at = np.cumsum(~tied)[held], direct[held]
        # the tied group and the rank of the next word make one number, so plain sorts do
        by_word = np.argsort(word[at + depth])
        next_word = word[at[by_word] + depth]
        rank = group[by_word] << 32 | np.cumsum(np.append(False, next_word[1:] != next_word[:-1]))
        order = np.argsort(rank)
        rank = rank[order]
        direct[held] = at[by_word[order]]
        tied[held] = np.append(False, rank[1:] == rank[:-1])

    cuts = np.searchsorted(letters[direct], np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        large[letters[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(large[c]) if large[c] else np.empty(0, np.int64)
        found = []
        while len(wave):
            found.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(letters[wave] == c) & ~small[wave]]
        found.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(found)
        out.append(bucket)
        ahead = bucket[bucket > 0] - 1
        ahead = ahead[(letters[ahead] > c) & ~small[ahead]]
        if len(ahead):
            own = letters[ahead]
            ahead = ahead[np.argsort(own, kind="stable")]
            own = letters[ahead]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for part in np.split(ahead, heads[1:]):
                large[letters[part[0]]].append(part)
    return np.concatenate(out)


def least_ids(segments: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with one least id: segment, first window, end (exclusive), least id.

    The least id of a window is taken over all segments that contain it; every window of
    every segment lies in one range.
    """
    if not segments:
        return (np.empty(0, np.int64),) * 4
    sizes = np.array([len(s) for s in segments])
    buffer = np.frombuffer(b"".join(segments), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)
    whole = np.arange(len(buffer)) + LENGTH <= (firsts + sizes)[owner]
    order = suffix_array(buffer)
    order = order[whole[order]]
    word = _words(buffer)
    same = np.ones(len(order) - 1, bool)
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # adjacent common prefix of 50 bytes or more
        eight = word[order + at]
        same &= eight[1:] == eight[:-1]
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.empty(len(buffer), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], heads), np.diff(np.append(heads, len(order))))
    at = np.flatnonzero(whole)
    least, owner = least[at], owner[at]
    heads = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
    first = at[heads] - firsts[owner[heads]]
    return owner[heads], first, first + np.diff(np.append(heads, len(at))), least[heads]


def may_repeat(segments: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Whether a window of each segment may stand in another one of the same key.

    A window holds the 16-byte string of its key, and 34 bytes more: 17 or more of them before that string or
    17 or more behind it. Segments with a window in common so agree in the 17 bytes on one side of some place
    where the string stands. Keys that were made by routing again stand nowhere; their segments all may.
    """
    sizes = np.array([len(s) for s in segments])
    buffer = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(sizes)
    hashed = _grams(buffer)
    at = np.flatnonzero(hashed == np.repeat(keys.view(np.uint64), sizes)[: len(hashed)])
    owner = np.searchsorted(ends, at, "right")
    inside = at + GRAM <= ends[owner]
    at, owner = at[inside], owner[inside]
    may = np.ones(len(segments), bool)
    may[owner] = False
    side = (LENGTH - GRAM) // 2
    eight = _eights(buffer, "<u8")
    before, behind = at - side >= (ends - sizes)[owner], at + GRAM + side <= ends[owner]
    held, value = [], []
    for some, first in ((before, at[before] - side), (behind, at[behind] + GRAM)):
        held.append(owner[some])
        value.append(_mixed(_mixed(eight[first], eight[first + 8]), eight[first + side - 8]) + np.uint64(len(value)))
    held, value = np.concatenate(held), np.concatenate(value)
    value = _mixed(value, keys.view(np.uint64)[held])
    order = np.argsort(value)
    held, value = held[order], value[order]
    same = value[1:] == value[:-1]
    may[held[1:][same]] = True
    may[held[:-1][same]] = True
    return may


def lost_ranges(owner: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows in order, with adjacent ones of a segment as one."""
    apart = (owner[1:] != owner[:-1]) | (first[1:] != end[:-1])
    heads, tails = np.append(True, apart)[: len(owner)], np.append(apart, True)[: len(owner)]
    return owner[heads], first[heads], end[tails]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The id as it is and as a long (null, or not a number: the last), the text as bytes, and a hash that stands for the row."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).try_cast("long"), F.lit(LAST_ID)).alias("id"), raw.alias("text"))
    return texts.withColumn("row", F.xxhash64("id", "text"))


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed, to halve what their joins shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([packer.compress(t.as_py()) for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=b.schema.names)

    texts = texts.select("doc_id", "id", "row", "text")
    return texts.mapInArrow(run, texts.schema)


def _release(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, and with it the shuffle files on disk.

    The listeners of the session hold the last query until another one ends, hence the small query.
    A session without a JVM at hand leaves that to the server.
    """
    spark.range(1).count()
    gc.collect()
    if not type(spark).__module__.startswith("pyspark.sql.connect"):
        spark.sparkContext._jvm.System.gc()


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each text. Of a key in more than two texts of a batch, all but two are ``known`` to be shared."""
    for b in batches:
        keys, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        _, once = np.unique(b["row"].to_numpy(), return_index=True)  # equal rows have equal keys
        b = b.take(pa.array(once))
        for i, t in zip(b["row"].to_numpy(), b["text"], strict=True):
            if len(t := t.as_py()) >= LENGTH:
                keys.append(np.unique(window_runs(t)[0]))
                rows.append(np.full(len(keys[-1]), i))
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key)
        key, row = key[order], row[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        known = ~first & ~np.append(first[1:], True)[: len(key)]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(known)], names=["key", "row", "known"])


def _pass_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``key, row``, those whose key is known to be shared or has two rows or more; holds one row."""
    last_key, last_row, open_ = None, None, False
    for b in batches:
        known = b["known"]
        yield b.filter(known).select(["key", "row"])
        b = b.filter(pc.invert(known))
        keys, rows = b["key"].to_numpy(), b["row"].to_numpy()
        if not len(keys):
            continue
        if last_key is not None:
            keys, rows = np.append(last_key, keys), np.append(last_row, rows)
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        several = np.minimum.reduceat(rows, heads) != np.maximum.reduceat(rows, heads)
        if last_key is not None and open_:
            several[0] = True
        keep = several[group]
        passed = keep.copy()
        if last_key is not None and open_:
            passed[0] = False  # already passed with its own batch
        # a key that may go on: its last row is passed on later unless its key is open already
        open_ = bool(keep[-1])
        last_key, last_row = keys[-1], rows[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[passed]), pa.array(rows[passed])], names=["key", "row"])


#: ``more`` are the other places in the text where a segment that was routed again stands (null: none).
SEGMENTS = "key long, id long, row long, start int, size int, segment binary, more array<int>"


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        out = [[np.empty(0, np.int64)] for _ in range(5)]
        segments = []
        ends, wanted = b["keys"].offsets.to_numpy(), b["keys"].values.to_numpy()
        for i, row, t, low, high in zip(b["id"].to_numpy(), b["row"].to_numpy(), b["text"], ends[:-1], ends[1:], strict=True):
            t = unpacker.decompress(t.as_py())
            if len(t) < LENGTH:
                continue
            key, first, end = window_runs(t)
            own = np.sort(wanted[low:high])
            held = np.flatnonzero(own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key)
            n = len(held)
            for column, values in zip(out, (key[held], np.full(n, i), np.full(n, row), first[held], end[held] + LENGTH - 1 - first[held])):
                column.append(values)
            segments += [t[first[j] : end[j] + LENGTH - 1] for j in held]
        yield _segments(out, segments)


def _segments(columns: list[list[np.ndarray]], segments: list[bytes], more: list[np.ndarray | None] | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    numbers = [pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)]
    others = pa.nulls(len(segments), pa.list_(pa.int32())) if more is None else pa.array(more, pa.list_(pa.int32()))
    names = ["key", "id", "row", "start", "size", "segment", "more"]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(segments, pa.binary()), others], names=names)


def _route_again(by):
    """Segments cut into the runs of windows that share their key and the one that ``by`` gives.

    Equal runs of a segment are one row, so a text that repeats itself gives no more rows than it has different windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, size = b["key"].to_numpy(), b["size"].to_numpy().astype(np.int64)
            whole = b"".join(b["segment"].to_pylist())
            firsts = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(size)), size)
            # windows that reach into the next segment are dropped, and where one was a run ends
            at = np.flatnonzero(np.arange(len(whole)) + LENGTH <= (firsts + size)[owner])
            own = owner[at]
            again = _mixed(by(np.frombuffer(whole, np.uint8), key[owner])[at], key[own].view(np.uint64)).view(np.int64)
            first = np.flatnonzero(np.append(True, (again[1:] != again[:-1]) | (own[1:] != own[:-1])))
            last = np.append(first[1:], len(at)) - 1
            start, end, own, again = at[first], at[last] + LENGTH, own[first], again[first]
            places = [[s, *(m or ())] for s, m in zip(b["start"].to_pylist(), b["more"].to_pylist(), strict=True)]
            runs: dict[tuple[int, int, bytes], array] = {}
            for o, k, i, j, n in zip(own.tolist(), again.tolist(), start.tolist(), end.tolist(), (start - firsts[own]).tolist()):
                runs.setdefault((o, k, whole[i:j]), array("i")).extend([s + n for s in places[o]])
            own, again = (np.array([r[i] for r in runs], np.int64) for i in (0, 1))
            segments = [r[2] for r in runs]
            numbers = (again, b["id"].to_numpy()[own], b["row"].to_numpy()[own], np.array([s[0] for s in runs.values()]), np.array([len(s) for s in segments]))
            more = [np.array(s[1:]) if len(s) > 1 else None for s in runs.values()]
            yield _segments([[x] for x in numbers], segments, more)

    return run


def _hot_keys(segments: DataFrame, bound: int) -> DataFrame:
    """Keys whose different segments have more than ``bound`` bytes. Copies count only in a first, cheap choice."""
    some = segments.groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") > bound).select("key")
    once = segments.select("key", "mark", "size").join(some, "key", "left_semi").groupBy("key", "mark").agg(F.max("size").alias("size"))
    return once.groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") > bound).select("key")


def bounded_segments(segments: DataFrame, bound: int = HOT) -> DataFrame:
    """The same windows under keys whose different segments have at most ``bound`` bytes each."""
    done = []
    for by in (next_least, whole_window):
        hot = stored(_hot_keys(segments, bound), "suffix-hot")
        if hot.isEmpty():
            break
        done.append(segments.join(hot, "key", "left_anti"))
        cut = segments.join(hot, "key", "left_semi").select("key", "id", "row", "start", "size", "segment", "more").mapInArrow(_route_again(by), SEGMENTS)
        segments = stored(cut.withColumn("mark", F.xxhash64("segment")), "suffix-again")
    for part in done:
        segments = segments.unionByName(part)
    return segments


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal segments of a task as one row with their least and last id."""
    held: list[pa.Table] = []
    names = ["key", "segment", "least_id", "last_id"]

    def grouped() -> pa.Table:
        some = pa.concat_tables(held).group_by(["key", "segment"], use_threads=False)
        return some.aggregate([("least_id", "min"), ("last_id", "max")]).select(["key", "segment", "least_id_min", "last_id_max"]).rename_columns(names)

    for b in batches:
        held.append(pa.table([b["key"], b["segment"], b["id"], b["id"]], names=names))
        if full(held):
            held = [grouped()]
            if held[0].num_rows > MERGED // 2 or held[0].nbytes > MERGED_BYTES // 2:
                yield from held.pop().to_batches()
    if sum(map(len, held)):
        yield from grouped().to_batches()


def full(held: list[pa.Table]) -> bool:
    return sum(map(len, held)) > MERGED or sum(x.nbytes for x in held) > MERGED_BYTES


RANGES = "array<struct<from_: int, to_: int>>"
MARKS = f"key long, mark long, least_id long, others {RANGES}, all {RANGES}"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged segments sorted by key to the ranges of windows that have to go, one row for each segment.

    A window goes from the ids above its least one, and that is the segment's least id or a smaller one. So
    however many ids a segment meets there are two kinds of ranges: ``others`` are those that all ids but the
    segment's least lose, ``all`` those that it loses as well. Takes a block of whole keys at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def ranges(part: pa.Table) -> pa.RecordBatch:
        key, least_id, last = (part[c].to_numpy() for c in ("key", "least_id", "last_id"))
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(least_id, heads) < np.maximum.reduceat(last, heads)
        met = np.repeat(several, np.diff(np.append(heads, len(key))))  # one id alone, as copies are gone, loses nothing
        part = part.filter(pa.array(met))
        if len(part):
            met = may_repeat(part["segment"].to_pylist(), part["key"].to_numpy())
            part = part.filter(pc.or_(pa.array(met), pc.less(part["least_id"], part["last_id"])))
        key, mark, own, last = (part[c].to_numpy() for c in ("key", "mark", "least_id", "last_id"))
        owner, first, end, least = least_ids(part["segment"].to_pylist(), own)
        kinds = []
        for above in (last, own):
            lost = least < above[owner]
            kinds.append(lost_ranges(owner[lost], first[lost], end[lost]))
        some = np.unique(kinds[0][0])  # those of the other kind are among them
        columns = [pa.array(x[some]) for x in (key, mark, own)]
        for of, from_, to_ in kinds:
            spans = pa.StructArray.from_arrays([pa.array(from_, pa.int32()), pa.array(to_, pa.int32())], ["from_", "to_"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, some), len(of)), pa.int32()), spans))
        return pa.RecordBatch.from_arrays(columns, names=["key", "mark", "least_id", "others", "all"])

    for b in batches:
        held.append(b)
        size += b["segment"].nbytes
        if size > BLOCK:
            part = pa.Table.from_batches(held)
            keys = part["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield ranges(part.slice(0, cut))
                held = part.slice(cut).to_batches()
                size = sum(x["segment"].nbytes for x in held)
    if sum(map(len, held)):
        yield ranges(pa.Table.from_batches(held))


def _spans(segment: Column) -> Column:
    """Byte ranges that a text loses by one segment, at each of its places."""
    span = lambda at, x: F.struct((at + x["from_"]).alias("start"), (at + x["to_"] + LENGTH - 1).alias("end"))
    places = F.concat(F.array(segment["start"]), F.coalesce(segment["more"], F.array().cast("array<int>")))
    return F.flatten(F.transform(places, lambda at: F.transform(segment["lost"], lambda x: span(at, x))))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bound: int = HOT) -> DataFrame:
    """``id, row, copy, spans`` of the texts of which bytes have to go.

    ``copy`` marks texts that equal one of a smaller id, ``spans`` are the byte ranges of
    windows that start in a smaller id too; they may overlap.
    """
    spark = docs.sparkSession
    texts = _texts(docs, doc_id, text)
    digests = stored(texts.where(F.octet_length("text") >= LENGTH).select("id", "row", F.sha2("text", 256).alias("digest")), "suffix-digests")
    first = stored(digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "suffix-first")
    copies = stored(digests.join(first, "digest").where("first < id").select("id", "row").distinct(), "suffix-copies")
    emptied(digests, first)

    keyed = texts.select("row", "text").mapInArrow(_emit_keys, "key long, row long, known boolean")
    # rows that need not meet their key are spread by their own
    dealt = keyed.repartition(F.col("key"), F.when(F.col("known"), F.col("row"))).sortWithinPartitions("key", "row")
    shared = dealt.mapInArrow(_pass_shared, "key long, row long").groupBy("row").agg(F.collect_set("key").alias("keys"))
    wanted = stored(shared.join(copies.select("row"), "row", "left_anti"), "suffix-keys")
    _release(spark)
    cut = _packed(texts).join(wanted, "row").select("id", "row", "text", "keys").mapInArrow(_cut_segments, SEGMENTS)
    cut = stored(cut.withColumn("mark", F.xxhash64("segment")), "suffix-segments")
    emptied(wanted)
    _release(spark)
    segments = bounded_segments(cut, bound)
    merged = segments.select("key", "segment", "id").mapInArrow(_merge, "key long, segment binary, least_id long, last_id long").repartition("key")
    merged = merged.groupBy("key", "segment").agg(F.min("least_id").alias("least_id"), F.max("last_id").alias("last_id"))
    merged = merged.withColumn("mark", F.xxhash64("segment")).sortWithinPartitions("key")
    marks = stored(merged.mapInArrow(_mark, MARKS), "suffix-marks")
    _release(spark)
    found = segments.select("key", "mark", "id", "row", "start", "more").join(marks, ["key", "mark"])
    found = found.withColumn("lost", F.when(F.col("id") > F.col("least_id"), F.col("others")).otherwise(F.col("all"))).where("size(lost) > 0")
    # a set, as rows equal in id and text have the same spans
    spans = found.groupBy("id", "row").agg(F.collect_set(F.struct("start", "more", "lost")).alias("found"))
    spans = spans.select("id", "row", F.flatten(F.transform("found", _spans)).alias("spans"))
    both = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumns({"copy": F.lit(True), "spans": F.array().cast(spans.schema["spans"].dataType)}))
    out = stored(both.groupBy("id", "row").agg(F.max("copy").alias("copy"), F.flatten(F.collect_list("spans")).alias("spans")), "suffix-spans")
    emptied(cut, marks, copies)
    _release(spark)
    return out


def _subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for t, spans, copy in zip(b["text"], b["spans"].to_pylist(), b["copy"].to_pylist(), strict=True):
            t, kept, removed, n, at = unpacker.decompress(t.as_py()), hashlib.sha256(), 0, 0, 0
            if copy:
                spans = [{"start": 0, "end": len(t)}]
            for s in sorted(spans or [], key=lambda x: x["start"]):
                if s["start"] > at or n == 0:
                    kept.update(t[at : s["start"]])
                    n += 1
                    removed += s["end"] - s["start"]
                    at = s["end"]
                elif s["end"] > at:
                    removed += s["end"] - at
                    at = s["end"]
            kept.update(t[at:])
            out.append((len(t), removed, n, kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bound: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    A null text is empty. Ids are compared as longs; a null id, or one that is not a number, comes
    after all others with the greatest long and never makes another's text a repeat of such a row.
    Strings that repeat within one id, in one row or several, stay; repeated rows get equal
    results. Texts of any length are read whole, each by one task; other columns are ignored; no
    rows give no rows.
    """
    spans = repeats(docs, doc_id=doc_id, text=text, bound=bound)
    texts = _texts(docs, doc_id, text)
    marked = _packed(texts).join(spans, ["id", "row"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    own = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType)])
    counts = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return marked.mapInArrow(_subtract, T.StructType(own.fields + counts.fields))


@query("op3_suffix_repeats")
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
