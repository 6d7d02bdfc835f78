"""Language of words and texts by a linear-chain conditional random field.

A word's features are its letter n-grams, its affixes (n-grams that include the word's edge)
and the word itself (the lexicon), all hashed into weight tables. Learned transitions tie
neighbouring words together, and forward-backward gives every word its probability for each
language, so a passage in another language inside a text is labelled as such. The text's
language is the one with the largest sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import id_bucket, query, table

#: Texts that the model is fitted on, dealt evenly to the languages, but so many of each language
#: at least, if it has them; and the longest of them in characters.
SAMPLE, LEAST_EACH, MAX_SAMPLE_CHARS = 600, 25, 20_000
#: Languages that are learned at most, the most frequent: so the driver holds at most
#: max(SAMPLE, LABELS * LEAST_EACH) texts and the broadcast 3 * 2 ** BITS * LABELS weights.
LABELS = 64
#: Of the texts of a training step so many hundredths are followed by the half of another text.
SWITCHED = 25
EPOCHS, RATE, DECAY = 5, 0.25, 1e-5
BITS = 15
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Letters of texts that one round of forward-backward takes together.
ROUND = 1_500_000
_POWERS = np.cumprod(np.full(64, 2654435761, np.uint64)).astype(np.uint32)


@dataclass
class Words:
    """Words of several texts in one buffer: hashed n-grams, lexicon hashes and text lengths."""

    grams: list[np.ndarray]
    valid: list[np.ndarray]
    starts: np.ndarray
    lexicon: np.ndarray
    lengths: np.ndarray

    def word_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.grams[0]))))


def split_words(text: str | None) -> list[str]:
    """Lower-case words; a text without a letter (numbers and signs that only look like words) has none."""
    return WORD.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def read_words(texts: list[str | None]) -> Words:
    listed = [split_words(t) for t in texts]
    lengths = np.array([len(w) for w in listed], np.int64)
    joined = b" ".join(" ".join(w).encode() for w in listed if w)
    letters = np.frombuffer(b" " + joined + b"   ", np.uint8).astype(np.uint32)
    n = len(letters) - 3
    space = letters == 32
    three = letters[:n] * np.uint32(0x9E3779B1) ^ letters[1 : n + 1] * np.uint32(0x85EBCA77) ^ letters[2 : n + 2] * np.uint32(0xC2B2AE3D)
    four = (three ^ (three >> np.uint32(13))) * np.uint32(0x27D4EB2F) ^ letters[3 : n + 3] * np.uint32(0x165667B1)
    inner = ~space[1 : n + 1]
    # an n-gram starts inside its word or on the space before it
    starts = np.flatnonzero(space[: n - 1] & ~space[1:n]) if lengths.sum() else np.empty(0, np.int64)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if len(starts) else np.zeros(n, np.int64)
    whole = np.add.reduceat(letters[:n] * _POWERS[np.minimum(at, 63)], starts, dtype=np.uint32) if len(starts) else np.empty(0, np.uint32)
    mix = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int32)
    return Words([mix(three), mix(four)], [inner, inner & ~space[2 : n + 2]], starts, mix(whole), lengths)


@dataclass
class Model:
    """Weights of three feature tables (two n-gram sizes and the lexicon) and transitions."""

    labels: list[str]
    tables: list[np.ndarray]
    moves: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        out = self.tables[2][words.lexicon]
        for grams, valid, weights in zip(words.grams, words.valid, self.tables[:2], strict=True):
            out = out + np.add.reduceat(weights[grams] * valid[:, None].astype(np.float32), words.starts, axis=0)
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's label probabilities and the expected number of moves between labels.

        All texts advance together, one word a step; the longest come first, so those that
        still have a word are always a prefix.
        """
        emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        moves = np.exp(self.moves - self.moves.max())
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) and sizes[0] else []
        ahead, back, pairs = np.empty_like(emit), np.ones_like(emit), np.zeros_like(moves)
        state = None
        for t, n in enumerate(alive):
            at = first[:n] + t
            state = emit[at] if state is None else (state[:n] @ moves) * emit[at]
            state = state / state.sum(axis=1, keepdims=True)
            ahead[at] = state
        for t in range(len(alive) - 1, 0, -1):
            at = first[: alive[t]] + t
            after = emit[at] * back[at]
            joint = ahead[at - 1][:, :, None] * moves[None] * after[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            before = after @ moves.T
            back[at - 1] = before / before.sum(axis=1, keepdims=True)
        both = ahead * back
        return both / both.sum(axis=1, keepdims=True) if len(both) else both, pairs

    def label_words(self, text: str | None) -> list[tuple[str, str]]:
        """The words of a text, lower-cased, each with its likeliest language."""
        words = read_words([text])
        best = self.marginals(self.emissions(words), words.lengths)[0].argmax(axis=1) if len(words.starts) else []
        return [(w, self.labels[k]) for w, k in zip(split_words(text), best, strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = read_words(texts)
        share = np.zeros((len(texts), len(self.labels)))
        if len(words.starts) and self.labels:
            each, _ = self.marginals(self.emissions(words), words.lengths)
            filled = np.flatnonzero(words.lengths)
            share[filled] = np.add.reduceat(each, (np.cumsum(words.lengths) - words.lengths)[filled], axis=0)
        whole = share.sum(axis=1)
        best = share.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        named = [self.labels[k] if w > 0 else UNKNOWN for k, w in zip(best, whole, strict=True)]
        top = share.max(axis=1, initial=0.0)
        return named, np.clip(np.where(whole > 0, top / np.where(whole > 0, whole, 1), 0.0), 0.0, 1.0)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Maximise the likelihood of texts whose words all carry the text's label (Adagrad).

    Some texts of a step are cut in the middle and go on with the second half of another one, so
    that moves from each language to the others are learned from text that switches.
    """
    labels = sorted(set(langs))
    k = len(labels)
    model = Model(labels, [np.zeros((1 << BITS, k), np.float32) for _ in range(3)], np.zeros((k, k), np.float32))
    sums = [np.full_like(x, 1e-3) for x in (*model.tables, model.moves)]
    truth = np.array([labels.index(x) for x in langs])
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(texts))
        for i in range(0, len(order), 40):
            chosen = order[i : i + 40]
            listed = [split_words(texts[j]) for j in chosen]
            runs = [[(truth[j], len(w))] for j, w in zip(chosen, listed, strict=True)]
            for at in range(0, len(chosen) * SWITCHED // 100):
                other = len(chosen) - 1 - at
                head, tail = listed[at][: (len(listed[at]) + 1) // 2], listed[other][len(listed[other]) // 2 :]
                listed[at], runs[at] = head + tail, [(truth[chosen[at]], len(head)), (truth[chosen[other]], len(tail))]
            words = read_words([" ".join(w) for w in listed])
            if not len(words.starts):
                continue
            each, pairs = model.marginals(model.emissions(words), words.lengths)
            said = np.concatenate([np.repeat([label for label, _ in r], [n for _, n in r]) for r in runs])
            slope = -each
            slope[np.arange(len(said)), said] += 1
            grads = []
            owner = words.word_of()
            for grams, valid in zip(words.grams, words.valid, strict=True):
                by = slope[owner[valid]]
                grads.append(np.stack([np.bincount(grams[valid], by[:, c], 1 << BITS) for c in range(k)], axis=1))
            grads.append(np.stack([np.bincount(words.lexicon, slope[:, c], 1 << BITS) for c in range(k)], axis=1))
            seen = np.zeros((k, k))
            inside = np.ones(len(said), bool)  # a word that no other of its text comes before has no move
            inside[(np.cumsum(words.lengths) - words.lengths)[words.lengths > 0]] = False
            at = np.flatnonzero(inside)
            np.add.at(seen, (said[at - 1], said[at]), 1)
            grads.append(seen - pairs)
            for table_, total, grad in zip((*model.tables, model.moves), sums, grads, strict=True):
                step = grad / len(said) - DECAY * table_
                total += step * step
                table_ += (RATE * step / np.sqrt(total)).astype(np.float32)
    return model


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on whole texts of every language, in each those with the least hashes of id and text.

    Each of ``k`` languages gives at most ``max(sample // k, LEAST_EACH)`` texts, however rare it
    is. Of more than ``LABELS`` languages the most frequent are learned, ties by name; the others'
    texts are given one of these. Longer texts than ``MAX_SAMPLE_CHARS`` are not chosen, which bounds what the driver holds.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.length(text) <= MAX_SAMPLE_CHARS))
    hashed = usable.select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counted = hashed.groupBy("l").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("n"))
    sizes = {r["l"]: r["n"] for r in counted.orderBy(F.desc("rows"), "l").limit(LABELS).collect()}
    if not sizes:
        return train([], [])
    each = max(sample // len(sizes), LEAST_EACH)
    below = lambda cuts: F.col("h") <= F.get(F.array(*map(F.lit, cuts.values())), F.array_position(F.array(*map(F.lit, cuts)), F.col("l")).cast("int") - 1)
    # hashes first, so that no task sends many more texts than are chosen; a few times as many as
    # are wanted lie below a share of all hashes that follows from the language's size
    share = {name: min(1.0, (4 * each + 40) / max(n, 1)) for name, n in sizes.items()}
    hashed = hashed.where(F.col("l").isin(list(sizes)))
    likely = hashed.where(below({name: min(int(s * 2**64) - 2**63, 2**63 - 1) for name, s in share.items()}))
    found: dict[str, list[int]] = {name: [] for name in sizes}
    for r in likely.select("l", "h").distinct().collect():
        found[r["l"]].append(r["h"])
    cuts = {name: sorted(hashes)[:each][-1] for name, hashes in found.items() if hashes}
    rows = hashed.where(below(cuts)).groupBy("h", "l").agg(F.min("t").alias("t")).orderBy("h", "l").collect()
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def detect(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the text's language and its share of the words.

    A null text or one without a letter is ``und`` with score 0, and so is every text if
    nothing could be learned. Of languages with equal shares the first by name counts. Texts of
    any length are read whole, the longest as one sequence in one task. Repeated rows get equal
    results; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def rounds(texts: list[str | None]) -> Iterator[list[str | None]]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size > ROUND:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(**sent.value)
        for b in batches:
            names, scores = [], [np.empty(0)]
            for texts in rounds(b["text"].to_pylist()):
                name, top = fitted.predict(texts)
                names += name
                scores.append(top)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


@query("op4_language_crf")
def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(F.col("doc_id"), 4) == 2
    found = detect(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
