"""Toxicity scores by a bidirectional gated recurrent network over words and their characters.

A word's input has two halves.  Its learned vector and the mean of the learned vectors of its
characters' n-grams (three to five bytes, with the word's ends) are tables by hashed slot, trained with
the network; they are the word input and the character input.  Beside them stands what the same
slots say about the label: shrunken log-odds, counted over all labelled documents that may be learned
from, so that words outside of the training sample also speak.  The network reads windows of
``WINDOW`` words, each half covered by the next, and attention pools a window; the highest window is
the document's score.

The log-odds come from one part of the learnable rows (crc32 of the id is 0 modulo 3), the network is
trained on a bounded sample of the other part (2 modulo 3), so that it sees inputs as unseen texts
have them.  All rows of that part that it was not trained on set the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .gru import AttentiveBiGRU
from .shared import mapped, stored

WINDOW, STRIDE = 32, 16
BITS = 18
#: Counted statistics of a word's slots, and the width of each learned vector.
COUNTED, LEARNED = 6, 4
WIDTH = COUNTED + 2 * LEARNED
#: Bytes of a window that may be trained on; longer ones have words that are no words.
TRAINED_BYTES = 1 << 14
#: Steps of a logit in which scores are counted for the threshold, and how far they are told apart.
FINE, FAR = 1000, 60
#: Windows that the network reads at a time.
BATCH = 4096
U64 = np.uint64
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
GRAMS = (3, 4, 5)


def _edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with a space after each, and where every word begins and ends."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = np.concatenate(([False], ~APART[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return buf, edge[0::2], edge[1::2]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slots of all distinct words, their n-gram slots with each word's first, which of the
    distinct words each word is, and where each text's words begin."""
    hashes, firsts = K.words(texts, APART)
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    slots = (distinct >> U64(64 - BITS)).astype(np.int64)
    if not len(distinct):
        return slots, np.zeros(0, np.int64), np.zeros(0, np.int64), back, firsts
    buf, starts, stops = _edges(texts)
    starts, lengths = starts[at], (stops - starts)[at]
    # each word once, between two marks
    ends = np.cumsum(lengths + 2)
    place = np.arange(int(ends[-1])) - np.repeat(ends - lengths - 2, lengths + 2)
    source = np.repeat(starts, lengths + 2) + place - 1
    own = np.repeat(lengths, lengths + 2)
    chars = np.where((place > 0) & (place <= own), K.LOWER[buf[np.clip(source, 0, len(buf) - 1)]], 1).astype(np.int64)
    codes, owners = [], []
    word = np.repeat(np.arange(len(at)), lengths + 2)
    code = K.BYTE_CODE[chars]
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * U64(K.BASE) + K.BYTE_CODE[chars[n - 1 :]]
        if n in GRAMS:
            good = word[: len(code)] == word[n - 1 :]
            codes.append((K.mix(code[good] + U64(n)) >> U64(64 - BITS)).astype(np.int64))
            owners.append(word[: len(code)][good])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return slots, np.concatenate(codes)[order], np.searchsorted(owner[order], np.arange(len(at))), back, firsts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, slot, toxic, clean): documents of each label that have the slot; kind 0 words, 1 n-grams;
    slot -1 counts the documents."""
    counts = np.zeros((2, 2, 1 << BITS), dtype=np.int64)
    docs = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            slots, grams, *_ = _grams([(text or "").encode()])
            counts[0, label, np.unique(slots)] += 1
            counts[1, label, np.unique(grams)] += 1
            docs[label] += 1
    names = ["kind", "slot", "toxic", "clean"]
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1], pa.int64()), pa.array(docs[1:]), pa.array(docs[:1])], names)
    for kind in range(2):
        some = np.flatnonzero(counts[kind].any(axis=0))
        for a in range(0, len(some), 50_000):
            part = some[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(counts[kind, 1, part]), pa.array(counts[kind, 0, part])], names)


@dataclass
class Model:
    word_odds: np.ndarray
    gram_odds: np.ndarray
    net: AttentiveBiGRU
    middle: float = 0.0
    slope: float = 1.0
    words: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, LEARNED), dtype=np.float32))
    grams: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, LEARNED), dtype=np.float32))

    def counted(self, slots: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What the label says of each distinct word."""
        x = np.zeros((len(slots), COUNTED), dtype=np.float32)
        if len(slots):
            own, odds = self.word_odds[slots], self.gram_odds[grams]
            counts = np.diff(np.append(begins, len(grams)))
            # a word of one byte has one n-gram, so none is without
            x[:, 0], x[:, 1] = own, own > 1
            x[:, 2] = np.maximum.reduceat(odds, begins)
            x[:, 3] = np.add.reduceat(odds, begins) / counts
            x[:, 4] = np.minimum.reduceat(odds, begins)
            x[:, 5] = np.add.reduceat((odds > 1).astype(np.float32), begins) / counts
        return x

    def inputs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The input of every word of the texts, with a row for no word at the end, and the firsts."""
        slots, grams, begins, back, firsts = _grams(texts)
        x = np.zeros((len(slots) + 1, WIDTH), dtype=np.float32)
        x[:-1, :COUNTED] = self.counted(slots, grams, begins)
        if len(slots):
            x[:-1, COUNTED : COUNTED + LEARNED] = self.words[slots]
            x[:-1, COUNTED + LEARNED :] = np.add.reduceat(self.grams[grams], begins) / np.diff(np.append(begins, len(grams)))[:, None]
        return x[np.append(back, len(slots))], firsts

    def windows(self, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of every window; the last one ends with the text."""
        counts = np.diff(firsts)
        n = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = firsts[owner] + np.minimum(k * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
        return start, np.minimum(counts[owner], WINDOW), owner

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Each text's highest window; a text without words has a low one."""
        x, firsts = self.inputs(texts)
        start, length, owner = self.windows(firsts)
        out = np.full(len(texts), self.middle - 6 / self.slope)
        projected = self.net.project(x)
        empty = len(x) - 1
        for a in range(0, len(start), BATCH):
            s, size = start[a : a + BATCH], length[a : a + BATCH]
            mask = np.arange(WINDOW) < size[:, None]
            index = np.where(mask, s[:, None] + np.arange(WINDOW), empty)
            value = self.net.logits({d: (lambda t, p=projected[d]: p[index[:, t]]) for d in "fb"}, mask)  # noqa: B023
            np.maximum.at(out, owner[a : a + BATCH], value)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.logits(texts) - self.middle) * self.slope + np.log(0.7 / 0.3), -30, 30)))


def _drawn(shared):
    """Windows to train on: of each document the most telling one, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                x, firsts = model.inputs([(text or "").encode()])
                start, length, _ = model.windows(firsts)
                if not len(start):
                    continue
                raw = (text or "").encode()
                _, begin, end = _edges([raw])
                peaks = np.array([x[s : s + n, [0, 2, 3]].max(axis=0).sum() + x[s : s + n, [1, 5]].sum() for s, n in zip(start, length, strict=True)])
                picks = {int(peaks.argmax())} | ({int(peaks.argmin()), len(peaks) // 2} if label == 0 else set())
                for i in sorted(picks):
                    a, b = int(begin[start[i]]), int(end[start[i] + length[i] - 1])
                    if b - a <= TRAINED_BYTES:
                        rows.append((label, raw[a:b]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["toxic", "window"])

    return run


class Vectors:
    """The learned vectors of the slots that some windows have; the inputs of those windows."""

    #: Pulls vectors of rare words back to nothing.
    decay = 1e-3

    def __init__(self, model: Model, windows: list[bytes], seed: int = 5):
        slots, grams, self.begins, back, firsts = _grams(windows)
        self.counted = model.counted(slots, grams, self.begins)
        self.word_slots, self.word = np.unique(slots, return_inverse=True)
        self.gram_slots, self.gram = np.unique(grams, return_inverse=True)
        self.sizes = np.diff(np.append(self.begins, len(grams)))
        self.length = np.diff(firsts)
        place = firsts[:-1, None] + np.arange(WINDOW)
        self.mask = np.arange(WINDOW) < self.length[:, None]
        self.index = np.where(self.mask, np.append(back, [0])[np.minimum(place, len(back))], len(slots))
        rng = np.random.default_rng(seed)
        self.p = {name: (0.05 * rng.standard_normal((len(of), LEARNED))).astype(np.float32) for name, of in (("words", self.word_slots), ("grams", self.gram_slots))}

    def _met(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of some windows, which of them each place has (the last is no word), the
        numbers of all their n-grams, and where each word's begin."""
        met, at = np.unique(self.index[chosen], return_inverse=True)
        if met[-1] == len(self.sizes):
            met = met[:-1]
        sizes = self.sizes[met]
        ends = np.cumsum(sizes)
        grams = np.repeat(self.begins[met] - ends + sizes, sizes) + np.arange(int(ends[-1]))
        return met, at.reshape(len(chosen), WINDOW), self.gram[grams], ends - sizes

    def of(self, chosen: np.ndarray) -> np.ndarray:
        met, at, grams, begins = self._met(chosen)
        x = np.zeros((len(met) + 1, WIDTH), dtype=np.float32)
        x[:-1, :COUNTED], x[:-1, COUNTED : COUNTED + LEARNED] = self.counted[met], self.p["words"][self.word[met]]
        x[:-1, COUNTED + LEARNED :] = np.add.reduceat(self.p["grams"][grams], begins) / self.sizes[met][:, None]
        return x[at]

    def back(self, chosen: np.ndarray, dx: np.ndarray) -> dict[str, np.ndarray]:
        met, at, grams, _ = self._met(chosen)
        summed = lambda at, values, n: np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1)
        each = summed(at.ravel(), dx.reshape(-1, WIDTH)[:, COUNTED:], len(met) + 1)[:-1]
        chars = np.repeat(each[:, LEARNED:] / self.sizes[met][:, None], self.sizes[met], axis=0)
        return {"words": summed(self.word[met], each[:, :LEARNED], len(self.word_slots)).astype(np.float32), "grams": summed(grams, chars, len(self.gram_slots)).astype(np.float32)}

    def put(self, model: Model) -> None:
        model.words[self.word_slots], model.grams[self.gram_slots] = self.p["words"], self.p["grams"]


def _rated(shared, keep: list[str], final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in K.steps(raw):
                values = (model.scores if final else model.logits)(raw[a:b])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in keep], pa.array(values.astype(float))], [*keep, "score"])

    return run


@dataclass
class Steps:
    """The lowest score of each step that has rows, in order, and how many rows of each label it has."""

    least: np.ndarray
    clean: np.ndarray
    toxic: np.ndarray


def _steps(rows: DataFrame, model: Model) -> Steps:
    """Counts of ``rows`` (text, toxic) by score; what comes back has a bound, as steps end at ``FAR``."""
    rated = mapped(rows.select("text", "toxic"), _rated(rows.sparkSession.sparkContext.broadcast(model), ["toxic"], False), "toxic int, score double")
    step = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("score"))) * FINE)
    found = rated.groupBy(step.alias("step")).agg(F.min("score").alias("least"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).toArrow().sort_by("least")
    return Steps(*(found.column(c).to_numpy() for c in ("least", "clean", "toxic")))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None without both labels in
    both parts.  Of several labels of one document the highest counts.

    Rows whose crc32 of the id is 1 modulo 3 are never learned from.  ``per_label`` bounds the sample
    that trains the network, for each label; the threshold comes from all rows of that part that the network has not seen.
    """
    spark = docs.sparkSession
    part = F.expr("crc32(cast(doc_id as string)) % 3")
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("part", part).where("part <> 1")
    # each side is cut down before the join, which never broadcasts, as neither side has a bound
    texts = docs.select("doc_id", "text").where("text is not null").withColumn("of", part)
    known = texts.where("of = 0").join(labels.where("part = 0").hint("merge"), "doc_id")
    counted = mapped(known.select("text", "toxic"), _counted, "kind int, slot long, toxic long, clean long")
    counted = counted.groupBy("kind", "slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    kind, slot, toxic, clean = (np.array(counted.column(c), dtype=np.int64) for c in ("kind", "slot", "toxic", "clean"))
    n_toxic, n_clean = int(toxic[slot < 0].sum()), int(clean[slot < 0].sum())
    if not n_toxic or not n_clean:
        return None
    base, prior = n_toxic / (n_toxic + n_clean), 6.0
    odds = np.zeros((2, 1 << BITS), dtype=np.float32)
    p = (toxic + prior * base) / (toxic + clean + prior)
    own = slot >= 0
    odds[kind[own], slot[own]] = (np.log(p / (1 - p)) - np.log(base / (1 - base)))[own]
    model = Model(odds[0], odds[1], AttentiveBiGRU(WIDTH))

    totals = {r.toxic: r["n"] for r in labels.where("part = 2").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, F.lit(per_label / max(1, totals.get(1, 0)))).otherwise(F.lit(per_label / max(1, totals.get(0, 0))))
    most = max([per_label / n for n in totals.values() if n], default=0.0)
    some = texts.where("of = 2").where(chance < most)
    sample = stored(some.join(labels.where("part = 2").hint("merge"), "doc_id").where(chance < share).select("doc_id", "text", "toxic"), "sample")
    third = F.pmod(F.shiftright(F.xxhash64("doc_id"), 24), F.lit(3)) == 0
    drawn = mapped(sample.where(~third), _drawn(spark.sparkContext.broadcast(model)), "toxic int, window binary").toArrow()
    raw = sorted(zip(drawn.column("toxic").to_pylist(), drawn.column("window").to_pylist(), strict=True))
    y = np.array([r[0] for r in raw], dtype=np.float32)
    if not y.any() or y.all():
        return None
    vectors = Vectors(model, [r[1] for r in raw])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    model.net.train(vectors, vectors.mask, y, weight * len(y))
    vectors.put(model)

    # the threshold comes from all rows of the part that the network has not seen, counted by steps of the score
    unseen = texts.where("of = 2").join(labels.where("part = 2").hint("merge"), "doc_id").where(third | (chance >= share))
    counts = _steps(unseen, model)
    if not counts.toxic.any() or not counts.clean.any():
        counts = _steps(sample, model)
    n = np.stack([counts.clean, counts.toxic])
    # the value of a step's lowest score is its place in the grid, so a threshold between two steps parts their rows
    grid, at_least = counts.least, np.cumsum(n[:, ::-1], axis=1)[:, ::-1] / np.maximum(1, n.sum(axis=1, keepdims=True))
    alarms, recall = at_least
    # an alarm on a clean document counts ten times a miss
    good = recall - 10 * alarms
    best = np.flatnonzero(good >= good.max() - 1e-9)
    model.middle = float((grid[best[0]] + grid[max(0, best[0] - 1)]) / 2)
    # both labels weigh alike, as there are far more clean rows
    weights = (n / np.maximum(1, n.sum(axis=1, keepdims=True))).mean(axis=0)
    mean = (weights * grid).sum()
    model.slope = float(1.5 / max(0.25, np.sqrt((weights * (grid - mean) ** 2).sum())))
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); 0 to 1, higher is more toxic.

    Null and empty texts and texts without a word have a score near 0; without a model (nothing to
    learn from) every score is 0.  Repeated rows give repeated rows; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return mapped(docs, _rated(docs.sparkSession.sparkContext.broadcast(model), ["doc_id"], True), "doc_id long, score double")
