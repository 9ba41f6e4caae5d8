"""Language identification by nearest centroids of TF-IDF weighted character n-grams.

A text is the counts of its hashed byte n-grams (one to four bytes of lowered words), dampened by a
logarithm, weighted by IDF and normalised.  Each language has several centroids, found by spherical
k-means over its sampled texts; the nearest centroid by cosine tells the language.  A text whose
cosine stays below its language's bound is rejected as too far from all that was learned.  Cosines
grow with the number of distinct n-grams, so a language has a bound for each such size: a share of
a low quantile over all rows that may be learned from, each held against centroids that were fitted
on the other half of the sample.

The centroids are fitted on at most ``per_language`` sampled texts of each language, chosen by a hash
of the id; features are computed on the executors over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, mapped

BITS = 12
DIMENSIONS = 1 << BITS
#: Bytes of one vectorised step; a longer text goes through several.
STEP = 1 << 19
UNDETERMINED = "und"
#: Sizes by distinct n-grams, two to a doubling.
SIZES = 2 * BITS + 1
#: A bound is BOUND_SHARE of this quantile, over at least BOUND_ROWS rows of its size or smaller ones.
BOUND_QUANTILE, BOUND_SHARE, BOUND_ROWS = 0.002, 0.8, 20
#: Steps of a cosine from 0 to 1 when they are counted.
COSINE_STEPS = 1000
#: Bytes as they count: ASCII other than letters is a space, and runs of spaces are one.
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)
_FOLD = {n: (0x9E3779B1 * (2 * n + 1)) & 0xFFFFFFFF for n in range(1, 5)}


def _counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = LETTERS[np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for a in range(0, len(raw), STEP):
        part = raw[max(0, a - 3) : a + STEP].astype(np.uint32)
        new = a - max(0, a - 3)
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, 5):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            slots = (code * np.uint32(_FOLD[n])) >> np.uint32(32 - BITS)
            out += np.bincount(slots[max(0, new - n + 1) :], minlength=DIMENSIONS)
    return out


def _dampened(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts.astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    bound: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best cosine in each language, and the size, of texts with a letter."""
        counts = np.stack([_counts(t) for t in texts])
        x = _dampened(counts) * self.idf
        cosines = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ self.centroids.T
        best = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        return best, (2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and whether the text is rejected, for texts with a letter."""
        best, size = self.nearest(texts)
        top = best.argmax(axis=1)
        weights = np.exp((best - best.max(axis=1, keepdims=True)) * 40)
        score = weights.max(axis=1) / weights.sum(axis=1)
        rejected = best.max(axis=1) < self.bound[top, size]
        return [self.languages[k] for k in top], score.astype(float), rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic."""
    centres = [x.mean(axis=0)]
    nearest = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [(lang, half, _counts(t)) for lang, half, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "half", "text")), strict=True) if has_letter(t)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in kept]), pa.array([h for _, h, _ in kept], pa.int32()), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, _, c in kept], pa.binary())], ["lang", "half", "counts"])


def _centroids(x: np.ndarray, langs: np.ndarray, idf: np.ndarray, clusters: int) -> Model:
    """A model that rejects nothing yet."""
    names = sorted(set(langs.tolist()))
    parts = [_clusters(x[langs == n], clusters) for n in names]
    return Model(names, idf, np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(names)), [len(c) for c in parts]), np.zeros((len(names), SIZES)))


def _measured(shared):
    """Language, size and cosine in steps of each row, by the model of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = [(h, t) for h, t in zip(*(batch.column(c).slice(a, 64).to_pylist() for c in ("half", "text")), strict=True) if has_letter(t)]
                for half, model in enumerate(models):
                    if texts := [t for h, t in rows if h == half]:
                        best, size = model.nearest(texts)
                        steps = (best.max(axis=1).clip(0, 1) * COSINE_STEPS).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([model.languages[k] for k in best.argmax(axis=1)]), pa.array(size, pa.int32()), pa.array(steps)], ["lang", "size", "step"])

    return run


def _quantile(seen: np.ndarray) -> float:
    """The low quantile of cosines that are counted by steps."""
    return float(np.searchsorted(np.cumsum(seen), max(1, BOUND_QUANTILE * seen.sum()))) / COSINE_STEPS


def _bounds(seen: np.ndarray) -> np.ndarray:
    """Bounds by size from counts by size and step; 0 where too few texts are as small."""
    out = np.zeros(SIZES)
    for size in range(SIZES):
        for least in range(size, -1, -1):
            window = seen[least : size + 1].sum(axis=0)
            if window.sum() >= BOUND_ROWS:
                out[size] = BOUND_SHARE * _quantile(window)
                break
    return out


def fit(labelled: DataFrame, per_language: int = 800, clusters: int = 4) -> Model | None:
    """Fit on rows (doc_id, text, lang) with both text and lang; None if no row has a letter."""
    labelled = labelled.where("text is not null and lang is not null")
    totals = {r.lang: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    key = F.xxhash64("doc_id", "text")
    rows = labelled.withColumn("half", F.pmod(F.shiftright(key, 20), F.lit(2)).cast("int"))
    chance = F.pmod(key, F.lit(1 << 20)) / float(1 << 20)
    sample = mapped(rows.where(chance < share).select("lang", "half", "text"), _sampled, "lang string, half int, counts binary").toArrow()
    if not sample.num_rows:
        return None
    order = sorted(range(sample.num_rows), key=lambda i: (sample["lang"][i].as_py(), sample["counts"][i].as_py()))
    sample = sample.take(order)
    langs, halves = np.array(sample["lang"].to_pylist()), np.array(sample["half"].to_pylist())
    x = _dampened(np.stack([np.frombuffer(b, dtype="<u2") for b in sample["counts"].to_pylist()]))
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    model = _centroids(x, langs, idf, clusters)
    others = [_centroids(x[halves != h], langs[halves != h], idf, clusters) if (halves != h).any() else model for h in (0, 1)]
    shared = labelled.sparkSession.sparkContext.broadcast(others)
    counted = mapped(rows.select("half", "text"), _measured(shared), "lang string, size int, step int").groupBy("lang", "size", "step").count().collect()
    seen = np.zeros((len(model.languages), SIZES, COSINE_STEPS + 1), dtype=np.int64)
    shared.destroy()
    for r in counted:
        seen[model.languages.index(r["lang"]), r["size"], r["step"]] += r["count"]
    # where a language has too few rows of a size, the bound over all languages holds
    every = _bounds(seen.sum(axis=0))
    model.bound = np.stack([np.where(own > 0, own, every) for own in map(_bounds, seen)])
    del sample, x, others, seen
    give_back()
    return model


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                if some and model:
                    found, scores[some], rejected[some] = model.predict([texts[i] for i in some])
                    for i, lang in zip(some, found, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rows.schema.names if c != "text"], pa.array(langs), pa.array(scores), pa.array(rejected)], [*[c for c in rows.schema.names if c != "text"], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0 and rejected, and so is every text
    without a model (nothing to learn from).  Repeated rows give repeated rows; other columns are not
    looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, rejected boolean")


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of doc_id as text is not 1 modulo 3."""
    return docs.where("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "text", "lang")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, any others) without the documents that are rejected.

    A text that is null or has no letter goes; where no language can be learned, all others stay.
    """
    model = fit(learnable(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.column("text").slice(a, 64).to_pylist()
                some = [i for i, t in enumerate(part) if t and has_letter(t)]
                if some:
                    rejected = shared.value.predict([part[i] for i in some])[2] if shared.value else [False] * len(some)
                    keep = [a + i for i, r in zip(some, rejected, strict=True) if not r]
                    yield batch.take(pa.array(keep, pa.int64()))

    return mapped(docs, run, docs.schema)
