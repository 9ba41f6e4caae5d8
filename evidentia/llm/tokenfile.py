"""Token ids in Parquet files: list columns with dictionary encoding, bounded row groups, page indexes.

One row is one document: doc_id, part (the file's number), local_start (ids before it in its file),
n_tokens and ids.  Files and the rows in them ascend by doc_id.  Small columns and ids are separate
column chunks with page indexes, so that lengths and offsets are read without the ids, and the ids of
a range of documents without the other row groups.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import Memo, Seen, flattened, ranges
from .shared import mapped, shared_dir

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: Pieces that the library encodes in one call.
JOINED = 2000
#: Distinct words that a Python worker remembers beside its pieces, and words whose merges the library makes in one text.
MEMO_WORDS, MERGED = 500_000, 32
#: The words that byte-level pre-tokenization makes of a piece of ASCII without apostrophes and control characters and of the
#: letters of Latin-1; whatever else is in a piece is not found.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n(?=[!-&(-~À-ÖØ-öø-ÿ])")

_memos: dict[str, Memo] = {}


class Library:
    """The tokenizers library over distinct pieces.

    A piece of plain words is cut into them as the file's own pre-tokenizer does (``WORD``), and each distinct word is merged
    once while it is remembered: the library's model gets words with a byte between them that no merge has, so that none goes
    across it.  All other pieces, and those of files that are not plain byte-level BPE, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import byte_characters

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        chars = byte_characters()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.lengths = np.array([len(added[i]) if i in added else sum(c in chars for c in self.tokenizer.id_to_token(i)) for i in range(size)], dtype=np.int64)
        self.added = [t.decode() for t in added.values()]
        self.characters = {b: c for c, b in chars.items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        # an added token that begins like a word could go across the end of one
        plain = plain and not any(t[0].isspace() or t[0].isalnum() for t in self.added) and self.characters[0] in model["vocab"]
        self.plain = plain and not any(self.characters[0] in "".join(m) for m in model["merges"])
        if self.plain:
            self.merger, self.between = Tokenizer(self.tokenizer.model), self.tokenizer.model.token_to_id(self.characters[0])
        self.words = Seen(self._merged, MEMO_WORDS)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of the pieces, and their ids."""
        if not self.plain:
            return self._whole(pieces)
        words = list(map(WORD.findall, pieces))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(counts)
        known = _sums(np.fromiter(map(len, chain.from_iterable(words)), np.int64, int(counts.sum())), ends, counts) == np.fromiter(map(len, pieces), np.int64, len(pieces))
        every = "\0".join(pieces)
        if found := [t for t in self.added if t in every]:
            known &= np.array([not any(t in p for t in found) for p in pieces])
        if known.all():
            return self._of_words(words, counts)
        rest = self._whole([pieces[i] for i in np.flatnonzero(~known)])
        return _interleaved(known, self._of_words([words[i] for i in np.flatnonzero(known)], counts[known]), rest)

    def _of_words(self, words: list[list[str]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat = self.words.encoded(list(chain.from_iterable(words)))
        return _sums(lengths, np.cumsum(counts), counts), flat

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's merges of words that its pre-tokenizer would make."""
        between = self.characters[0]
        spelled = "\0".join(words).encode().decode("latin-1").translate(self.characters).split(between)
        texts = [between.join(spelled[a : a + MERGED]) + between for a in range(0, len(spelled), MERGED)]
        _, flat = flattened([e.ids for e in self.merger.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.between)
        if len(ends) != len(words):
            raise ValueError("a merge went across the end of a word")
        return np.diff(ends, prepend=-1) - 1, np.delete(flat, ends)

    def _whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as they are.

        Those that begin with a space and end without white space keep their borders when they are
        joined, so many of them are encoded as one text; the tokens' lengths tell where a piece ends.
        """
        plain = np.fromiter((len(p) > 1 and p[0] == " " and p[1] > " " and not (p[-1].isspace() or p[1].isspace()) for p in pieces), bool, len(pieces))
        alone = [p for p, joins in zip(pieces, plain.tolist(), strict=True) if not joins]
        joined = [p for p, joins in zip(pieces, plain.tolist(), strict=True) if joins]
        groups = [joined[a : a + JOINED] for a in range(0, len(joined), JOINED)]
        parts, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(group) for group in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.int32)
            sizes = [len(p) if p.isascii() else len(p.encode()) for p in group]
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
            parts.append(ids)
            counts.append(np.diff(stops, prepend=0))
        rest = flattened([e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)])
        return _interleaved(plain, (np.concatenate(counts), np.concatenate(parts)), rest)


def _sums(values: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values``, of which there are ``counts``; a run may be empty."""
    until = np.concatenate(([0], np.cumsum(values)))
    return until[ends] - until[ends - counts]


def _interleaved(first: np.ndarray, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids in order, of which ``one`` has those where ``first`` is true and ``other`` the rest."""
    lengths, starts = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    lengths[first], lengths[~first] = one[0], other[0]
    both = np.concatenate((one[0], other[0]))
    starts[np.concatenate((np.flatnonzero(first), np.flatnonzero(~first)))] = np.cumsum(both) - both
    return lengths, np.concatenate((one[1], other[1]))[ranges(starts, lengths)]


def _memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(Library(path))
    return _memos[path]


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, start = _memo(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                ids = list(memo.texts(pc.fill_null(rows.column("text"), "")))
                lengths = np.array([len(i) + 1 for i in ids], dtype=np.int64)
                ends = np.cumsum(lengths)
                flat = np.full(int(ends[-1]), end_id, dtype=np.int32)
                inner = np.ones(len(flat), dtype=bool)
                inner[ends - 1] = False
                flat[inner] = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                columns = [rows.column("doc_id"), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write the files to the new folder ``target``.

    ``end_id`` follows each document's ids.  Null texts are empty; a null doc_id sorts first; rows of
    one doc_id follow each other by text; without rows there are files without rows, or none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    out = mapped(ordered, _encoded(path, end_id), SCHEMA)
    # the writer keeps column and offset indexes of every page by default
    out.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20).parquet(target)


def _digests(offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.value
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            starts = [before[p] + s for p, s in zip(batch.column("part").to_pylist(), batch.column("local_start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, target: str, ids: tuple[int, int] | None = None, slices: tuple[int, int] | None = None) -> DataFrame:
    """The rows of the files; with ``ids`` those of documents from the first to the last id, both included.

    Files and rows ascend by doc_id, so row groups and pages outside of the range are skipped by their
    statistics.  With ``slices`` each row has only the tokens from the first to before the last place.
    What is not selected afterwards (the ids, say) is not read.
    """
    rows = spark.read.schema(SCHEMA).parquet(target)
    if ids is not None:
        rows = rows.where(F.col("doc_id").between(*ids))
    if slices is not None:
        start, stop = slices
        rows = rows.withColumn("ids", F.slice("ids", start + 1, max(0, stop - start)))
    return rows


def documents_at(spark: SparkSession, target: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that have one of the tokens ``first`` to before ``last`` of all.

    The files' lengths tell which of them hold the range, and the lengths in those which documents; only then are ids read, of
    the row groups and pages of those files that can hold these documents.
    """
    starts = file_starts(spark, target)
    order = sorted(starts, key=starts.get)
    ends = {p: starts[q] for p, q in zip(order, order[1:])}
    parts = {p: starts[p] for p in order if starts[p] < last and ends.get(p, last + first + 1) > first}
    before = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("part")) if parts else F.lit(0)
    rows = read_tokens(spark, target).where(F.col("part").isin(list(parts))).withColumn("start", (before + F.col("local_start")).cast("long"))
    inside = (F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first)
    found = rows.where(inside).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("unnamed")).first()
    near = F.lit(False) if found["low"] is None else F.col("doc_id").between(found["low"], found["high"])
    if found["unnamed"]:
        near = near | F.col("doc_id").isNull()
    return rows.where(near & inside).select("doc_id", "start", "n_tokens", "ids")


def file_starts(spark: SparkSession, target: str) -> dict[int, int]:
    """For each file's number the ids in the files before it; reads two small columns only."""
    sizes = sorted((r.part, r.n) for r in read_tokens(spark, target).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    out, total = {}, 0
    for part, n in sizes:
        out[part] = total
        total += n
    return out


def token_digests(docs: DataFrame, path: str, end_id: int, target: str | None = None) -> DataFrame:
    """Write the token files, read them back: (doc_id, start, n_tokens, ids_crc32) per document.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the crc32 of its ids as
    little-endian unsigned 32-bit integers.  The cases of ``write_tokens`` hold.
    """
    spark = docs.sparkSession
    own = target is None
    target = target or f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, target, path, end_id)
    if own:
        place = spark._jvm.org.apache.hadoop.fs.Path(target)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    offsets = spark.sparkContext.broadcast(file_starts(spark, target))
    return mapped(read_tokens(spark, target), _digests(offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")
