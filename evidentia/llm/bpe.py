"""Byte-level BPE by speculation and verification, and decoding.

A greedy longest match proposes the tokens of a word.  The proposal is the BPE encoding exactly when
every adjacent pair of its tokens is compatible, that is, when no merge across their border would
have come before the merges that built them.  All distinct pairs are tested at once on arrays; only
the words of a failing pair are merged exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memo, flattened
from .shared import mapped

# Fixed value: how byte-level pre-tokenization makes words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Documents of one step in a worker.
SLICE = 150


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable in
    Latin-1, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + n)] = b
    return out


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level files without normalizer and prefix space, whose words PATTERN makes")
        chars = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.made = np.array([c for _, _, c in merges], dtype=np.int64)
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for rank, (a, b, c) in reversed([*enumerate(merges)]):
            self.rank[c], self.left[c], self.right[c] = rank, a, b
        self.codes, self.code_ranks = np.unique(np.array([a * self.size + b for a, b, _ in merges], dtype=np.int64), return_index=True)
        self.one = np.zeros(256, dtype=np.int64)
        self.of: dict[bytes, int] = {}
        made = np.flatnonzero(self.rank >= 0)
        # a token that its own halves' borders would not let arise is never proposed
        whole = dict(zip(made.tolist(), self.compatible(self.left[made], self.right[made], self.rank[made]).tolist(), strict=True))
        for i in sorted((i for i in range(self.size) if self.bytes[i] and i not in self.special.values()), key=lambda i: self.rank[i]):
            if self.rank[i] < 0 and len(self.bytes[i]) == 1:
                self.one[self.bytes[i][0]] = i
                self.of[self.bytes[i]] = i
            elif self.rank[i] >= 0 and whole[i] and self.bytes[self.left[i]] in self.of and self.bytes[self.right[i]] in self.of:
                self.of[self.bytes[i]] = i
        self.prefixes = {t[:n] for t in self.of for n in range(1, len(t) + 1)}
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.openers = {t[0] for t in self.special if t}
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.failed = self.tested = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NONE) -> np.ndarray:
        """Whether no merge across the border of tokens a and b comes into play (before that rank).

        Going back in time, the later made of the two pieces at the border falls apart.  A merge of
        the two that stand there at one time wins if its rank is below that of the merge which took
        up the left piece, and not above that of the merge which took up the right piece (of equal
        merges the left one goes first).
        """
        x, y = a.copy(), b.copy()
        taken_x = np.broadcast_to(np.asarray(before, dtype=np.int64), x.shape).copy()
        taken_y = taken_x.copy()
        good = np.ones(len(x), dtype=bool)
        live = np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            r = self._ranks(p, q)
            bad = (r < taken_x[live]) & (r <= taken_y[live]) & (r < NONE) & ((r < before[live]) if isinstance(before, np.ndarray) else True)
            good[live[bad]] = False
            rp, rq = self.rank[p], self.rank[q]
            live, p, q, rp, rq = (v[~bad & ((rp >= 0) | (rq >= 0))] for v in (live, p, q, rp, rq))
            first = rp > rq
            i, j = live[first], live[~first]
            taken_x[i], x[i] = rp[first], self.right[p[first]]
            taken_y[j], y[j] = rq[~first], self.left[q[~first]]
        return good

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, prefixes, of = [], 0, len(word), self.prefixes, self.of
        while at < n:
            end, best, stop = at + 1, -1, at
            while end <= n and (part := word[at:end]) in prefixes:
                if (i := of.get(part, -1)) >= 0:
                    best, stop = i, end
                end += 1
            out.append(best)
            at = stop
        return out

    def _exact(self, words: list[bytes]) -> list[list[int]]:
        """Merge step by step: in each word all places of its lowest-ranked pair, left ones first."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ids, owner = self.one[np.frombuffer(b"".join(words), dtype=np.uint8)], np.repeat(np.arange(len(words)), counts)
        out: list[list[int]] = [[]] * len(words)
        while len(ids):
            ranks = self._ranks(ids[:-1], ids[1:])
            ranks[owner[1:] != owner[:-1]] = NONE
            ranks = np.append(ranks, NONE)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, len(ids))))
            ended = least[heads] == NONE
            for a, b in zip(heads[ended].tolist(), np.append(heads, len(ids))[1:][ended].tolist(), strict=True):
                out[int(owner[a])] = ids[a:b].tolist()
            at = np.flatnonzero((ranks == least) & (ranks < NONE))
            if len(at):  # of overlapping places every other one, from the left
                new = np.append(True, np.diff(at) != 1)
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
                ids[at] = self.made[ranks[at]]
            stay = least < NONE
            stay[at + 1] = False
            ids, owner = ids[stay], owner[stay]
        return out

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The encodings of words that pre-tokenization has made."""
        proposed = [self._greedy(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = np.unique(owner[inner[~self.compatible(codes // self.size, codes % self.size)[back]]])
        self.tested += len(words)
        self.failed += len(bad)
        for k, ids in zip(bad.tolist(), self._exact([words[k] for k in bad]), strict=True):
            proposed[k] = ids
        return proposed

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """The encodings of texts or parts of texts, special tokens in them taken as such."""
        split: list[list[str | int]] = []
        known: dict[str, int] = {}
        for piece in pieces:
            parts = self.specials.split(piece) if self.specials and not self.openers.isdisjoint(piece) else [piece]
            out: list[str | int] = []
            for part in parts:
                if part in self.special:
                    out.append(self.special[part])
                else:
                    for word in self.pattern.findall(part):
                        known.setdefault(word, len(known))
                        out.append(word)
            split.append(out)
        encoded = self.words([w.encode() for w in known])
        return [[i for w in ws for i in ([w] if isinstance(w, int) else encoded[known[w]])] for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


_memos: dict[str, tuple[BPE, Memo]] = {}


def memo(path: str) -> tuple[BPE, Memo]:
    """This Python worker's model and memo."""
    if path not in _memos:
        model = BPE(path)
        _memos[path] = model, Memo(lambda pieces: flattened(model.pieces(pieces)))
    return _memos[path]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = memo(path)
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: tuple[list, list, list] = ([], [], [])
            for ids in pieces.texts(texts):
                rows[0].append(len(ids))
                rows[1].append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows[2].append(sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = memo(path)
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            ids = list(pieces.texts([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids: array<int>) for every row of ``docs`` (doc_id, text); a null text is empty."""
    return mapped(_inputs(docs), _encoded(path), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text).

    The ids are those of the tokenizer file at ``path``; a special token's string in a text is that
    token.  Null texts count as empty; a null doc_id stays null; repeated rows give repeated rows;
    other columns are not looked at.
    """
    return mapped(_inputs(docs), _round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
