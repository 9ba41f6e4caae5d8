"""Encoding whole texts through a bounded memo of their pieces.

A byte-level tokenizer's own pre-tokenization always breaks before a space between two characters
that are no white space, whatever stands around them.  So a text is cut there, each distinct piece is
encoded once while it is in the memo, and the ids are put together by array operations.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in the memo of one Python worker.  When it is full, it keeps those that came up again.
MEMO_PIECES = 300_000
#: Characters of text that one step takes; a longer text is a step of its own.
STEP_CHARS = 1 << 19
_BESIDE_SPACE = re.compile(r" \s|\s ")
#: White space other than the two kinds that nearly all texts have.
_RARE_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which a space may stand beside white space, for Arrow's patterns.
MAYBE_BESIDE = r"  |\n | \n|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def cut(text: str) -> list[str]:
    """The pieces of a text without the single spaces that separate them."""
    beside = "  " in text or "\n " in text or " \n" in text or (_RARE_SPACE.search(text) and _BESIDE_SPACE.search(text))
    return _CUT.split(text) if beside else text.split(" ")


def distinct(texts: pa.Array) -> tuple[list[str | tuple[str]], np.ndarray, np.ndarray]:
    """The distinct pieces of texts as ``Memo`` lists them, the place in them of each piece, and how many a text has."""
    beside = pc.match_substring_regex(texts, MAYBE_BESIDE).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~beside)), " ")
    if beside.any():
        odd = pa.array([cut(t) for t in texts.filter(pa.array(beside)).to_pylist()], lists.type)
        lists = pa.concat_arrays([lists, odd]).take(pa.array(np.argsort(np.argsort(beside, kind="stable"))))
    counts = pc.list_value_length(lists).to_numpy()
    first = np.cumsum(counts) - counts
    coded = lists.flatten().dictionary_encode()
    codes, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    used = np.flatnonzero(np.bincount(np.delete(codes, first), minlength=len(keys)))
    place = np.zeros(len(keys), dtype=np.int64)
    place[used] = np.arange(len(used))
    heads = [(keys[c],) for c in codes[first].tolist()]
    codes = place[codes]
    codes[first] = len(used) + np.arange(len(first))
    return [keys[c] for c in used.tolist()] + heads, codes, counts


class _Index(dict):
    """Numbers new keys in order, and lists them in ``new``."""

    def __missing__(self, key: str | tuple[str]) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Seen:
    """Ids of distinct keys, each encoded once while it is kept; ``encode`` gets the new ones in order and gives the
    numbers of their ids and all ids in order.  With more than ``limit`` keys it keeps those that came up again.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self) -> None:
        self.index = _Index()
        self.index.new = []
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts, self.lengths, self.hits = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))
        self.used = 0

    def _add(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Room for the newest ``len(lengths)`` pieces, whose ids are ``flat``."""
        stop, total = len(self.index), self.used + len(flat)
        while total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while stop > len(self.starts):
            self.starts, self.lengths, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths, self.hits))
        n = stop - len(lengths)
        self.ids[self.used : total] = flat
        self.lengths[n:stop], self.starts[n:stop], self.hits[n:stop] = lengths, self.used + np.cumsum(lengths) - lengths, 0
        self.used = total

    def _shrink(self) -> None:
        old, n = self.index, len(self.index)
        often = self.hits[:n] > 1
        if often.sum() > self.limit // 2:
            often &= self.hits[:n] > np.median(self.hits[:n][often])
        keep = np.flatnonzero(often)
        ids, starts, lengths = self.ids, self.starts[keep], self.lengths[keep]
        words = [k for k, good in zip(old, often.tolist(), strict=True) if good]
        self._empty()
        self.index.update(zip(words, range(len(words)), strict=True))
        self._add(lengths, ids[ranges(starts, lengths)])

    def encoded(self, keys: list, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of the keys, and all their ids in order; with ``codes`` of the keys at those places."""
        if len(self.index) > self.limit:
            self._shrink()
        index = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        if self.index.new:
            enabled = gc.isenabled()
            gc.disable()
            self._add(*self.encode(self.index.new))
            self.index.new = []
            if enabled:
                gc.enable()
        index = index if codes is None else index[codes]
        self.hits[: len(self.index)] += np.bincount(index, minlength=len(self.index))
        lengths = self.lengths[index]
        return lengths, self.ids[ranges(self.starts[index], lengths)]


class Memo(Seen):
    """``encode`` gets distinct pieces, each but a text's first with its leading space, and gives the
    numbers of their ids and all ids in order.

    The index has the pieces without that space; a text's first piece has a tuple around it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__(lambda keys: encode([" " + x if x.__class__ is str else x[0] for x in keys]), MEMO_PIECES)

    def texts(self, texts: list[str] | pa.StringArray) -> Iterator[np.ndarray]:
        """The ids (int32) of each text, in order; an array has no nulls."""
        a, size = 0, 0
        for b, n in enumerate(pc.binary_length(texts).to_pylist() if isinstance(texts, pa.Array) else map(len, texts)):
            if size and size + n > STEP_CHARS:
                yield from self._step(texts[a:b])
                a, size = b, 0
            size += n
        if a < len(texts):
            yield from self._step(texts[a:])

    def _step(self, texts: list[str] | pa.StringArray) -> Iterator[np.ndarray]:
        pieces: list[str | tuple[str]] = []
        counts, codes = [], None
        if isinstance(texts, pa.Array):
            pieces, codes, counts = distinct(texts)
        else:
            for text in texts:
                part = cut(text)
                part[0] = (part[0],)
                pieces += part
                counts.append(len(part))
        lengths, flat = self.encoded(pieces, codes)
        ends = np.cumsum(lengths)[np.cumsum(counts) - 1]
        place = 0
        for stop in ends.tolist():
            yield flat[place:stop]
            place = stop


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists, and their items in one array."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as often as its length says."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
