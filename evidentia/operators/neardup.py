"""Documents whose sets of content words are alike, without pairs of equal sets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import words as W
from evidentia.functions.storage import release, scratch, written

# From which Jaccard similarity on a pair is a warning, and an error.
WARN, FAIL = 0.70, 0.85
#: Words that a task remembers, and rows that it takes at a time.
KEPT, ROWS = 1 << 18, 500
#: Parities of a set's words by parts of their hashes, 64 in a column, and how many columns stand in for all in a first look.
SIGNATURE, FOLDED = [f"s{k}" for k in range(16)], 4
#: Words whose order is that of their frequency, at most; all others come before them.
FREQUENT = 1 << 17
#: Words of sets in a block, a task holding two of them; blocks that there are in any case, but of so many classes at least.
BLOCK_WORDS, BLOCKS, LEAST_BLOCK = 12_000_000, 12, 500
#: Pairs that a task takes at a time.
PAIRS = 1 << 21
#: What rounding may take from a bound.
SLACK = 1e-9


def _sets(docs: DataFrame, unnamed: bool) -> DataFrame:
    """(doc_id, node, n, codes) of each document with content words, the distinct words of more than three characters.

    ``node`` stands for the set, ``n`` is its size and ``codes`` are its words' hashes in order.  Documents without an id come out if ``unnamed``.
    """
    word, kept, step = W.WORD.encode()[:-1] + b"{4,}", KEPT, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(word)

        @lru_cache(kept)
        def code(w: bytes) -> int:
            return int.from_bytes(md5(w).digest()[:8], "little", signed=True)

        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            which, nodes, sets = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if found := set(pattern.findall(text)):
                    which.append(i)
                    sets.append(np.sort(np.fromiter(map(code, found), np.int64, len(found))))
                    nodes.append(int.from_bytes(md5(sets[-1].tobytes()).digest()[:8], "little", signed=True))
            if not which:
                continue
            sizes = [len(s) for s in sets]
            codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), codes], ["doc_id", "node", "n", "codes"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where("text is not null" if unnamed else "text is not null and doc_id is not null")
    return rows.select("doc_id", F.lower("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, node long, n long, codes array<long>")


def _frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, in order, of the words that most ``classes`` have, and their places by frequency from 1 on."""
    counted = classes.select(F.explode("codes").alias("code")).groupBy("code").count().where("count > 1")
    counts = written(counted.withColumn("level", F.floor(8 * F.log2("count")).cast("int")), "words")
    cut, room = None, FREQUENT
    for level, many in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        if (room := room - many) < 0:
            break
        cut = level
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    most = counts.where(F.col("level") >= cut).select("code", "count").toArrow()
    code, count = (most.column(c).to_numpy() for c in ("code", "count"))
    places = np.empty(len(code), np.int32)
    places[np.lexsort((code, count))] = np.arange(1, len(code) + 1)
    order = np.argsort(code)
    return code[order], places[order]


def _prefixes(classes: DataFrame, least: float) -> DataFrame:
    """(node, n, own, SIGNATURE, rare) of ``classes`` (node, n, own, codes).

    ``rare`` are the words, rarest first, of which a set shares one with any similar set that is no larger, as parts of their hashes.
    """
    size, step, signature = 64 * len(SIGNATURE), ROWS, SIGNATURE
    shared = classes.sparkSession.sparkContext.broadcast(_frequent(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            sizes, flat = batch.column("n").to_numpy(), batch.column("codes").flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            odd = np.bincount(row * size + (flat & (size - 1)), minlength=len(sizes) * size).astype(np.uint8) & 1
            signs = np.packbits(odd.reshape(-1, size), axis=1).view(np.int64)
            place = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                place = np.where(known[at] == flat, places[at], 0)
            flat = flat[np.argsort(row << 32 | place, kind="stable")]
            most = sizes - np.ceil(least * sizes - SLACK).astype(np.int64) + 1
            first = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most[row]
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array((flat[first] >> 32).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "n", "own")], *[pa.array(c) for c in signs.T.copy()], rare], ["node", "n", "own", *signature, "rare"])

    schema = "node long, n long, own long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", rare array<int>"
    return classes.select("node", "n", "own", "codes").mapInArrow(run, schema)


def _columns(rows: list[tuple[int, ...]], *names: str) -> pa.Table:
    return pa.table({name: pa.array([row[k] for row in rows], pa.int64()) for k, name in enumerate(names)})


def _placed(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``classes`` with ``own``, the block each is dealt to in the order of sizes, and (own, p, q) of the blocks p and q that may have similar sets."""
    sizes = sorted((r["n"], r["count"]) for r in classes.groupBy("n").count().collect())
    blocks = max(1, min(BLOCKS, sum(c for _, c in sizes) // LEAST_BLOCK))
    room = max(1, min(BLOCK_WORDS, -(-sum(n * c for n, c in sizes) // blocks)))
    ranges, dealt, filled = [], [], room
    for n, count in sizes:
        parts = -(-n * count // room)
        if parts > 1 or filled + n * count > room:
            ranges += [[n, n] for _ in range(parts)]
            filled = 0
        filled = room if parts > 1 else filled + n * count
        ranges[-1][1] = n
        dealt.append((n, len(ranges) - parts, parts))
    meet = [(p, q) for q, (low, _) in enumerate(ranges) for p in range(q + 1) if ranges[p][1] >= least * low - SLACK]
    spark = classes.sparkSession
    of = F.broadcast(spark.createDataFrame(_columns(dealt, "n", "first", "parts")))
    own = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = spark.createDataFrame(_columns(sorted({(b, p, q) for p, q in meet for b in (p, q)}), "own", "p", "q"))
    return classes.join(of, "n").withColumn("own", own).drop("first", "parts"), pairs


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """(u, v, p, q): the pairs of ``classes`` (node, n, codes), each once, that share a rare word and whose sizes and parities allow the similarity.

    Of two sets that are similar the larger has one of its rarest words among those of the smaller, and what comes after the first of
    these must suffice.  Two sets differ in at least as many words as their parities.  Classes are dealt into blocks of like sizes and
    bounded words, and each two blocks that may have a pair, p and q, are compared in one task.
    """
    signature, folded, limit = SIGNATURE, FOLDED, PAIRS
    share, both = (1 - least) / (1 + least), least / (1 + least)
    classes, meet = _placed(classes, least)
    rows = _prefixes(classes, least).join(F.broadcast(meet), "own")

    def distinct(pair: np.ndarray) -> np.ndarray:
        """What np.unique gives, which hashes and takes many times as long."""
        pair = np.sort(pair)
        return pair[np.diff(pair, prepend=-1) != 0]

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        rows = rows.sort_by("n")
        of, n, node = (rows.column(c).to_numpy() for c in ("own", "n", "node"))
        signs = np.stack([rows.column(s).to_numpy() for s in signature], axis=1).view(np.uint64)
        short = np.bitwise_xor.reduce(signs.reshape(len(n), -1, folded), axis=1)
        rare = rows.column("rare").combine_chunks()
        many = rare.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        word = rare.flatten().to_numpy().view(np.uint32).astype(np.int64) << 31
        # the largest size of a set that may be similar if this is the first word that it shares
        top = np.floor((n[row] - place) / both - n[row] + SLACK).astype(np.int64)
        held = np.flatnonzero((of[row] == p) & (top >= n[row]))
        held = held[np.argsort(word[held] | n[row[held]])]
        keys, theirs, tops = word[held] | n[row[held]], row[held], top[held]
        mine = np.flatnonzero(of[row] == q)
        mine = mine[np.argsort(word[mine] | n[row[mine]])]  # what is looked up comes in order, which is many times faster
        least_n = np.ceil(least * n[row[mine]] - SLACK).astype(np.int64)
        first = np.searchsorted(keys, word[mine] | least_n)
        last = np.searchsorted(keys, word[mine] | np.maximum(np.minimum(n[row[mine]], top[mine]), 0), side="right")
        mine, first, last = (x[last > first] for x in (mine, first, last))
        order = np.argsort(mine)
        mine, first, last = mine[order], first[order], last[order]
        bits = len(n).bit_length()
        ends, found, a = np.cumsum(last - first), [np.zeros(0, np.int64)], 0
        while a < len(mine):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
            step = (last - first)[a:b]
            x = np.repeat(row[mine[a:b]], step)
            at = np.arange(ends[b - 1] - done) + np.repeat(first[a:b] - (ends[a:b] - step - done), step)
            y = theirs[at]
            good = n[x] <= tops[at]
            if p == q:
                good &= y < x
            pair = distinct(x[good] << bits | y[good])
            for signed in (short, signs):
                x, y = pair >> bits, pair & ((1 << bits) - 1)
                pair = pair[np.bitwise_count(signed.take(x, 0) ^ signed.take(y, 0)).sum(axis=1, dtype=np.int64) <= (n[x] + n[y]) * share + SLACK]
            found.append(pair)
            a = b
        pair = distinct(np.concatenate(found))
        x, y = pair >> bits, pair & ((1 << bits) - 1)
        return pa.table({"u": node[x], "v": node[y], "p": np.full(len(x), p), "q": np.full(len(x), q)})

    return rows.groupBy("p", "q").applyInArrow(compared, "u long, v long, p long, q long")


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(x, y, jaccard) of the ``pairs`` (u, v, p, q) of ``sets`` (node, n, a, codes) that reach ``least``, exactly, ``x`` and ``y`` being their ``a``.

    A task takes the pairs of two blocks p and q; a set is shuffled once for each two that have a pair with it.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.col("p").alias("hp"), F.col("q").alias("hq")).distinct()

    def shared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        every = pairs.sort_by("u")
        v, (u, first) = every.column("v").to_numpy(), np.unique(every.column("u").to_numpy(), return_index=True)
        first = np.append(first, len(v))
        node, lists = sets.column("node").to_numpy(), sets.column("codes").combine_chunks()
        sizes = sets.column("n").to_numpy()
        known, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(sizes)
        by = np.argsort(node, kind="stable")
        at = lambda x: by[np.searchsorted(node[by], x)]
        found: list[list[np.ndarray]] = [[], [], []]
        mark, parts = np.zeros(len(known), np.int32), np.split(flat.astype(np.int32), ends[:-1])
        u, v = at(u), at(v)
        for k, x in enumerate(u):
            mine = parts[x]
            mark[mine] = 1
            for a in range(first[k], first[k + 1], 1000):
                y = v[a : min(a + 1000, first[k + 1])]
                many = sizes[y]
                common = np.add.reduceat(mark.take(np.concatenate([parts[i] for i in y.tolist()])), np.cumsum(many) - many)
                value = common / (sizes[x] + many - common)
                good = value >= least
                for out, part in zip(found, (np.full(int(good.sum()), x), y[good], value[good]), strict=True):
                    out.append(part)
            mark[mine] = 0
        x, y, value = (np.concatenate(f) if f else np.zeros(0, kind) for f, kind in zip(found, (np.int64, np.int64, float), strict=True))
        ids = sets.column("a")
        return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y)), "jaccard": value})

    held = sets.join(wanted, "node").groupBy("hp", "hq")
    kind = dict(sets.dtypes)["a"]
    return pairs.groupBy("p", "q").cogroup(held).applyInArrow(shared, f"x {kind}, y {kind}, jaccard double")


def similar(docs: DataFrame, least: float = WARN) -> DataFrame:
    """(a, b, jaccard) of ``docs`` (doc_id, text).

    Equal sets are one class: its smallest id is paired with each other member, with 1, and stands for
    the class in pairs with other classes.  Texts without content words are alike to nothing.  Classes that share a rare
    word meet by it and as signatures of fixed size; those that are left are compared exactly.
    """
    spark = docs.sparkSession
    with scratch(spark) as made:
        sets = written(_sets(docs.select("doc_id", "text"), False), "word-sets")
        kept = len(made)
        classes = written(sets.groupBy("node", "n").agg(F.min("doc_id").alias("a"), F.first("codes").alias("codes")), "classes")
        each = written(sets.select("doc_id", "node", "n"), "nodes")
        del sets, made[kept:]  # the words of classes stay, those of all documents go
    release(spark)
    members = each.join(classes.select("node", "n", "a"), ["node", "n"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    pairs = written(candidates(classes, least), "pairs")
    release(spark)
    tested = compared(pairs, classes, least).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    return members.unionByName(tested)
