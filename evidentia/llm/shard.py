"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) enter bins in order of falling size; each goes to the fullest bin that
still takes it, found in a balanced search tree of the bins' remaining capacities.

Only sizes matter to the packing, so equal sizes are packed as a run: after one group the same bin is
the tightest still, and takes as many of the run as fit.  The driver therefore packs a summary:

* the groups of at least 1 / (shards * FINE) of all bytes or rows, of which there are at most
  2 * shards * FINE, one by one;
* all others by size class: exact sizes below 4096, and 64 classes for each power of two above, each
  with its count and its mean size; so the summary is bounded whatever the input.  What a bin gets of
  a class differs from the mean by at most a 64th a group, and groups of a class are dealt by hash, so
  the differences cancel out; each is under 1 / (64 * shards * FINE) of all bytes in any case.

The groups of a class are numbered (in hashed cells, with offsets), and the numbers tell their bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FINE = 200
#: Groups and rows of one numbering cell, about.
CELL_ROWS = 200_000


class CapacityTree:
    """A balanced binary search tree (a treap with fixed priorities) of (remaining, bin)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def add(self, key: tuple[float, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, hash((key[1], 0x9E3779B9)) & 0xFFFFFF, None, None]), high)

    def remove(self, key: tuple[float, int]) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def tightest(self, size: float) -> tuple[float, int] | None:
        """The bin of least remaining capacity that takes ``size``."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def roomiest(self) -> tuple[float, int]:
        node = self.root
        while node[3]:
            node = node[3]
        return node[0]

    def _split(self, node, key):
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def pack(runs: list[tuple[float, int]], capacity: float, bins: int | None = None) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing: for each run (size, count), in falling order of size, its (bin, count) parts.

    Without ``bins`` new bins of ``capacity`` open as needed, and a group above it gets one of its
    own.  With ``bins`` that many are open, and what fits nowhere goes to the roomiest.
    """
    tree, opened, out = CapacityTree(), 0, []
    for _ in range(bins or 0):
        tree.add((capacity, opened))
        opened += 1
    for size, count in runs:
        parts: list[tuple[int, int]] = []
        while count:
            spot = tree.tightest(size)
            if spot is None and bins is not None:
                spot, n = tree.roomiest(), 1
            elif spot is None:
                spot, n = (max(capacity, size), opened), 1
                tree.add(spot)
                opened += 1
            else:
                n = min(count, max(1, int(spot[0] // size))) if size > 0 else count
            tree.remove(spot)
            tree.add((spot[0] - n * size, spot[1]))
            parts.append((spot[1], n))
            count -= n
        out.append(parts)
    return out


def bins_needed(runs: list[tuple[float, int]], capacity: float) -> int:
    """How many bins of that capacity best-fit-decreasing opens."""
    return max((b for parts in pack(runs, capacity) for b, _ in parts), default=-1) + 1


def smallest_capacity(runs: list[tuple[float, int]], bins: int) -> float:
    """A capacity for which the runs fit into ``bins`` bins, close to the least.

    A group above an even share has a bin for itself; the others share what is left evenly, so the
    capacity is that of the even share of the rest.
    """
    total, left = sum(s * n for s, n in runs), bins
    for size, n in runs:
        while n and left > 1 and size * left > total:
            total, left, n = total - size, left - 1, n - 1
    low, more = total / left, 1e-7
    while bins_needed(runs, low * (1 + more)) > bins:
        more *= 1.5
    return low * (1 + more)


def _class(size: Column) -> Column:
    """Sizes below 4096 as they are, above it 64 classes for each power of two; ascending."""
    power = F.floor(F.log2(size.cast("double"))).cast("int")
    wide = 4096 + (power - 12) * 64 + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 64).cast("long")
    return F.when(size < 4096, size).otherwise(wide).cast("long")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    The law is ``bytes``: groups of equal texts stay together, and the shards' sizes are as near
    equal as that lets them be.  A row's size is the UTF-8 bytes of its text (null: none) plus 8.
    Null texts are a group of their own, apart from empty ones.  Slots number a shard's rows without
    gaps; repeated rows get slots of their own.  Other columns are not looked at.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
        text.isNull().alias("g0"),
    )
    group = ["g0", "g1", "g2"]
    rows = stored(rows, "rows")
    groups = rows.groupBy(*group).agg(F.count("*").alias("k"), F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("class", _class(F.col("bytes"))), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("k").alias("k"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    is_large = (F.col("bytes") * (shards * FINE) >= total.bytes) | (F.col("k") * (shards * FINE) >= total.k)
    large = groups.where(is_large).select(*group, "bytes").orderBy(F.desc("bytes"), *group).collect()
    small = groups.where(~is_large)
    classes = small.groupBy("class").agg(F.count("*").alias("n"), F.avg("bytes").alias("mean")).collect()
    runs = sorted([(float(r.bytes), 1, ("large", k)) for k, r in enumerate(large)] + [(r.mean, r.n, ("class", r["class"])) for r in classes], key=lambda r: (-r[0], r[2]))
    sizes = [r[:2] for r in runs]
    bins = pack(sizes, smallest_capacity(sizes, shards), shards)

    spark = docs.sparkSession
    spans, alone = [], []
    for (_, _, (kind, which)), parts in zip(runs, bins, strict=True):
        if kind == "large":
            alone.append((*[large[which][g] for g in group], parts[0][0]))
            continue
        a = 0
        for b, n in parts:
            spans.append((which, a, a + n, b))
            a += n
    # both tables are bounded as the summary is
    spans_df = F.broadcast(spark.createDataFrame(spans, "class long, a long, b long, shard int"))
    alone_df = F.broadcast(spark.createDataFrame(alone, "g0 boolean, g1 long, g2 long, shard int"))
    cells = max(1, total.n // CELL_ROWS)
    numbered = _numbered(small.withColumn("cell", F.pmod(F.col("g2"), F.lit(cells))), ["class"], ["g1", "g2", "g0"], "nth")
    placed = numbered.join(spans_df, "class").where("nth >= a and nth < b").select(*group, "shard")
    out = rows.join(alone_df, group, "left").withColumnRenamed("shard", "s1")
    rest = out.where("s1 is null").drop("s1").join(placed, group)
    out = out.where("s1 is not null").withColumnRenamed("s1", "shard").unionByName(rest)
    out = out.withColumn("cell", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(max(1, total.k // (shards * CELL_ROWS)))))
    out = _numbered(out, ["shard"], ["doc_id", "g1", "g2", "g0"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 0 without gaps within ``by``, counted cell by cell so that no group is one task."""
    counts = df.groupBy(*by, "cell").agg(F.count("*").alias("in_cell"))
    before = F.coalesce(F.sum("in_cell").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "cell", before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order)) - 1
    return df.withColumn("own", own).join(counts, [*by, "cell"]).withColumn(name, (F.col("before") + F.col("own")).cast("long")).drop("own", "before", "cell")
