"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles.

The method is a prefix-filtered set join.  Shingles are ordered rare first; two sets that reach the
threshold share a shingle among their first ``n - ceil(t * n) + 1``, so only those are joined.  A pair
then passes the length filter, the positional filter and a suffix filter (a lower bound of the
Hamming distance from counts in fixed parts of the order) before its one exact verification.

Groups of copies, and of texts that lie around the threshold, don't expand into all pairs:

* documents with equal sets are one *node*;
* in each round a node is tested only with a leader of each of its prefix shingles: the node in which
  that shingle comes first, as few rarer ones stand before it in a text with few changes of its own.
  After the first round, a shingle has one leader in the component that is commonest there, and one
  outside of it, and only nodes of other components are tested with them;
* components are renewed after each round, and shingles whose nodes are all in one component leave.
  Rounds end when one finds no link or hardly lessens the pairs that are left, or when those are few;
* then all pairs of different components that still share a prefix shingle and pass the filters
  are tested.  Pairs inside a component need no test, as they change nothing in the result.  A pair
  is left out at a shingle when it also shares one of the ``RECALL`` shingles before it in both
  prefixes: it was taken there, or before, as nothing precedes the first that it shares.

So no link between different texts is lost, and the components are exact.  Nodes that stay apart are
the only ones whose pairs are counted in full, and of them only those that differ in so few shingles
that neither the positional filter nor the parity of ``SIGNATURE`` tells them apart.

Rarity is counted over all documents, exactly within blocks of shingles; what recurs in a block adds
to a table of fixed size (``RARITY_BITS``), which is the only
thing, with bitmaps of fixed size, that is broadcast.  Any total order gives the same result; the
counts keep shingles of common passages out of the prefixes.  The bitmaps only save shuffled rows:
the joins behind them are exact, also when a bitmap is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .shared import give_back, mapped, stored

RARITY_BITS = 22
#: Shingles that are counted exactly at a time, and how often one must occur among them to be counted
#: on; rarer ones are as good as unique there.
COUNTED, OFTEN = 2_000_000, 2
FILTER_BITS = 24
PARTS = 256
#: How many earlier prefix shingles a row carries to leave out pairs that were taken before.
RECALL = 12
#: Another round of leaders is worth its tables while so many pairs for each open row could be left, and the round
#: before left no more than so much of them: texts that share a common passage and nothing else stay apart in any round.
PAIRS_LEFT, PAIRS_KEPT = 64, 0.9
#: Ids of nodes that are broadcast to pick their rows; with more of them the same join shuffles.
BROADCAST_NODES = 400_000
#: Nodes that a task remembers, so as to ship the rows of copies once.
REMEMBERED = 100_000
#: Ranks from here on count alike when leaders are chosen.
MOST_RANK = (1 << 15) - 1
SIGNATURE = [f"s{k}" for k in range(16)]
U64 = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], width: int, name: str = "doc_id") -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids (or another column) and shingle sets, step by step."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            rows = batch.slice(k, 512)
            ids = rows.column(name).to_pylist()
            raw = [t.encode() if t is not None else b"" for t in rows.column("text").to_pylist()]
            for a, b in K.steps(raw):
                yield ids[a:b], list(K.shingles(*K.words(raw[a:b]), width))


def _node(s: np.ndarray) -> int:
    """The 64-bit identity of a set; with its size it stands for the set."""
    return int(K.mix(np.array([np.sum(K.mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64) + U64(len(s))]))[0].astype(np.int64))


def _parts(s: np.ndarray) -> bytes:
    """How many shingles lie in each of PARTS equal ranges of the order, 255 at most."""
    return np.minimum(np.bincount((s >> U64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _parity(s: np.ndarray) -> np.ndarray:
    """64 bits for each column of SIGNATURE, each the parity of the number of shingles in its part of the order: two sets differ in
    at least as many shingles as these differ in bits."""
    size = 64 * len(SIGNATURE)
    bits = np.bincount(((s >> U64(20)) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS places with those of column ``key`` set; gathered as whole words."""
    slot = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[np.array(found.column("word"), dtype=np.int64)] = np.array(found.column("bits"), dtype=np.int64)
    return out


def _set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & ((1 << FILTER_BITS) - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def _profile(width: int):
    """Rows of kind 0 for documents (doc_id, node, n, parts, key), and of kind 1 for rarity (slot, count)."""

    names = ["kind", "a", "b", "n", "parts", "key", *SIGNATURE]

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        slots, counts = (tokens[counts >= OFTEN] >> U64(64 - RARITY_BITS)).astype(np.int64), counts[counts >= OFTEN]
        for a in range(0, len(slots), 50_000):
            k = len(slots[a : a + 50_000])
            zero = pa.array(np.zeros(k, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, dtype=np.int32)), pa.array(slots[a : a + k]), pa.array(counts[a : a + k].astype(np.int64)), zero, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), *[zero] * len(SIGNATURE)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for named, sets in _sets(batches, width, "named"):
            held += [s for s in sets if len(s)]
            k = len(named)
            columns = [pa.array([0] * k, pa.int32()), pa.array([x["doc_id"] for x in named], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_parts(s) for s in sets], pa.binary()), pa.array([x["key"] for x in named], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in np.array([_parity(s) for s in sets]).reshape(-1, len(SIGNATURE)).T.copy()]], names)
            if sum(map(len, held)) > COUNTED:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    return run


def _prefixes(width: int, num: int, den: int, rarity, only=None):
    """Rows (token, key), see ``_key``.  With a bitmap ``only``, rows (token, node, place) of the tokens whose place in it is
    set: place is n * 2**32 + the token's rank in the rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = rarity.value, set()
        for _, sets in _sets(batches, width):
            tokens, keys, nodes, places = [], [], [], []
            if len(done) > REMEMBERED:
                done.clear()
            for s in sets:
                node, n = _node(s), len(s)
                if n == 0 or (node, n) in done:
                    continue
                done.add((node, n))
                take = n - -(-num * n // den) + 1
                common = counts[(s >> U64(64 - RARITY_BITS)).astype(np.int64)]
                first = s[np.argsort(common, kind="stable")[:take]].astype(np.int64)
                if only is None:
                    keys.append((np.minimum(np.arange(take), MOST_RANK) << 48) | ((node >> 16) & ((1 << 48) - 1)))
                else:
                    rank = np.flatnonzero(_set(only.value, first))
                    first = first[rank]
                    nodes.append(np.full(len(rank), node, dtype=np.int64))
                    places.append((n << 32) + rank)
                tokens.append(first)
            if tokens and only is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(keys))], ["token", "key"])
            elif tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, places)], ["token", "node", "place"])

    return run


def _wanted(width: int, bitmap):
    """Rows (node, n, tokens) of the documents whose ids' places in the bitmap are set; ids that are
    null always count as set."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            keep = _set(bitmap.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            if keep.any():
                yield batch.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(picked(batches), width):
            if sets := [s for s in sets if len(s)]:
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return run


def _close(num: int, den: int):
    """The suffix filter: the ranges' counts bound the Hamming distance of two sets from below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("pu", "pv"))
                total = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
                near = (total - np.abs(one - two).sum(axis=1)) * (num + den) >= 2 * num * total
                yield batch.filter(pa.array(near)).drop_columns(["pu", "pv"])

    return run


def _size(place: Column) -> Column:
    return F.shiftright(place, 32)


def _rank(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def _key(node: Column, place: Column) -> Column:
    """Orders the nodes of a token by its rank in them, then by their hashes."""
    rank = F.least(_rank(place), F.lit(MOST_RANK))
    return F.shiftleft(rank, 48).bitwiseOR(F.shiftrightunsigned(node, 16))


def _apart(one: str, two: str, total: Column, num: int, den: int) -> Column:
    """Whether the parities tell two sets apart that have ``total`` shingles together."""
    differ = sum((F.bit_count(F.col(f"{one}{c}").bitwiseXOR(F.col(f"{two}{c}"))) for c in SIGNATURE), F.lit(0))
    return (total - differ) * (num + den) < total * (2 * num)


def _may_link(p: Column, q: Column, num: int, den: int) -> Column:
    """The length and the positional filter for two places of one shared token.

    Sets that must share m tokens have a common one among the first ``size - m + 1`` of each, so a
    pair counts only at such tokens."""
    a, b, i, j = _size(p), _size(q), _rank(p), _rank(q)
    bound = F.least(F.least(i, j) + 1 + F.least(a - 1 - i, b - 1 - j), a - i, b - j)
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (bound * (num + den) >= (a + b) * num)


def _picked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``rows`` those of the given nodes (distinct, stored)."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (u, v), which are stored, those that link, each tested once."""
    nodes = _picked(nodes, stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends"))
    left = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("parts").alias("pu"), F.col("doc_id").alias("du"), *[F.col(c).alias(f"l{c}") for c in SIGNATURE])
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("parts").alias("pv"), F.col("doc_id").alias("dv"), *[F.col(c).alias(f"r{c}") for c in SIGNATURE])
    pairs = pairs.join(left, "u").join(right, "v").where(~_apart("l", "r", F.col("nu") + F.col("nv"), num, den)).select("u", "v", "nu", "nv", "du", "dv", "pu", "pv")
    pairs = stored(mapped(pairs, _close(num, den), "u long, v long, nu long, nv long, du long, dv long"), "pairs")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs.select(F.explode(F.array("du", "dv")).alias("key")).where("key is not null")))
    sets = stored(mapped(docs, _wanted(width, bitmap), "node long, n long, tokens array<long>"), "sets")
    one, two = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("s")), sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    linked = pairs.join(one, ["u", "nu"]).join(two, ["v", "nv"]).where(shared * (num + den) >= (F.col("nu") + F.col("nv")) * num)
    links = stored(linked.select("u", "v").distinct(), "links")
    bitmap.destroy()
    return links


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``parts`` (node, component) after more links (u, v)."""
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    parts = stored(parts.unionByName(ends.join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))), "known")
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    joined = links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    higher = stored(connected_components(stored(joined, "joined")).select(F.col("node").alias("component"), F.col("component").alias("top")), "higher")
    return stored(parts.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of tokens that nodes of different components share, each with the component that is commonest there."""
    inside = members.join(parts, "node", "left").select("token", "node", "place", F.coalesce("component", "node").alias("component"))
    per = inside.groupBy("token", "component").agg(F.count("*").alias("k"))
    major = per.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count("*").alias("kinds"), F.sum("k").alias("rows"), F.max("k").alias("most"))
    return stored(inside.join(major.where("kinds > 1").drop("kinds"), "token"), "open")


def _pairs(one: str, two: str) -> list[Column]:
    return [F.greatest(one, two).alias("u"), F.least(one, two).alias("v")]


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``width``-word
    shingles; ``component_id`` is the smallest doc_id that links reach.  A text of fewer words is one
    shingle.  Null, empty or blank texts have no shingles and link with nothing: their component is
    their own doc_id.  Rows with a null doc_id take part and get the component of their group (null
    if nobody else is in it).  Repeated rows give repeated rows.  Other columns are not looked at.
    """
    return jaccard_classes(docs, F.lit(None), width, num, den).select("doc_id", "n_shingles", "component_id")


def jaccard_classes(docs: DataFrame, key: Column, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``jaccard_components`` with ``key``, a binary expression over ``docs`` that names a row whatever its doc_id, and
    ``class``, a number that the rows of one component alone have (null without shingles)."""
    spark = docs.sparkSession
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), key.cast("binary").alias("key")).alias("named"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(mapped(keyed, _profile(width), "kind int, a long, b long, n long, parts binary, key binary, " + ", ".join(f"{c} long" for c in SIGNATURE)), "profile")
    rows = profile.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n", "parts", "key", *SIGNATURE)
    counts = np.zeros(1 << RARITY_BITS, dtype=np.int32)
    slots = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).toArrow()
    counts[np.array(slots.column("a"), dtype=np.int64)] = np.minimum(np.array(slots.column("b"), dtype=np.int64), 1 << 30)
    rarity = spark.sparkContext.broadcast(counts)

    leaders = mapped(docs, _prefixes(width, num, den, rarity), "token long, key long").groupBy("token").agg(F.min("key").alias("lead"), F.max("key").alias("last"), F.count("*").alias("k")).where("lead <> last")
    # a token with two rows has nothing to say after round one
    leaders = stored(leaders.select("token", "lead", (F.col("k") > 2).alias("more")), "leaders")
    shared_tokens = spark.sparkContext.broadcast(_bitmap(leaders.select(F.col("token").alias("key"))))
    members = mapped(docs, _prefixes(width, num, den, rarity, shared_tokens), "token long, node long, place long")
    members = stored(members.join(leaders, "token").distinct(), "members")
    shared_tokens.destroy()
    rarity.destroy()
    del counts, slots
    give_back()
    nodes = rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"), *[F.first(c).alias(c) for c in SIGNATURE])
    nodes = stored(nodes, "nodes")

    # round one: every node with the leaders of its tokens
    leads = _key(F.col("node"), F.col("place")) == F.col("lead")
    led = members.where(leads).select("token", F.col("node").alias("leader"), F.col("place").alias("lead_place"))
    tested = members.join(led, "token").where((F.col("node") != F.col("leader")) & _may_link(F.col("place"), F.col("lead_place"), num, den))
    tested = stored(tested.select(*_pairs("node", "leader")).distinct(), "first")
    parts = stored(connected_components(_verified(tested, docs, nodes, width, num, den)), "components")

    # more rounds, with the other nodes only
    members = members.where(~leads & F.col("more")).select("token", "node", "place")
    before = float("inf")
    while True:
        open_ = _open(members, parts)
        left = open_.select("token", "rows", "most").distinct().agg(F.sum("rows").alias("rows"), F.sum((F.col("rows") - F.col("most")) * F.col("rows").cast("double")).alias("pairs")).first()
        if not left["rows"] or left["pairs"] <= PAIRS_LEFT * left["rows"] or left["pairs"] > PAIRS_KEPT * before:
            break
        before = left["pairs"]
        key = _key(F.col("node"), F.col("place"))
        inner = F.col("component") == F.col("major")
        chosen = open_.groupBy("token").agg(F.min(F.when(inner, key)).alias("in_key"), F.min(F.when(~inner, key)).alias("out_key"))
        led = open_.join(chosen, "token").where((key == F.col("in_key")) | (key == F.col("out_key")))
        led = led.select("token", F.col("node").alias("leader"), F.col("place").alias("lead_place"), F.col("component").alias("lead_component"))
        more = open_.join(led, "token").where((F.col("component") != F.col("lead_component")) & _may_link(F.col("place"), F.col("lead_place"), num, den))
        more = stored(more.select(*_pairs("node", "leader")).distinct().join(tested, ["u", "v"], "left_anti"), "more")
        tested = tested.unionByName(more)
        links = _verified(more, docs, nodes, width, num, den)
        if links.isEmpty():
            break
        parts = _merged(parts, links)

    # what is left: all pairs of different components
    earlier = F.collect_list("token").over(Window.partitionBy("node").orderBy("place").rowsBetween(-RECALL, -1))
    still = _picked(nodes.select("node", *SIGNATURE), stored(open_.select("node").distinct(), "still-open"))
    open_ = stored(open_.withColumn("earlier", earlier).join(still, "node"), "last")
    one, two = open_.where("component <> major").alias("x"), open_.alias("y")
    other = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.node") < F.col("y.node")))
    other = other & ~_apart("x.", "y.", _size(F.col("x.place")) + _size(F.col("y.place")), num, den)
    last = one.join(two, (F.col("x.token") == F.col("y.token")) & other & _may_link(F.col("x.place"), F.col("y.place"), num, den) & ~F.arrays_overlap("x.earlier", "y.earlier"))
    last = stored(last.select(*_pairs("x.node", "y.node")).distinct().join(tested, ["u", "v"], "left_anti"), "last-pairs")
    parts = _merged(parts, _verified(last, docs, nodes, width, num, den))

    where = nodes.join(parts, "node", "left").select("node", "n", F.coalesce("component", "node").alias("class"), "doc_id")
    # written, so that a class with many nodes is an ordinary skewed side of the join
    least = stored(where.groupBy("class").agg(F.min("doc_id").alias("component_id")), "classes")
    where = where.join(least, "class").select("node", "n", "component_id", "class")
    out = rows.where("n > 0").join(where, ["node", "n"]).select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "class")
    return out.unionByName(rows.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class")))
