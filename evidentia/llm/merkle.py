"""A Merkle manifest of a dataset, kept as a node store in level-partitioned Parquet.

Every tree of the manifest (one for each ``tree`` value) has its leaves in order; runs of ``FAN``
consecutive nodes become their parent.  The store holds *runs*: one row is up to ``RUN`` consecutive
nodes of one level, found by its coordinate (tree, run).  A run is a whole number of families, so the
next level is computed by reading the rows of this one one after the other, without a shuffle; only
every third level, when a run has shrunk to one node, are nodes put together to new runs (one row for
each ``RUN`` of before).  No task holds more than some runs, and a level is an eighth of the one below.

Proofs go the other way.  The siblings of a run's top node on the way to the root are found once and
joined to the run below by coordinate, level by level in one merge, and each leaf's siblings inside
its run stand in that run.  So a leaf's proof costs no look-up of its own.

The roots of the trees are the leaves of one more tree, stored and proved the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.storage import owned

from .shared import ascii_lower, stored

#: Children of a node, levels that a run has before it is one node, and nodes of a run.
FAN, STEPS = 8, 3
RUN = FAN**STEPS
#: What a leaf covers in op11's contract.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(digests: Column) -> Column:
    """The next level of a run: digests of each FAN consecutive ones, fewer at the end."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int")), lambda g: F.sha2(_joined(F.slice(digests, g * FAN + 1, F.lit(FAN))), 256))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: 0 for a lone leaf."""
    steps = F.sequence(F.lit(1), F.lit(21))
    return F.size(F.filter(steps, lambda k: F.pow(F.lit(float(FAN)), (k - 1).cast("double")) < n))


def sorted_leaves(docs: DataFrame, tree: Column, order: list[str], payload: list[str]) -> DataFrame:
    """(tree, i, n, payload...): each row's place among the leaves of its tree, and how many those are.

    Rows are range-partitioned and sorted once and written; places follow from the partitions' counts,
    so no window sees all rows of a tree.  Equal rows follow each other in any order.
    """
    rows = docs.withColumn("tree", tree)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key only spreads rows that repeat
    spread = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", *order, "spread")
    ordered = spread.sortWithinPartitions("tree", *order, "spread").select("tree", *payload, F.monotonically_increasing_id().alias("at"))
    ordered = stored(ordered, "leaves").withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("tree", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"shift": F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first"), "n": F.sum("k").over(Window.partitionBy("tree"))})
    # one row for each partition of a tree; Spark broadcasts it while it is small
    return ordered.join(counts.select("tree", "part", "shift", "n"), ["tree", "part"]).select("tree", (F.col("at") + F.col("shift")).alias("i"), "n", *payload)


def _runs(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, n, run, digests, items): the nodes (tree, i, n, digest, payload...) put together to runs.

    ``items`` has the payload of each node, if there is any; i counts the nodes of one level of a tree."""
    each = nodes.select("tree", "n", F.floor(F.col("i") / RUN).cast("long").alias("run"), F.struct("i", "digest", *payload).alias("x"))
    rows = each.groupBy("tree", "n", "run").agg(F.array_sort(F.collect_list("x")).alias("items")).withColumn("digests", F.col("items.digest"))
    return rows if payload else rows.drop("items")


class NodeStore:
    """The nodes of a forest at ``path``, one folder a level: ``level=0`` has the leaves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schemas: list = []

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[k]).parquet(f"{self.path}/level={k}")

    def put(self, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.path}/level={len(self.schemas)}")
        self.schemas.append(rows.schema)
        return self.level(len(self.schemas) - 1)

    def build(self, leaves: DataFrame, payload: list[str]) -> DataFrame:
        """Writes all levels over ``leaves`` (tree, i, n, digest, payload...); (tree, subroot) comes back."""
        runs, roots = self.put(_runs(leaves, payload)), None
        while True:
            k = len(self.schemas) - 1
            done = runs.where(_height(F.col("n")) == k).select("tree", F.get("digests", F.lit(0)).alias("subroot"))
            roots = done if roots is None else roots.unionByName(done)
            runs = runs.where(_height(F.col("n")) > k)
            if runs.isEmpty():
                return roots
            parents = runs.select("tree", "n", "run", _parents(F.col("digests")).alias("digests"))
            if (k + 1) % STEPS == 0:  # each run is one node now
                parents = _runs(parents.select("tree", "n", F.col("run").alias("i"), F.get("digests", F.lit(0)).alias("digest")), [])
            runs = self.put(parents)

    def scanned(self, k: int, met: DataFrame) -> DataFrame:
        """The runs of level ``k`` merged by coordinate with what ``met`` says of them and with the levels
        above inside the run (d1, d2; null where the tree ends before)."""
        out = self.level(k).join(met, ["tree", "run"])
        for s in range(1, STEPS):
            if k + s < len(self.schemas):
                out = out.join(self.level(k + s).select("tree", "run", F.col("digests").alias(f"d{s}")), ["tree", "run"], "left")
            else:
                out = out.withColumn(f"d{s}", F.lit(None).cast("array<string>"))
        return out.withColumn("inside", F.greatest(F.least(_height(F.col("n")) - k, F.lit(STEPS)), F.lit(0)))

    def proofs(self, above: DataFrame) -> DataFrame:
        """The runs of leaves with ``subroot`` and ``path``, the siblings on the way from the run's top to the root.

        ``above`` has (tree, subroot, path) of each tree's root.  A path lists (left, right) level by level upwards, texts of
        joined digests; the levels inside the run are not in it, see ``own_path``.
        """
        first = above.select("tree", F.lit(0).cast("long").alias("run"), "subroot", "path")
        met = first
        for k in range((len(self.schemas) - 1) // STEPS * STEPS, 0, -STEPS):
            runs = self.scanned(k, met)
            each = F.transform("digests", lambda d, i: F.struct((F.col("run") * RUN + i).alias("run"), own_path(i).alias("path")))
            below = runs.select("tree", "subroot", F.inline(each))
            # a tree that ends below this level has one run there, with the root's own path
            met = below.unionByName(first.join(self.level(k).select("tree").distinct(), "tree", "left_anti").select(*below.columns))
        return self.scanned(0, met)


def own_path(i: Column) -> Column:
    """The whole path of node ``i`` of a scanned run: the other nodes of its families inside the run, then the run's path."""

    def at(nodes: Column, place: Column) -> Column:
        first = (place - place % FAN).cast("int")
        left = _joined(F.slice(nodes, first + 1, (place - first).cast("int")))
        return F.struct(left.alias("left"), _joined(F.slice(nodes, (place + 2).cast("int"), (first + FAN - 1 - place).cast("int"))).alias("right"))

    levels = ["digests", *[f"d{s}" for s in range(1, STEPS)]]
    found = [at(F.col(nodes), F.floor(i / FAN**s).cast("int")) for s, nodes in enumerate(levels)]
    return F.concat(F.slice(F.array(*found), F.lit(1), F.col("inside")), F.col("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(_joined(F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, copy_text: Column | None = None, target: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` has doc_id, lang and what ``columns`` name; a leaf covers those columns, and leaves ascend
    by doc_id in the tree of their lang (null first, then bytewise).  ``copy_text`` is the text column of a copy that is
    held against the manifest, as an expression over ``docs`` (null: it has the same text): its leaf is
    folded with the original siblings to folded_root, and ``verified`` says whether that is the root.
    The node store stays at ``target`` if given.

    A null in any column is a value of its own, an empty text another one.  A null doc_id comes first
    in its tree; rows with the same doc_id are ordered by their leaves, and repeated rows have leaves
    of their own.  An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = target or owned(spark, "merkle")
    values = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), leaf_hash(*values).alias("digest"), _claim(columns, values, copy_text).alias("claimed"))
    trees, forest = NodeStore(spark, f"{path}/trees"), NodeStore(spark, f"{path}/forest")
    subroots = stored(trees.build(sorted_leaves(rows, F.col("tree"), ["doc_id", "digest"], ["doc_id", "digest", "claimed"]), ["doc_id", "claimed"]), "subroots")
    tops = subroots.select(F.col("tree").alias("of"), F.col("subroot").alias("digest"))
    root = stored(forest.build(sorted_leaves(tops, F.lit("all"), ["of"], ["of", "digest"]), ["of"]), "root")  # one row, or none

    start = root.withColumn("path", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
    above = stored(_each_leaf(forest.proofs(start), lambda x, path: F.struct(x["of"].alias("tree"), x["digest"].alias("subroot"), path.alias("path"))), "tree-paths")
    out = _each_leaf(trees.proofs(above), lambda x, path: F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), proof_digest(path).alias("proof_sha256"), folded(F.coalesce(x["claimed"], x["digest"]), path).alias("folded_root")), "subroot")
    out = out.crossJoin(F.broadcast(root.select(F.col("subroot").alias("root"))))  # one row
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _claim(columns: tuple[str, ...], values: list[Column], copy_text: Column | None) -> Column:
    """The leaf of the copy, null where it is the original's."""
    if copy_text is None:
        return F.lit(None).cast("string")
    changed = [copy_text if c == "text" else v for c, v in zip(columns, values, strict=True)]
    return F.when(copy_text != values[columns.index("text")], leaf_hash(*changed))


def _each_leaf(runs: DataFrame, row: Callable[[Column, Column], Column], *keep: str) -> DataFrame:
    """One row for each leaf of ``runs``, made by ``row`` from its item and its whole path."""
    return runs.select(*keep, F.inline(F.transform("items", lambda x, i: row(x, own_path(i)))))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """op11's copy: where 3 divides the crc32 of the id, A-Z of the text are in lower case; null elsewhere."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, ascii_lower(text))


def _sql() -> str:
    """The trees unrolled for DuckDB, eight levels each."""
    part = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, COLUMNS[:-1]), part(text)]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""WITH d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents),
t0 AS MATERIALIZED (SELECT coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, claimed FROM d)"""
    folds, proof, fold = [], [], "claimed"
    for kind, depth in (("t", 8), ("f", 8)):
        if kind == "f":
            out += ",\nf0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS of FROM t8)"
        for k in range(1, depth + 1):
            below = f"{kind}{k - 1}"
            out += f",\n{kind}{k} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {below}) GROUP BY tree, i // 8)"
            out += f",\n{kind}s{k} AS MATERIALIZED (SELECT tree, i, any_value(n) AS n, '' AS none, list(h ORDER BY j) AS hs FROM (SELECT tree, i // 8 AS i, i AS j, h, count(*) OVER (PARTITION BY tree) AS n FROM {below}) GROUP BY tree, i)"
    joins = "FROM t0 JOIN f0 ON f0.of = t0.tree"
    place = {"t": "t0", "f": "f0"}
    for kind in "tf":
        for k in range(1, 9):
            s, of = f"{kind}s{k}", place[kind]
            joins += f"\n  JOIN {s} ON {s}.tree = {of}.tree AND {s}.i = {of}.i // {8**k}"
            at = f"({of}.i // {8 ** (k - 1)} % 8)"
            proof.append(f"CASE WHEN {s}.n > 1 THEN array_to_string({s}.hs[1:{at}], '') || array_to_string({s}.hs[{at} + 2:], '') ELSE '' END")
            folds.append((s, at))
    steps = []
    for j, (s, at) in enumerate(folds):
        steps.append(f"p{j + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n{j} > 1 THEN sha256(array_to_string(hs{j}[1:at{j}], '') || x || array_to_string(hs{j}[at{j} + 2:], '')) ELSE x END AS x) FROM p{j})")
    carried = ", ".join(f"{s}.n AS n{j}, {s}.hs AS hs{j}, {at} AS at{j}" for j, (s, at) in enumerate(folds))
    out += f",\np0 AS MATERIALIZED (SELECT t0.doc_id, t0.h AS leaf, f0.h AS subroot, {fold} AS x, sha256({' || '.join(proof)}) AS proof_sha256, {carried} {joins}),\n" + ",\n".join(steps)
    return out + f"\nSELECT doc_id, leaf, subroot, f8.h AS root, proof_sha256, x AS folded_root, x = f8.h AS verified FROM p{len(folds)}, f8"


SQL = _sql()
