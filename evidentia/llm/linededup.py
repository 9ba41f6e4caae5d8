"""Line dedup by a deletion-neighbourhood join (DataFrame operations only).

A line goes when an earlier line equals it or lies within one edit (an insertion, deletion or
substitution of one character) of it.  Earlier means smaller (doc_id, place in the document).

All variants of a line with one character deleted are emitted as hashed keys:

* two lines of one length within one edit have equal variants at the same place;
* a line that is one character longer has a variant equal to the shorter line.

Equal keys are joined, the earliest line of each key is taken by a pre-aggregated minimum (so a group
of many alike lines gives one link a line, not all pairs), and each link is verified on the texts: they
must be equal but for the characters left out.

To keep the keys few, a line is cut into blocks by its length alone.  An edit touches one block, so
both lines agree before and after it; only blocks whose surroundings occur in some other line emit
variants, and only of the block's own characters.  That loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import document_key, stored

#: By default lines shorter than this stay, even when repeated; lines shorter than FUZZY_CHARS go only if equal.
MIN_CHARS, FUZZY_CHARS = 10, 20
#: Lines of up to this many characters have two blocks, longer ones blocks of half as many, and from
#: MOST_BLOCKS of them on the blocks are twice as long, and so on.
TWO_BLOCKS, MOST_BLOCKS = 1024, 2048
#: Ids of lines (two longs) that are broadcast; with more of them the same join shuffles.
BROADCAST_LINES = 400_000


def _measured(lines: DataFrame) -> DataFrame:
    """Adds n, and for a pair's longer (0) and shorter (1) line the size of blocks, as columns, so that
    they are computed once a line."""
    lines = lines.withColumn("n", F.length("line"))
    sizes = {}
    for short in (0, 1):
        total = F.col("n") + short
        doubled = F.greatest(F.ceil(F.log2(total / (TWO_BLOCKS // 2 * MOST_BLOCKS))), F.lit(0)).cast("int")
        wide = F.call_function("shiftleft", F.lit(TWO_BLOCKS // 2), doubled)
        sizes[f"size{short}"] = F.when(total <= TWO_BLOCKS, F.ceil(total / 2).cast("int")).otherwise(wide)
    return lines.withColumns(sizes)


def _running(hashes: Column) -> Column:
    """0, and what the first, the first two, ... of the hashes give together."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda seen, h: F.concat(seen, F.array(F.element_at(seen, -1).bitwiseXOR(h))))


def _blocks(short: int) -> Column:
    """Structs (k, short, a, text) of a measured line: the hash of what surrounds a block, where it
    begins and what it holds, for the longer line of a pair and for lines of equal length (0), or for
    the shorter line of a pair (1), whose block is one character shorter.

    A long line is cut into its pieces once, and the hashes of what comes before and after each block
    are running ones, so that it takes time in proportion to its length."""
    line, n, size = F.col("line"), F.col("n"), F.col(f"size{short}")
    block = lambda k, a, text: F.struct(k.alias("k"), F.lit(bool(short)).alias("short"), a.alias("a"), text.alias("text"))
    head, tail = _ends(short)
    two = F.array(
        block(F.xxhash64(n + short, F.lit(0), F.lit(""), tail), F.lit(0), F.substr(line, F.lit(1), F.greatest(size - short, F.lit(0)))),
        block(F.xxhash64(n + short, F.lit(1), head, F.lit("")), size, F.substr(line, size + 1, F.greatest(n - size, F.lit(0)))),
    )
    pattern = F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}"))
    pieces = F.regexp_extract_all(line, pattern, F.lit(0))
    later = F.regexp_extract_all(F.concat(F.lit(" "), line), pattern, F.lit(0)) if short else pieces
    hashed = lambda parts: F.transform(parts, lambda p, i: F.xxhash64(i, p))
    before, after = _running(hashed(pieces)), F.reverse(_running(F.reverse(hashed(later))))
    around = F.zip_with(F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))), before, lambda x, y: F.struct(y.alias("before"), x.alias("after")))
    both = F.filter(F.zip_with(around, pieces, lambda x, y: F.struct(x["before"].alias("before"), x["after"].alias("after"), F.coalesce(y, F.lit("")).alias("piece"))), lambda x: x["after"].isNotNull())
    long = F.transform(both, lambda x, j: block(F.xxhash64(n + short, j, x["before"], x["after"]), j * size, F.substr(x["piece"], F.lit(1), size - short)))
    return F.when(n + short <= TWO_BLOCKS, two).otherwise(long)


def _ends(short: int) -> tuple[Column, Column]:
    """Of a line of two blocks what stands before the second one and after the first one."""
    line, n, size = F.col("line"), F.col("n"), F.col(f"size{short}")
    return F.substr(line, F.lit(1), size), F.when(size - short < n, F.substr(line, size - short + 1, n - size + short)).otherwise(F.lit(""))


def _keys() -> Column:
    return F.concat(_blocks(0), _blocks(1))


def _hashes() -> Column:
    """The k of ``_keys`` alone; spelled out for lines of two blocks, which are nearly all, as that
    compiles."""
    two = []
    for short in (0, 1):
        head, tail = _ends(short)
        two += [F.xxhash64(F.col("n") + short, F.lit(0), F.lit(""), tail), F.xxhash64(F.col("n") + short, F.lit(1), head, F.lit(""))]
    return F.when(F.col("n") < TWO_BLOCKS, F.array(*two)).otherwise(F.transform(_keys(), lambda b: b["k"]))


def _variants(b: Column) -> Column:
    """Structs (v, at) for one block: every variant with a character deleted, or the block as it is."""
    text = b["text"]
    size = F.length(text)

    def deleted(i: Column) -> Column:
        left = F.substr(text, F.lit(1), i)
        right = F.when(i + 1 < size, F.substr(text, i + 2, size - i - 1)).otherwise(F.lit(""))
        return F.struct(F.xxhash64(b["k"], F.concat(left, right)).alias("v"), (b["a"] + i).alias("at"))

    whole = F.array(F.struct(F.xxhash64(b["k"], text).alias("v"), F.lit(-1).alias("at")))
    each = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), deleted)
    return F.when(b["short"], whole).when(size > 0, each)


def _near(lines: DataFrame, table: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that lie within one edit of an earlier line.

    ``table`` has h1, h2 and keys of every line, ``lines`` also the line itself."""
    keys = table.select("h1", "h2", F.explode("keys").alias("k"))
    met = keys.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    wanted = stored(keys.join(met, "k", "left_semi").select("h1", "h2").distinct(), "line-ids")
    small = F.broadcast if wanted.count() <= BROADCAST_LINES else (lambda df: df)
    texts = lines.select("h1", "h2", "line").join(small(wanted), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    texts = stored(texts.join(firsts, ["h1", "h2"]), "lines")
    blocks = _measured(texts).select("h1", "h2", F.explode(_keys()).alias("b"))
    again = blocks.groupBy("b.k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    blocks = blocks.withColumn("k", F.col("b.k")).join(again, "k", "left_semi")
    emitted = blocks.select("h1", "h2", F.explode(_variants(F.col("b"))).alias("x")).select("h1", "h2", "x.v", "x.at")
    equal = emitted.groupBy("v").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("v")
    rows = stored(emitted.join(equal, "v", "left_semi").distinct().join(texts.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
    me = F.struct("first", "h1", "h2", "at")
    whole = F.col("at") < 0
    per_key = rows.groupBy("v").agg(F.min(F.when(whole, me)).alias("short"), F.min(F.when(~whole, me)).alias("long"))
    per_place = rows.groupBy("v", "at").agg(F.min(me).alias("same"))
    links = rows.join(per_key, "v").join(per_place, ["v", "at"])
    earliest = F.when(whole, F.col("long")).otherwise(F.least("short", "same"))
    links = links.withColumn("to", earliest).where("to.first < first").select("h1", "h2", "at", F.col("to.h1").alias("g1"), F.col("to.h2").alias("g2"), F.col("to.at").alias("other_at")).distinct()
    line, other = texts.select("h1", "h2", "line"), texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    return links.join(line, ["h1", "h2"]).join(other, ["g1", "g2"]).where(_one_edit(F.col("line"), F.col("at"), F.col("other"), F.col("other_at"))).select("h1", "h2").distinct()


def _one_edit(a: Column, at: Column, b: Column, other_at: Column) -> Column:
    """Whether the lines are equal but for the character at the place that each leaves out (-1: none), so
    that one edit makes one the other; takes time in proportion to their length."""
    place = F.greatest(at, other_at)
    rest = lambda line, skip: F.substr(line, place + 1 + skip, F.greatest(F.length(line) - place - skip, F.lit(0)))
    return (F.substr(a, F.lit(1), place) == F.substr(b, F.lit(1), place)) & (rest(a, (at >= 0).cast("int")) == rest(b, (other_at >= 0).cast("int")))


def line_decisions(docs: DataFrame, min_chars: int = MIN_CHARS, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, any others): row (the whole row as a struct), text
    (without the dropped lines), n_lines, dropped (places of the dropped lines, ascending).

    Lines are what newlines separate.  Those of ``min_chars`` characters or more go if an earlier one is
    equal, those of ``fuzzy_chars`` or more also if it is within one edit; with ``min_chars=1`` every
    line that has a character.  A null text stays null and has no lines; an empty text is one
    empty line and stays.  A text all of whose lines go becomes empty.  Rows with the same doc_id and
    the same text are one document, so neither takes lines from the other.  A null doc_id comes before
    all others.  Names of other columns do not matter.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    rows = rows.withColumn("key", document_key(F.col("row.doc_id"), text))
    split = rows.select(F.col("row.doc_id").alias("id"), "key", F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    lines = split.where(F.length("line") >= min_chars).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    table = _measured(lines).select("id", "key", "at", "h1", "h2", F.when(F.col("n") >= fuzzy_chars, _hashes()).alias("keys"))
    table = stored(table, "line-keys")
    firsts = stored(table.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "at")).alias("first")), "firsts")
    near = _near(lines.select("h1", "h2", "line"), table, firsts)
    kept = firsts.join(near, ["h1", "h2"], "left_anti").groupBy("first.key").agg(F.collect_list("first.at").alias("kept"))
    out = rows.join(kept, "key", "left").withColumn("lines", F.split(text, "\n", -1))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    short = F.filter(places, lambda i: F.length(F.get("lines", i)) < min_chars)
    stay = F.array_sort(F.concat(short, F.coalesce("kept", F.array().cast("array<int>"))))
    out = out.withColumn("stay", F.when(text.isNotNull(), stay))
    cleaned = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    dropped = F.when(text.isNotNull(), F.array_except(places, "stay")).otherwise(F.array().cast("array<int>"))
    return out.select("row", cleaned.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """``docs`` with ``text`` freed of lines that repeat; documents that lose all their lines go.

    An ``n_chars`` column follows the new text; every other column stays as it is.  The cases of
    ``line_decisions`` hold.
    """
    out = line_decisions(docs, min_chars, fuzzy_chars).where("n_lines = 0 or size(dropped) < n_lines")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH l AS (SELECT doc_id, i - 1 AS place, ln[i] AS line FROM (SELECT doc_id, ln, unnest(range(1, len(ln) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ln FROM documents))),
d AS (SELECT line, min({'a': doc_id, 'b': place}) AS f FROM l WHERE length(line) >= 10 GROUP BY line),
v AS (SELECT line, f, p, md5(left(line, p - 1) || substr(line, p + 1)) AS h FROM (SELECT line, f, unnest(range(1, length(line) + 1)) AS p FROM d WHERE length(line) >= 20)),
s AS (SELECT h, p, min(f) AS f FROM v GROUP BY h, p HAVING count(*) > 1),
near AS (
  SELECT v.line FROM v JOIN s USING (h, p) WHERE s.f < v.f
  UNION SELECT CASE WHEN v.f < d.f THEN d.line ELSE v.line END FROM v JOIN d ON v.h = md5(d.line) WHERE length(d.line) >= 20),
k AS (SELECT f.a AS doc_id, f.b AS place FROM d WHERE line NOT IN (SELECT line FROM near)),
x AS (SELECT l.doc_id, l.place, l.line, length(l.line) < 10 OR k.place IS NOT NULL AS stays FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.place = k.place)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  coalesce(string_agg(place::varchar, ',' ORDER BY place) FILTER (NOT stays), '') AS dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS text_sha256
FROM x GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, '', sha256('') FROM documents WHERE text IS NULL
"""
