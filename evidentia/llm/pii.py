"""Personal data: spans of fixed forms, and terms that give away whom a text is about (DataFrame operations only).

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers.  Their distinct
values are the *protected entities*.  The method then asks the whole corpus which other terms reveal
an entity: with N documents, an entity c in ``df(c)`` of them, a term t in ``df(t)`` and t beside c in
``co(c, t)``, the term tells ``PMI(c; t) = log(co * N / (df(c) * df(t)))`` of the ``IC(c) = log(N / df(c))``
that there is to know about c, and its *disclosure* is PMI / IC: 1 where the term occurs nowhere but
beside the entity.  A term is disclosing for what it reveals of any entity, and wherever it occurs it is

* removed from ``REMOVED`` on,
* generalised from ``GENERALISED`` on, to the kind of word that it is (see ``sanitised``),

both only where ``SUPPORT`` different texts show it beside the entity, as one text alone proves nothing.

All counts cover all documents.  Beside means within ``CONTEXT`` characters in the same piece of text
between spans of a kind, so that an occurrence gives a bounded number of pairs.  Words are counted with
map-side sums; no document's or entity's rows are gathered but the spans of one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, document_key, stored

#: Kinds in the order in which spans of one start are listed; the method's own kind comes last.
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns.  A match may begin where a run of its first characters begins, or where the
#: match before ends (\G); with possessive runs that finds the same spans as without, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Terms are runs of letters, and a term has at least this many.
WORD, TERM_CHARS = r"\p{L}+", 4
BETWEEN = "\x1f"
CONTEXT, SUPPORT, GENERALISED, REMOVED = 64, 2, 0.8, 0.95
#: Documents with disclosing terms whose keys (128 bits each) are broadcast; beyond that the join shuffles.
BROADCAST_KEYS = 200_000
#: Disclosing terms that are broadcast; beyond that the join shuffles.
BROADCAST_TERMS = 200_000


def running(lengths: Column) -> Column:
    """The sums of the first, the first two, ... of an array, in n log n steps: each round adds what stood 2**k places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)).cast("double"))).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(rounds, lengths, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a run of digits passes the checksum: from the right, every second digit counts double, less 9 where that has two digits."""
    size = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, size - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    """What a match must fulfil besides its form."""
    if kind == "ip":
        bare = lambda part: F.regexp_replace(part, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda part: (F.length(bare(part)) <= 3) & (F.coalesce(bare(part).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(found)).between(14, 19) & luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def _placed(found: Column, pieces: Column) -> Column:
    """Structs (start, stop, text, before, after) of the matches of a pattern in code points; ``pieces`` is the text around them."""
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda piece, match: F.length(piece) + F.length(match))
    each = F.zip_with(found, running(steps), lambda match, stop: F.struct((stop - F.length(match)).alias("start"), stop.alias("stop"), match.alias("text")))
    placed = F.transform(each, lambda x, i: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["text"].alias("text"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))
    return F.when(F.size(found) > 0, placed).otherwise(F.expr("cast(array() as array<struct<start: int, stop: int, text: string, before: string, after: string>>)"))


def _beside(before: Column, after: Column) -> Column:
    """The terms within CONTEXT characters of a match, without words that the bound cuts and without addresses."""
    left = F.when(F.length(before) > CONTEXT, F.regexp_replace(F.right(before, F.lit(CONTEXT)), r"^\p{L}+", "")).otherwise(before)
    right = F.when(F.length(after) > CONTEXT, F.regexp_replace(F.left(after, F.lit(CONTEXT)), r"\p{L}+$", "")).otherwise(after)
    plain = F.regexp_replace(F.concat(left, F.lit(" "), right), r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*", " ")
    return _terms(plain)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= TERM_CHARS))


def _holder(kind: str) -> Callable[[Column], Column]:
    return lambda m: _holds(kind, m["text"])


def _spanned(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), m["stop"].alias("stop"))


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, spans, pairs) of every row of ``docs`` (doc_id, text), written.

    ``spans`` are the base spans (start, place, kind, stop) in order, ``key`` stands for id and text, ``digest`` for the text;
    ``pairs`` are the distinct entities and terms that stand beside each other, joined by BETWEEN, and each entity with an empty term.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", document_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), text.alias("text"))
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"found_{k}": F.when(may.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"pieces_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"placed_{k}": F.filter(_placed(F.col(f"found_{k}"), F.col(f"pieces_{k}")), _holder(k)) for k in KINDS})
    spans = [F.transform(f"placed_{k}", _spanned(k)) for k in KINDS]

    def pairs(kind: str) -> Column:
        named = lambda m: F.concat(F.lit(f"{kind}:"), ascii_lower(m["text"]) if kind == "email" else m["text"] if kind == "ip" else _digits(m["text"]))
        of = lambda m: F.transform(F.concat(F.array(F.lit("")), _beside(m["before"], m["after"])), lambda t: F.concat(named(m), F.lit(BETWEEN), t))
        return F.flatten(F.transform(f"placed_{kind}", of))

    return stored(rows.select("doc_id", "key", F.unhex(F.md5("text")).alias("digest"), F.array_sort(F.concat(*spans)).alias("spans"), F.array_distinct(F.concat(*map(pairs, KINDS))).alias("pairs")), "detected")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, disclosure) of the terms that tell at least ``GENERALISED`` of what is to know about an entity; written."""
    beside = found.where("size(pairs) > 0").select("digest", F.explode("pairs").alias("pair"))
    beside = beside.select("digest", F.substring_index("pair", BETWEEN, 1).alias("entity"), F.substring_index("pair", BETWEEN, -1).alias("term"))
    counts = beside.groupBy("entity", "term", "digest").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("co"), F.count("*").alias("support"))
    counts = stored(counts.where((F.col("support") >= SUPPORT) | (F.col("term") == "")), "beside")
    candidates = stored(counts.where("term <> ''").select("term").distinct(), "candidates")
    words = docs.select(F.explode(_terms(F.col("text").cast("string"))).alias("term"))
    often = words.join(_small(candidates, BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    total = found.agg(F.count("*").alias("total"))
    of = counts.where("term = ''").select("entity", F.col("co").alias("of"))
    rated = counts.where("term <> ''").join(of, "entity").join(often, "term").crossJoin(F.broadcast(total))  # one row
    information = F.log(F.col("total") / F.col("of"))
    pmi = F.log(F.col("co") * F.col("total") / (F.col("of") * F.col("df")))
    rated = rated.where(F.col("of") < F.col("total")).groupBy("term").agg(F.max(F.round(pmi / information, 9)).alias("disclosure"))
    return stored(rated.where(F.col("disclosure") >= GENERALISED), "disclosing")


def _small(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast only if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term_spans): where disclosing terms stand outside of base spans, (start, place, kind, stop, disclosure)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(document_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), text.alias("text"))
    held = rows.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(_small(terms, BROADCAST_TERMS), "term")
    held = stored(held.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("held")), "held")
    # documents that repeat are met once
    near = rows.join(_small(held.select("key"), BROADCAST_KEYS), "key", "left_semi").dropDuplicates(["key"]).join(held, "key")
    near = near.join(found.select("key", "spans").dropDuplicates(["key"]), "key")
    near = near.select("key", "held", "spans", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", WORD, -1).alias("pieces"))
    rated = F.transform(_placed(F.col("words"), F.col("pieces")), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("place"), F.lit("term").alias("kind"), m["stop"].alias("stop"), F.element_at("held", ascii_lower(m["text"])).alias("disclosure")))
    free = F.filter(rated, lambda m: m["disclosure"].isNotNull() & ~F.exists("spans", lambda b: (m["start"] < b["stop"]) & (m["stop"] > b["start"])))
    return stored(near.select("key", free.alias("term_spans")), "term-spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, key, base_spans, spans.

    ``base_spans`` are (start, place, kind, stop) in code points, ends exclusive, by start and then kind; ``spans`` has the terms
    that the method adds besides, with their disclosure (null for base spans).  Null and empty texts have no spans;
    rows with the same doc_id and text get the same ones, and count as documents of their own.  A null
    doc_id is an id like any other.  An empty table gives no rows.  Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = detected(docs)
    more = _term_spans(docs, found, disclosing(docs, found))
    base = F.transform("spans", lambda b: F.struct(b["start"].alias("start"), b["place"].alias("place"), b["kind"].alias("kind"), b["stop"].alias("stop"), F.lit(None).cast("double").alias("disclosure")))
    return found.join(more, "key", "left").select("doc_id", "key", F.col("spans").alias("base_spans"), F.array_sort(F.concat(base, F.coalesce("term_spans", F.expr("cast(array() as array<struct<start: int, place: int, kind: string, stop: int, disclosure: double>>)")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` freed of personal data; every other column stays, and so does a null text.

    A base span becomes its kind in brackets; a disclosing term goes from REMOVED on and else becomes [Name] or [word],
    as it begins with a capital letter or not.  Of spans that overlap the first one counts.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.withColumns({"key": document_key(F.col("row.doc_id"), F.col("row.text").cast("string")), "text": F.col("row.text").cast("string")})
    found = personal_data(docs).select("key", "spans").where("size(spans) > 0").dropDuplicates(["key"])
    keyed = keyed.join(found, "key", "left")
    reach = F.aggregate("spans", F.expr("cast(array() as array<int>)"), lambda a, s: F.concat(a, F.array(F.greatest(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), s["stop"]))))
    keyed = keyed.withColumn("reach", reach)

    def said(s: Column) -> Column:
        word = F.when(F.substr("text", s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), "[Name]").otherwise("[word]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["disclosure"] >= REMOVED, "").otherwise(word)

    def part(s: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get("reach", i - 1)).otherwise(0)
        return F.when(s["start"] >= done, F.concat(F.substr("text", done + 1, s["start"] - done), said(s))).otherwise("")

    text = F.concat(F.array_join(F.transform("spans", part), ""), F.substr("text", F.element_at("reach", -1) + 1, F.length("text")))
    keyed = keyed.withColumn("new", F.when(F.size("spans") > 0, text).otherwise(F.col("text")))
    return keyed.select(*[(F.col("new") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_TRUE = {
    "email": "true",
    "ip": r"len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(ltrim(p, '0') AS int), CASE WHEN ltrim(p, '0') = '' THEN 0 ELSE 999 END) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN {_DIGITS}[length({_DIGITS}) - j]::int WHEN {_DIGITS}[length({_DIGITS}) - j]::int > 4 THEN 2 * {_DIGITS}[length({_DIGITS}) - j]::int - 9 ELSE 2 * {_DIGITS}[length({_DIGITS}) - j]::int END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_SQL_WORDS = "list_distinct(list_filter(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\p{{L}}+'), lambda w: length(w) >= 4))"


def _sql() -> str:
    """The same by unnesting every match, with the contract's patterns as they stand there."""
    at = lambda kind, place, rx: f"SELECT doc_id, '{kind}' AS kind, {place} AS place, m[i] AS m, p[i] AS before, p[i + 1] AS after, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, regexp_split_to_array(t, '{rx}') AS p FROM d))"
    base = " UNION ALL ".join(f"SELECT * FROM ({at(k, p, _PLAIN[k])}) WHERE {_TRUE[k]}" for p, k in enumerate(KINDS))
    left = f"CASE WHEN length(before) > {CONTEXT} THEN regexp_replace(right(before, {CONTEXT}), '^\\p{{L}}+', '') ELSE before END"
    right = f"CASE WHEN length(after) > {CONTEXT} THEN regexp_replace(left(after, {CONTEXT}), '\\p{{L}}+$', '') ELSE after END"
    context = f"regexp_replace({left} || ' ' || {right}, '[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*', ' ', 'g')"
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED (SELECT *, start + length(m) AS stop, kind || ':' || CASE kind WHEN 'email' THEN translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN m ELSE regexp_replace(m, '[^0-9]', '', 'g') END AS entity FROM ({base})),
n AS (SELECT count(*) AS n FROM d), e AS (SELECT entity, count(DISTINCT doc_id) AS dfc FROM b GROUP BY entity),
c AS (SELECT entity, term, count(DISTINCT doc_id) AS co FROM (SELECT doc_id, entity, unnest({_SQL_WORDS.format(context)}) AS term FROM b) GROUP BY ALL),
s AS (SELECT entity, term, count(DISTINCT t) AS support FROM (SELECT doc_id, entity, unnest({_SQL_WORDS.format(context)}) AS term FROM b) JOIN d USING (doc_id) GROUP BY ALL HAVING count(DISTINCT t) >= {SUPPORT}),
w AS (SELECT term, count(*) AS dft FROM (SELECT unnest({_SQL_WORDS.format('t')}) AS term FROM d) GROUP BY term),
x AS MATERIALIZED (SELECT term, max(round(ln(co * n / (dfc * dft)) / ln(n / dfc), 9)) AS disclosure FROM c JOIN s USING (entity, term) JOIN e USING (entity) JOIN w USING (term), n WHERE dfc < n GROUP BY term HAVING disclosure >= {GENERALISED}),
hit AS (SELECT doc_id, t FROM d WHERE len(list_intersect({_SQL_WORDS.format('t')}, (SELECT list(term) FROM x))) > 0),
tw AS (SELECT doc_id, m[i] AS m, stops[i] AS start FROM (SELECT doc_id, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) AS stops, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\p{{L}}+') AS m, regexp_split_to_array(t, '\p{{L}}+') AS p FROM hit))),
ts AS (SELECT doc_id, 'term' AS kind, 4 AS place, start, start + length(m) AS stop FROM tw JOIN x ON x.term = translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = tw.doc_id AND tw.start < b.stop AND tw.start + length(tw.m) > b.start)),
a AS (SELECT doc_id, kind, place, start, stop FROM b UNION ALL SELECT doc_id, kind, place, start, stop FROM ts),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_term,
  string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' ORDER BY start, place) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' ORDER BY start, place) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_term, 0) AS n_term, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SQL = _sql()
