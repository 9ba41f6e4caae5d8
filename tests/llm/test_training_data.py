"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import chat, decontaminate, jaccard, langid, linededup, queries, shard, tiff, tokenfile, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `row` string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two"
LINE = "a line that is long enough to count here"
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("twenty-two", "more")), (4, None), (5, ""), (6, "  \n "), (7, "Deux mots"), (8, "deux MOTS"), (9, f"{LINE}\n{LINE}\nother stuff entirely"),
    (10, LINE + "s\nshort"), (11, LINE.replace("long", "lung")), (11, LINE.replace("long", "lung")), (None, "nobody knows this identity at all"), (None, None), (12, "word " * 30_000), (13, "line\n" * 3000), (14, "x" * 40_000), (15, "x" * 39_999 + "y"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", "r") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_against_all_pairs(spark):
    rows = ROWS + [(100 + i, " ".join(f"w{(i // 3) * 40 + k if k != i % 3 else 9000 + i}" for k in range(40))) for i in range(30)]
    found = defaultdict(list)
    for r in jaccard.jaccard_components(table(spark, rows)).collect():
        found[r.doc_id].append((r.n_shingles, r.component_id))
    sets, parent = [(i, shingles(t)) for i, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)] += [] if i is None else [i]
    want = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        want[i].append((len(s), min(least[root(k)], default=None)))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_line_dedup(spark):
    out = {(r.row.doc_id, r.row.text): (r.text, r.n_lines, list(r.dropped)) for r in linededup.line_decisions(table(spark)).collect()}
    assert out[9, ROWS[8][1]] == (f"{LINE}\nother stuff entirely", 3, [1])
    assert out[10, ROWS[9][1]] == ("short", 2, [0])  # one letter more
    assert out[11, ROWS[10][1]] == ("", 1, [0])  # one letter changed
    assert out[4, None] == (None, 0, []) and out[5, ""] == ("", 1, [])
    assert out[14, "x" * 40_000][1:] == (1, []) and out[15, ROWS[-1][1]][1:] == (1, [0])
    assert out[13, ROWS[15][1]][2] == []  # short lines stay
    kept = linededup.dedup_lines(table(spark))
    assert kept.columns == table(spark).columns and 11 not in [r.doc_id for r in kept.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, told = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLES[name])
    key = lambda columns, rows: sorted([str(x) for _, x in sorted(zip(columns, r, strict=True))] for r in rows)
    assert key(found.columns, [tuple(r) for r in found.collect()]) == key(told.columns, told.fetchall())


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[:14])), (2, None), (3, ""), (4, "deux mots"), (5, "!!!")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(table(spark), bench).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].n_items, out[1].contaminated) == (24, 14, 1, True)
    assert out[7].n_hit == 2 and out[7].items_sha256 == sha256(b"4").hexdigest()
    assert out[4].n_words == 0 and not out[4].contaminated and not out[12].contaminated
    assert decontaminate.decontaminate(table(spark), bench.where("false")).where("n_hit > 0").count() == 0


def test_tokens_shards_and_media(spark):
    docs, library = table(spark), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tokenfile.token_digests(docs, queries.TOKENIZER, 2).collect()
    assert len(rows) == len(ROWS)
    place = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [*library.encode(BASE, add_special_tokens=False).ids, 2]
    assert {(r.n_tokens, r.ids_crc32) for r in rows if r.doc_id == 1} == {(len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))}
    shards = shard.shard(docs, 5).collect()
    assert len(shards) == len(ROWS) and len({r.shard for r in shards if r.doc_id in (1, 2)}) == 1
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
    media = {r.doc_id: r for r in tiff.media_digests(docs).collect()}
    assert media[5].payload_bytes == 64 and media[5].payload_sha256 == sha256(bytes(64)).hexdigest() and media[12].n_bytes == 150_000


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", "b<s>"), (1, 0, "user", None), (1, 1, "assistant", "b<s>"), (2, None, None, "x"), (None, 0, "user", "y")] + [(3, k, "assistant", str(k)) for k in range(200)]
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_sha256 == sha256(b"b<s>b<s>").hexdigest() and out[1].turns_sha256 == sha256(b"user\n\nassistant\nb<s>\nassistant\nb<s>\n").hexdigest()
    assert out[3].loss_sha256 == sha256("".join(map(str, range(200))).encode()).hexdigest() and len(out) == 4


def test_classifiers(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    held = langid.identify(docs, model).join(docs, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1")
    assert held.where("lang_pred = lang").count() / held.count() > 0.97
    cases = {r.doc_id: r.lang_pred for r in langid.identify(table(spark), model).collect()}
    assert cases[4] == cases[5] == cases[6] == "und" and cases[12] != "und"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert sum(r.score >= 0.7 for r in scored if r.toxic == 0) <= 0.05 * len(scored)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(table(spark), toxicity.fit(docs, labels)).collect())


@pytest.mark.parametrize("run", [jaccard.jaccard_components, linededup.line_decisions, shard.shard, tiff.media_digests, lambda d: tokenfile.token_digests(d, queries.TOKENIZER, 2), lambda d: langid.identify(d, langid.fit(langid.learnable(d)))])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.count() <= docs.count(), k
    assert 0 < corpus_pipeline.run(spark, sf).count() <= docs.count()
