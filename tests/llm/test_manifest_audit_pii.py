"""op11 to op13 on small tables of odd rows, against plain versions of the same."""

import re
import zlib
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evidentia.llm import filteraudit, merkle, pii, queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, i long, first boolean, key string, spans string"
LABELS = "doc_id long, quality int, toxic int, part string"


def write(spark, tmp_path, docs, labels=()):
    spark.createDataFrame(docs, DOCUMENTS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def row(doc_id, text, lang="en", source="src1", n=3):
    return (doc_id, text, lang, source, n, "t", 7, True, "k", "s")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i - i % 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


ODD = [row(None, None, None, None, None), row(None, "", "en"), row(1, "Text"), row(1, "Text"), row(1, "Another TEXT"), row(2, "naïve Ä", "fr"), row(3, "x" * 9000, ""), row(4, "LONE", "zz", None)]
MANY = [row(k, f"Number {k}" if k % 5 else None, "en" if k % 9 else None) for k in range(1, 1400)]


@pytest.mark.parametrize("docs", [[], ODD, MANY, [row(9, "Alone")]], ids=["empty", "odd", "many", "alone"])
def test_merkle(spark, tmp_path, docs):
    found = [r.asDict() for r in queries.QUERIES["op11_merkle"](spark, write(spark, tmp_path, docs)).collect()]
    trees = {}
    for d in docs:
        text = d[1]
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        spoilt = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        of = (d[2], d[3], d[4])
        trees.setdefault(d[2], []).append(((d[0] is not None, d[0] or 0), leaf(d[0], text, *of), leaf(d[0], low if spoilt else text, *of), d[0]))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: levels([x[1] for x in sorted(trees[lang])]) for lang in order}
    forest = levels([built[lang][-1][0] for lang in order]) if order else []
    want = []
    for place, lang in enumerate(order):
        for i, (_, own, claimed, doc_id) in enumerate(sorted(trees[lang])):
            way, fold = path(built[lang], i) + path(forest, place), claimed
            for a, b in way:
                fold = digest(a, fold, b)
            want.append({"doc_id": doc_id, "leaf": own, "subroot": built[lang][-1][0], "root": forest[-1][0], "proof_sha256": digest(*[a + b for a, b in way]), "folded_root": fold, "verified": fold == forest[-1][0]})
    assert sorted(found, key=str) == sorted(want, key=str)


def test_manifest_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, "b", "en", None)], "doc_id long, text string, lang string, stars int")
    one, two = (merkle.manifest(docs.withColumn("stars", stars), columns=("doc_id", "stars")).select("root").distinct().collect() for stars in (F.col("stars"), F.lit(5)))
    assert len(one) == len(two) == 1 and one != two


FILTERS = {
    "A": lambda w, t: len(w) < 200, "B": lambda w, t: 100 * len(set(w)) < 50 * len(w),
    "C": lambda w, t: 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": lambda w, t: bool(re.search("[#$%&*|]", t)),
}
TEXTS = [None, "", " \t", "Short", "short", " ".join(f"w{k}" for k in range(250)), "same " * 300, "50% OFF " * 200, " ".join(f"W{k}" for k in range(250)), "nb\xa0sp " * 10, "ÄÖ #"]
AUDITED = [row(k, TEXTS[k % len(TEXTS)], [None, "", "en", "fr"][k % 4]) for k in range(60)] + [row(5, TEXTS[5], "en")] * 2 + [row(None, "Short", "en"), row(None, "never seen", "de")]
LABELLED = [(k, k % 2, int(k % 3 == 0), "p") for k in range(0, 60, 2)] + [(4, 1, None, "p"), (4, None, 1, "p"), (None, 1, 1, "p"), (999, 1, 1, "p")]


@pytest.mark.parametrize("docs, labels", [([], []), (AUDITED, LABELLED), (AUDITED, [])], ids=["empty", "odd", "unlabelled"])
def test_filter_audit(spark, tmp_path, docs, labels):
    found = sorted(tuple(r) for r in queries.QUERIES["op12_filter_audit"](spark, write(spark, tmp_path, docs, labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    good, toxic = ({x[0] for x in labels if x[k] == 1} for k in (1, 2))
    parts = {}
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        fails = {f for f, bad in FILTERS.items() if bad(words, text)}
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs):
            fails.add("E")
        parts.setdefault(lang or "", []).append((doc_id, fails))
    want = []
    for part, rows in parts.items():
        removed = {}
        for order in permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                lost = [sum(r[0] is not None and r[0] in of for r in gone) for of in (good, toxic)]
                want.append([part, "".join(order), step, len(alive), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), *lost, f])
        want = [w if w[0] != part else [*w[:-1], removed[w[-1]]] for w in want]
    assert found == sorted(map(tuple, want))


def test_a_state_is_executed_once(spark, monkeypatch):
    seen = []
    rows = spark.createDataFrame([("en", True, False, True, False)], "part string, good boolean, toxic boolean, A boolean, B boolean")
    count = filteraudit.Trie._count
    monkeypatch.setattr(filteraudit.Trie, "_count", lambda self, state, left, survivors: (seen.append(state), count(self, state, left, survivors)))
    edges = filteraudit.Trie(rows, "AB").run()
    assert sorted(seen) == [0, 1, 2] and edges.count() == 2 + 1 and not spark.sparkContext._jsc.getPersistentRDDs()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPIKED = [
    None, "", "nothing here", "mail a.b+c@x-y.example.com, now", "a@b.c_d@e.f@g.h", "@@ a@ @b.c a@b a@b.c.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "1 2 3 4 5 6 7 8 9",
    "call +48 (22) 555-01-02 or +1-202-555-0143.", "+1 +2 +12345678901234567", "x" * 50_000 + "@", "1 " * 30_000, "9" * 20_000, "ä🎉 ü@x.yz z@x.yz 10.0.0.1 4242424242424242", "+4242424242424242 a@1.2.3.4", "a@b.cc " * 700, "..@..", "a" * 30 + " b@c.dd" * 3,
]


def plain(text):
    out = []
    for place, (kind, rx) in enumerate(PLAIN.items()):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


@pytest.mark.parametrize("docs", [[], [row(k, t) for k, t in enumerate(SPIKED)] + [row(3, SPIKED[3]), row(None, SPIKED[4]), row(None, None)]], ids=["empty", "odd"])
def test_base_spans(spark, tmp_path, docs):
    found = [r.asDict() for r in queries.QUERIES["op13_pii"](spark, write(spark, tmp_path, docs)).collect()]
    told = {}
    for d in docs:
        told.setdefault(d[0], []).append(plain(d[1] or ""))
    assert len(found) == len(docs)
    for r in found:
        base = [s for s in told[r["doc_id"]] if sha256(s.encode()).hexdigest() == r["base_sha256"]]
        assert base, r
        kinds = [s.split(":")[0] for s in base[0].split(",")]
        assert all(r[f"n_{k}"] == kinds.count(k) for k in PLAIN)
        assert set(filter(None, base[0].split(","))) <= set(r["spans"].split(","))


def test_terms_that_reveal_an_entity_go_wherever_they_stand(spark):
    filler = [(100 + k, f"plain words of an ordinary text number {k} about meadows", "x") for k in range(60)]
    docs = [(1, "write to Kowalczyk at jan@firm.example soon", "x"), (2, "ask Kowalczyk or jan@firm.example instead", "x"), (3, "there KOWALCZYK walked over meadows", "x"), (4, "mention ordinary jan@firm.example text", "x"), (5, None, "x"), *filler]
    rows = spark.createDataFrame(docs, "doc_id long, text string, key string")
    found = {r.doc_id: r for r in pii.personal_data(rows).collect()}
    terms = lambda i: [(s.start, s.stop) for s in found[i].spans if s.kind == "term"]
    assert terms(1) == [(9, 18)] and terms(2) == [(4, 13)] and terms(3) == [(6, 15)] and not terms(4) and not any(terms(100 + k) for k in range(60))
    clean = {r.doc_id: r for r in pii.sanitised(rows).collect()}
    assert clean[3].text.startswith("there ") and "KOWALCZYK" not in clean[3].text and clean[4].text == "mention ordinary [email] text" and clean[5].text is None
    assert clean[100].text == docs[5][1] and all(r.key == "x" for r in clean.values()) and len(clean) == len(docs)


def test_one_text_alone_reveals_nothing(spark):
    docs = [(k, "only Brzezinski writes from jan@firm.example", "x") for k in range(4)] + [(10 + k, f"other text {k}", "x") for k in range(40)]
    found = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string, key string"))
    assert found.where("exists(spans, s -> s.kind = 'term')").isEmpty()
