"""Near duplicates: sets that share no word never meet, however like their sizes and parities are."""

import random
from collections import defaultdict
from hashlib import md5

from evidentia.operators import neardup

KIND = "doc_id long, text string"


def test_sets_without_a_shared_word_do_not_meet(spark):
    """The words of these texts are all different, and those at one place have the same parity."""
    by = defaultdict(list)
    for i in range(40_000):
        word = f"word{i}x"
        by[int.from_bytes(md5(word.encode()).digest()[:8], "little") & 1023].append(word)
    rows = [(k, " ".join(by[place][k] for place in range(30))) for k in range(6)]
    sets = neardup._sets(spark.createDataFrame(rows, KIND), False)
    assert neardup.candidates(sets, neardup.WARN).count() == 0


def test_blocks_of_one_size_and_of_many(spark, monkeypatch):
    """Sets of one size fill several blocks, others lie on both sides of a border, and few words have a place by frequency."""
    monkeypatch.setattr(neardup, "BLOCK_WORDS", 400)
    monkeypatch.setattr(neardup, "FREQUENT", 20)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    rng = random.Random(5)
    words = [f"word{i}x" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, 20 if i < 60 else rng.randint(1, 50)))) for i in range(100)]
    for i in range(100, 200):
        old = rows[i - 100][1].split()
        rows.append((i, " ".join([*old[rng.randint(0, 1 + len(old) // 6) :], *rng.sample(words, rng.randint(0, 2))])))
    sets = {i: set(text.split()) for i, text in rows}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {(a, i): 1.0 for i, s in sets.items() if s and (a := first[frozenset(s)]) != i}
    want |= {(a, b): j for s, a in first.items() for t, b in first.items() if a < b and s and t and (j := len(s & t) / len(s | t)) >= neardup.WARN}
    found = neardup.similar(spark.createDataFrame(rows, KIND)).collect()
    assert len(want) > 60
    assert {(r.a, r.b): round(r.jaccard, 9) for r in found} == {k: round(j, 9) for k, j in want.items()}
    assert len(found) == len(want)
