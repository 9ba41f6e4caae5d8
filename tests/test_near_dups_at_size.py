"""Near duplicates: pairs that cannot be alike are not shuffled, whatever words they share; those that are come out exactly."""

import random

from evidentia.operators import neardup

KIND = "doc_id long, text string"


def texts():
    """Texts of 60 words of one small vocabulary, of which some are near copies, with nulls, shared ids and long texts."""
    rng = random.Random(3)
    words = [f"word{i}x" for i in range(400)]
    rows = [(i, " ".join(rng.sample(words, 60))) for i in range(900)]
    for i in range(900, 1000):
        rows.append((i, " ".join([*rows[i - 900][1].split()[: rng.randint(45, 60)], *rng.sample(words, rng.randint(0, 6))]).upper()))
    rows += [(2000 + i, " ".join(rng.sample(words, 380 - i))) for i in range(20)]
    return [*rows, (None, rows[0][1]), (None, "alone there"), (5, rows[7][1]), (3000, None), (3001, "a b c"), (3002, "")]


def brute(rows, least):
    classes = {}
    for i, text in rows:
        if found := frozenset(w for w in (text or "").lower().split() if len(w) > 3):
            classes.setdefault(found, []).append(i)
    first = {s: min(i for i in ids if i is not None) for s, ids in classes.items() if any(i is not None for i in ids)}
    out = {(a, b, 1.0) for s, a in first.items() for b in classes[s] if b is not None and b != a}
    for s, a in first.items():
        out |= {(a, b, len(s & t) / len(s | t)) for t, b in first.items() if a < b and len(s & t) >= least * len(s | t) - 1e-12}
    return out


def test_exact(spark):
    rows = texts()
    found = neardup.similar(spark.createDataFrame(rows, KIND)).collect()
    want = brute(rows, neardup.WARN)
    assert len(want) > 200
    assert sorted((r.a, r.b, round(r.jaccard, 9)) for r in found) == sorted((a, b, round(j, 9)) for a, b, j in want)


def test_few_pairs_are_left_to_compare(spark):
    """Each two of these texts share a word or more, and none but the copies share enough."""
    rows = [r for r in texts() if r[0] is not None and r[0] < 1000]
    sets = neardup._sets(spark.createDataFrame(rows, KIND), False).dropDuplicates(["node"])
    pairs = neardup.candidates(sets, neardup.WARN)
    assert pairs.count() <= 2 * len(brute(rows, neardup.WARN))
    assert pairs.selectExpr("least(u, v) AS a", "greatest(u, v) AS b").distinct().count() == pairs.count()
