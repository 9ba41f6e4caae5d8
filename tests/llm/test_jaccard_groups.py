"""Groups of near copies whose pairs lie around the threshold: exact components from few tests."""

import random

import pytest

from evidentia.llm import jaccard


def near_copies(count: int, least: int, most: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    base, out = [f"w{k}" for k in range(300)], []
    for i in range(count):
        words = list(base)
        for k in rng.sample(range(300), rng.randint(least, most)):
            words[k] = f"e{i}x{k}"
        out.append(" ".join(words))
    return out


def components(texts: list[str]) -> list[int]:
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [root(x) for x in range(len(sets))]


def found(spark, texts: list[str]) -> list[int]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.component_id for r in jaccard.jaccard_components(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize("least, most", [(2, 9)])
def test_tests_grow_with_the_group_and_not_with_its_square(spark, monkeypatch, least, most):
    tests, verified = [], jaccard._verified

    def counted(pairs, *rest):
        tests.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    texts = near_copies(300, least, most, 7)
    assert found(spark, texts) == components(texts)
    assert sum(tests) <= 15 * len(texts), tests


def test_chains_of_copies(spark):
    """Each text links with the next one only, so that leaders alone do not settle the components."""
    words = [f"c{k}" for k in range(600)]
    texts = [" ".join(words[10 * i : 10 * i + 100]) for i in range(40)] + ["apart from all the others here"]
    assert found(spark, texts) == components(texts)
