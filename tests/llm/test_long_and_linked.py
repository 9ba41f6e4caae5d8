"""Long lines, components, windows that many items share."""

import random
import time

from evidentia.llm import decontaminate, linededup
from evidentia.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def test_long_lines_take_time_in_proportion(spark):
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefghij klmno", k=300_000))
    at = 145_678
    rows = [(1, line), (2, line[:at] + "#" + line[at + 1 :]), (3, line[:at] + line[at + 1 :]), (4, line[:1000] + "!" + line[1000:]), (5, "#" + line[1:-1] + "#"), (6, line[::-1])]
    began = time.time()
    out = {r.row.doc_id: list(r.dropped) for r in linededup.line_decisions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: [], 2: [0], 3: [0], 4: [0], 5: [], 6: []}
    assert time.time() - began < 120


def edits(line: str, rng: random.Random) -> str:
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + "?" + line[k + 1 :], line[:k] + "?" + line[k:], line])


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def test_lines_of_all_lengths_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for n in (1, 9, 10, 19, 20, 21, 40, 511, 512, 513, 1023, 1024, 1025, 1536, 1537, 3000):
        line = "".join(rng.choices("abc déf", k=n))
        rows += [line, *[edits(line, rng) for _ in range(4)]]
    docs = list(enumerate(rows))
    for least, fuzzy in ((10, 20), (1, 12)):
        out = {r.row.doc_id: list(r.dropped) for r in linededup.line_decisions(spark.createDataFrame(docs, SCHEMA), least, fuzzy).collect()}
        for i, line in docs:
            earlier = rows[:i]
            gone = len(line) >= least and (line in earlier or (len(line) >= fuzzy and any(len(o) >= fuzzy and near(line, o) for o in earlier)))
            assert out[i] == [0] * gone, (least, i, len(line))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {x: x for a, b in links if a is not None for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_window_that_all_items_share(spark):
    head = " ".join(f"h{k}" for k in range(13))
    items = spark.createDataFrame([(k, f"{head} own{k}") for k in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, head), (2, f"x {head} own7"), (3, "nothing of it"), (None, None)], SCHEMA)
    found = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert found == {1: (13, 50, True), 2: (14, 50, True), 3: (0, 0, False), None: (0, 0, False)}
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    clean = decontaminate.decontaminate(docs, items.where("false")).collect()
    assert len(clean) == 4 and not any(r.contaminated for r in clean)
