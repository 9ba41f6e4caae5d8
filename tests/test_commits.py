"""Two writers, corrections and pages over a committed ledger."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import commits as C
from evidentia.operators import ledger as L

CONTENT = "chain string, seq long, decision_id long, event_id long, decision string, override_action string, reason_code string, reason_text string, decided_at string, supersedes long, decision_source string"


def rows(spark, *decisions):
    return spark.createDataFrame([("a", i, i, event, said, None, None, None, f"t{i}", None, "analyst_ui") for i, event, said in decisions], CONTENT)


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(k, f"2024-01-0{k}", "RED" if k % 2 else "GREEN") for k in range(1, 6)], "event_id long, created_at string, headline string")


def test_one_of_two_writers_loses(spark, tmp_path, events, monkeypatch):
    path = f"{tmp_path}/ledger"
    assert C.read(spark, path) is None and C.version(spark, path) == 0
    assert C.append(path, rows(spark, (1, 1, "ACCEPT"), (2, 2, "REJECT")), events, 0) == 1
    # the second writer read the same version, but the first one has committed
    with pytest.raises(C.Conflict):
        C.append(path, rows(spark, (3, 3, "ACCEPT")), events, 0)
    # and here both are past that look when they commit
    put = C._put

    def raced(session, where, number, content):
        monkeypatch.setattr(C, "_put", put)
        C.append(path, rows(spark, (9, 3, "REJECT")), events, 1)
        put(session, where, number, content)

    monkeypatch.setattr(C, "_put", raced)
    with pytest.raises(C.Conflict):
        C.append(path, rows(spark, (4, 3, "ACCEPT")), events, 1)
    whole = C.read(spark, path)
    assert sorted(r.decision_id for r in whole.collect()) == [1, 2, 9] and C.version(spark, path) == 2
    assert len(list((tmp_path / "ledger" / "data").iterdir())) == 2 and not [f for f in (tmp_path / "ledger" / "commits").iterdir() if not f.name.strip(".").endswith(("json", "crc"))]
    assert L.verified(whole).where("edited or unlinked").isEmpty()
    assert [r.decision_id for r in C.read(spark, path, 1).orderBy("decision_id").collect()] == [1, 2]
    assert C.append(path, rows(spark, (5, 4, "ACCEPT")), events) == 3 and L.verified(C.read(spark, path)).where("edited or unlinked").isEmpty()


def test_corrections_supersede_what_stands(spark, tmp_path, events):
    path = f"{tmp_path}/ledger"
    with pytest.raises(C.Refused):
        C.correct(path, rows(spark, (1, 1, "ACCEPT")), events)
    C.append(path, rows(spark, (1, 1, "ACCEPT"), (2, 2, "REJECT")), events)
    C.correct(path, rows(spark, (3, 1, "REJECT")), events)
    C.correct(path, rows(spark, (4, 1, "ACCEPT")), events)
    whole = C.read(spark, path)
    assert {r.decision_id: r.supersedes for r in whole.collect()} == {1: None, 2: None, 3: 1, 4: 3}
    assert sorted(r.decision_id for r in L.current(whole).collect()) == [2, 4] and L.verified(whole).where("edited or unlinked").isEmpty()
    for wrong in ([(5, 3, "ACCEPT")], [(5, 1, "ACCEPT"), (6, 1, "REJECT")], [(5, 1, "MAYBE")]):
        with pytest.raises(C.Refused):
            C.correct(path, rows(spark, *wrong), events)
    with pytest.raises(C.Conflict):
        C.correct(path, rows(spark, (5, 2, "ACCEPT")), events, 2)
    assert C.version(spark, path) == 3


def test_pages(spark, events):
    decisions = rows(spark, (1, 1, "ACCEPT"), (2, 3, "REJECT"), (3, 4, "ACCEPT"))
    ids = lambda **of: [r.event_id for r in L.listed(events, decisions, **of).orderBy(F.desc("event_id")).collect()]
    assert ids() == [5, 4, 3, 2, 1] and ids(limit=2) == [5, 4] and ids(headline="RED") == [5, 3, 1] and ids(decision="UNREVIEWED") == [5, 2]
    assert ids(decision="ACCEPT") == [4, 1] and ids(decision="ACCEPT", headline="RED", limit=1) == [1] and ids(headline="BLUE") == []
