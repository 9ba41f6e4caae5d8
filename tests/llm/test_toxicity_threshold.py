"""The threshold is taken from every learnable row that the network was not trained on."""

from zlib import crc32

from evidentia.llm import toxicity


def test_threshold_comes_from_all_unseen_rows(spark, monkeypatch):
    rows = [(i, f"{'vile nasty rude' if i % 4 == 0 else 'calm kind fair'} word{i % 50} and some more {i % 7}", int(i % 4 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    steps, seen = toxicity._steps, []
    monkeypatch.setattr(toxicity, "_steps", lambda of, model: seen.append(steps(of, model)) or seen[-1])
    model = toxicity.fit(docs, labels, per_label=30)
    part = [r for r in rows if crc32(str(r[0]).encode()) % 3 == 2]
    # at most about two thirds of 30 rows a label are trained on
    assert len(part) - 80 <= seen[0].clean.sum() + seen[0].toxic.sum() <= len(part)
    texts = {r[2]: r[1].encode() for r in rows}
    assert model.scores([texts[1]])[0] >= 0.7 > model.scores([texts[0]])[0]
