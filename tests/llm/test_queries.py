"""The registered queries on small tables of odd rows, against plain versions of the same."""

import json
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from evidentia.llm import queries, tokenfile

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "plain words of a text", "plain words of a text", "naïve café — “quoted”\n\ttabs  and   spaces \n", "a<|endoftext|>b <|endoftext|>", "émoji 🎉🎉 日本語 русский", "x" * 5000, "it's they'll 12345 ...\r\n", "word " * 3000, " nbsp line", " lead", "trail ", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(params=["odd", "empty"])
def rows(request, spark, tmp_path):
    found = [(i * 3 + 1, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)] if request.param == "odd" else []
    spark.createDataFrame(found, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    talk = [(c, t, role, text) for c in (1, 2, 7) for t, (role, text) in enumerate([("system", "be [INST] kind"), ("user", "</s>\\"), ("assistant", None), ("assistant", "yes [:] \\[INST]"), ("user", "")])] if found else []
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), found, talk


def run(spark, name, sf):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


def test_sharding(spark, rows):
    sf, docs, _ = rows
    found = run(spark, "op1_sharding", sf)
    assert sorted(r["doc_id"] for r in found) == [d[0] for d in docs]
    of, shards = {d[0]: d[1] for d in docs}, {}
    for r in found:
        text = of[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(0 <= s < 24 for s in shards)
    by_text = {}
    for r in found:
        by_text.setdefault((of[r["doc_id"]] is None, of[r["doc_id"]]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_are_balanced(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [(i, "y" * int(n) + str(i), "en", "s", 1) for i, n in enumerate(rng.lognormal(6, 1, 3000))]
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    loads = {}
    for r in run(spark, "op1_sharding", str(tmp_path)):
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert len(loads) == 24 and max(loads.values()) <= 1.01 * min(loads.values())


def test_token_files(spark, rows, library):
    sf, docs, _ = rows
    found, start = {r["doc_id"]: r for r in run(spark, "op2_token_files", sf)}, 0
    for doc_id, text, *_ in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = found.pop(doc_id)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert not found


def test_token_files_are_read_in_part(spark, tmp_path, library):
    docs = [(i, f"number {i} " * (i % 40 + 1), "en", "s", 1) for i in range(400)]
    target = f"{tmp_path}/tokens"
    tokenfile.write_tokens(spark.createDataFrame(docs, DOCUMENTS), target, public_tokenizers.path("byte_bpe_50k.json"), 2)
    want, start = {}, 0
    for i, text, *_ in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want[i] = (start, ids)
        start += len(ids)
    got = tokenfile.read_tokens(spark, target, ids=(100, 119), slices=(2, 5)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: want[i][1][2:5] for i in range(100, 120)}
    got = tokenfile.documents_at(spark, target, 5000, 5200).collect()
    assert {r.doc_id: (r.start, list(r.ids)) for r in got} == {i: w for i, w in want.items() if w[0] < 5200 and w[0] + len(w[1]) > 5000}
    late = tokenfile.documents_at(spark, target, start - 300, start - 100)
    assert {r.doc_id: (r.start, list(r.ids)) for r in late.collect()} == {i: w for i, w in want.items() if w[0] < start - 100 and w[0] + len(w[1]) > start - 300}
    low, high = min(r.doc_id for r in late.collect()), max(r.doc_id for r in late.collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = tokenfile.documents_at(spark, target, start - 300, start - 100)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual(doc_id,{low})" in plan and f"LessThanOrEqual(doc_id,{high})" in plan and "EqualTo(part,3)" in plan.replace("In(part, [3])", "EqualTo(part,3)")
    assert tokenfile.documents_at(spark, target, start, start + 9).isEmpty() and tokenfile.documents_at(spark, target, 0, 1).count() == 1
    plan = tokenfile.read_tokens(spark, target, ids=(100, 119)).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids:" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,100)" in plan
    for file in spark.read.parquet(target).inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 2 * tokenfile.ROW_GROUP
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert any("DICTIONARY" in e for e in column.encodings)


def test_bpe(spark, rows, library):
    sf, docs, _ = rows
    found = {r["doc_id"]: r for r in run(spark, "op4_bpe", sf)}
    assert len(found) == len(docs)
    for doc_id, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert found[doc_id]["n_tokens"] == len(ids), text
        assert found[doc_id]["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == sha256(told.encode()).hexdigest()


def test_tiff(spark, rows):
    sf, docs, _ = rows
    found, seen = {r["doc_id"]: r for r in run(spark, "op5_tiff", sf)}, {}
    assert len(found) == len(docs)
    for doc_id, text, *_ in docs:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = found[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:])), text
        same = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert seen.setdefault(raw, same) == same and r["media_bytes"] > 0


def test_chat(spark, rows):
    sf, _, talk = rows
    probe = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", probe), ("assistant", probe)]}
    for c, _, role, text in talk:
        turns.setdefault(c, []).append((role, text or ""))
    found = {r["conv_id"]: r for r in run(spark, "op9_chat", sf)}
    assert set(found) == set(turns)
    for c, said in turns.items():
        learned = "".join(t for role, t in said if role == "assistant")
        r = found[c]
        assert r["n_turns"] == len(said) and r["turns_sha256"] == sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha256(learned.encode()).hexdigest())


def test_toxicity_catches_and_leaves_alone(spark):
    sf = "/root/testdata/sf0.1"
    score = {r["doc_id"]: r for r in run(spark, "op7_toxicity", sf)}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(score[i], y) for i, y in labels if i in score and score[i]["held_out"]]
    caught = [r["predicted"] for r, y in held if y == 1]
    alarms = [r["predicted"] for r, y in held if y == 0]
    assert sum(caught) >= 0.75 * len(caught) > 0 and sum(alarms) <= 0.02 * len(alarms), json.dumps([sum(caught), len(caught), sum(alarms), len(alarms)])
