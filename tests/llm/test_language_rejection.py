"""The distance rejection: what was not learned goes, clean texts stay, short ones too."""

import base64
import random

import pytest

from evidentia.llm import langid

FOREIGN = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "chinese": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
}


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.fit(langid.learnable(docs))


def identified(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in langid.identify(rows, model).collect()}


def test_unlearned_texts_are_rejected(spark, fitted):
    chance = random.Random(5)
    words = lambda n: " ".join("".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randint(2, 9))) for _ in range(n))
    texts = [*FOREIGN.values(), words(30), words(300), words(3000), base64.b64encode(chance.randbytes(300)).decode(), base64.b64encode(chance.randbytes(3000)).decode()]
    found = identified(spark, fitted[1], texts)
    assert [i for i, r in found.items() if not r.rejected] == []


def test_clean_texts_stay(spark, fitted):
    docs, model = fitted
    held = docs.where("crc32(cast(doc_id as string)) % 3 = 1").select("text", "lang").collect()
    for cut in (None, 400, 100, 40):
        found = identified(spark, model, [r.text[:cut] for r in held])
        assert sum(r.rejected for r in found.values()) <= 0.01 * len(held), cut
