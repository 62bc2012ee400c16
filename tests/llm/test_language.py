"""Language identification against plain averages of subword rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import language
from folioflow.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def grams(word):
    marked = f"<{word}>"
    found = [marked, *(marked[i : i + n] for n in language.GRAMS for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode()) % language.BUCKETS for g in found]


def test_subwords_are_checksums_of_grams():
    draw = random.Random(1)
    words = ["".join(draw.choices("abéß中\U0001f600z", k=draw.randint(1, 9))) for _ in range(300)] + ["x", "é" * 3000]
    owners, buckets = language.subwords(words)
    assert [sorted(buckets[owners == i].tolist()) for i in range(len(words))] == [sorted(grams(w)) for w in words]
    assert len(language.subwords([])[1]) == 0


def test_predictions_are_softmaxes_of_plain_averages(spark):
    draw = random.Random(2)
    of = {"aa": "der die das und haus katze", "bb": "the and house cat dog", "cc": "le la les maison chat"}
    rows = [(i, " ".join(draw.choices(of[lang].split(), k=draw.randint(1, 30))), lang) for i, lang in enumerate(draw.choices([*of], k=120))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    found = {r.doc_id: r for r in language.identify(docs, model, F.lit(False)).collect()}
    for i, text, _ in rows:
        buckets = [b for w in language.words_of(text) for b in grams(w)]
        logits = (np.mean([model.table[b] for b in buckets], axis=0) + model.bias) / model.temperature
        chances = np.exp(logits) / np.exp(logits).sum()
        assert found[i].lang_pred == model.languages[int(chances.argmax())]
        assert found[i].score == pytest.approx(chances.max())
        assert found[i].accepted == (found[i].score >= model.threshold)


def test_registered_query(spark):
    found = QUERIES["op1_language_id"](spark, SMALL)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.9
