import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import coding, language, packing, quality, toxicity
from folioflow.llm.tokens import WORD_BPE, WordEncoder
from tests.llm.conftest import ROWS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def test_word_encoder_equals_the_tokenizer(tokenizer):
    draw = random.Random(1)
    letters = [*"aAÀßÉ é'sStdrl1²٣_-.,!|<>\t\n\r\x1c\x85 　́ǅİΣς中\U0001f600", "<|endoftext|>", "'re", "ª", "×", "\x00", " ", " "]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3000)] + [None, "", "b" * 5000]
    own = WordEncoder(WORD_BPE, cache_words=50)  # generations turn over
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        ids, offsets = own.encode(pa.array(part, type=pa.string()))
        expected = tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in expected]


def test_values_round_trip():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        values = (draw.integers(0, 1 << 32, n, dtype=np.uint64) >> draw.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = coding.encode_values(values)
        assert len(control) == -(-n // 4)
        assert coding.decode_values(control, data, n).tolist() == values.tolist()


def expected_ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_token_files_read_back(spark, odd, none, tokenizer):
    got = sorted(map(tuple, coding.token_files(odd).collect()), key=lambda r: r[1])
    rows = {(i, zlib.crc32(ids), len(ids)) for i, t, *_ in ROWS for ids in [expected_ids(tokenizer, t, 2)]}
    assert len(got) == len(ROWS) and {(i, crc, n) for i, _, n, crc in got} == rows
    assert [r[0] for r in got] == sorted([r[0] for r in ROWS], key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert coding.token_files(none).count() == 0


def test_packing_places_every_piece_once(odd, none, tokenizer):
    got = packing.best_fit_packing(odd).collect()
    pieces = sorted(
        (i or 0, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096]))
        for i, t, *_ in ROWS
        for ids in [expected_ids(tokenizer, t, 1)]
        for k in range(0, len(ids), 4096)
    )
    assert sorted((r.doc_id or 0, *tuple(r)[1:5]) for r in got) == pieces
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        ends = [0]
        for offset, length in sorted(found):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert packing.best_fit_packing(none).count() == 0


def test_packing_deals_repeated_rows_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_TOKENS", 1 << 11)
    rows = [(None, "the same few words again")] * 2000 + [(i, "other words") for i in range(500)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    tasks = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 2500 and len(tasks) > 3 and max(tasks.values()) < 2 * 2500 / len(tasks)


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.place(5) == (2, 0) and bins.place(9) == (3, 0)
    assert bins.place(8) == (4, 0)  # three open bins: the one with a single place left closes
    assert bins.place(1) == (4, 8)


def test_language_learns_and_rejects(spark, odd, none):
    rows = [(i, "der hund und die katze im haus" if i % 2 else "the dog and the cat in house", "de" if i % 2 else "en") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(odd, model, F.lit(False)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "en" and got[1].score == got[2].score
    assert {got[i].lang_pred for i in (3, 4, 8)} == {"und"} and not got[3].accepted
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none, model, F.lit(False)).count() == 0
    nothing = language.train(none)
    assert nothing is None and {r.lang_pred for r in language.identify(odd, nothing, F.lit(True)).collect()} == {"und"}


def test_trees_tell_loud_texts_apart(spark, odd, none):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    calm = [(i, " ".join(draw.choices(words, k=80)), 1) for i in range(150)]
    loud = [(i + 150, "!! ".join(draw.choices(words, k=80)).upper(), 0) for i in range(150)]
    docs = spark.createDataFrame(calm + loud, "doc_id bigint, text string, label int")
    model = quality.train(docs, docs.select("doc_id", "label"))
    got = quality.grade(docs, model, {"doc_id": F.col("doc_id"), "label": F.col("label")}).collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.98
    kept = quality.grade(odd, model, {c: F.col(c) for c in ("doc_id", "text", "source")})
    assert kept.count() == len(ROWS) and kept.columns == ["doc_id", "text", "source", "score", "predicted"]
    untrained = quality.train(none, none.select("doc_id", F.lit(1).alias("label")))
    assert {r.score for r in quality.grade(odd, untrained, {"doc_id": F.col("doc_id")}).collect()} == {0.5}
    assert quality.grade(none, model, {"doc_id": F.col("doc_id")}).count() == 0


def test_flat_trees_equal_a_plain_walk():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(400, 5))
    model = quality.fit(rows, (rows[:, 0] + rows[:, 1] ** 2 > 0.5).astype(float), trees=12, depth=3)
    bins = model.binned(rows)
    for row in range(20):
        total = model.prior
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if bins[row, model.feature[node]] <= model.limit[node] else model.right[node]
            total += model.value[node]
        assert model.score(rows[row : row + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_severity_grows_with_insults(spark, odd, none):
    draw = random.Random(5)
    words, bad = [f"calm{i}" for i in range(300)], ["nasty", "vile", "awful", "rotten"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = draw.choices(words, k=60) + (draw.choices(bad, k=draw.randint(1, 6)) if toxic else [])
        rows.append((i, " ".join(draw.sample(text, len(text))), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.train(docs, docs.select("doc_id", "label"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.severity(docs, model, {"doc_id": F.col("doc_id"), "label": F.col("label")}).collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.98
    tests = spark.createDataFrame([(1, "Vile nasty awful rotten calm1"), (2, "vile calm2"), (3, "calm3 " * 3000), (4, None)], "doc_id bigint, text string")
    by = {r.doc_id: r.severity for r in toxicity.severity(tests, model, {"doc_id": F.col("doc_id")}).collect()}
    assert by[1] > by[2] > by[3] == by[4]
    assert toxicity.severity(odd, model, {"doc_id": F.col("doc_id")}).count() == len(ROWS)
    clean = toxicity.train(none, none.select("doc_id", F.lit(1).alias("label")))
    assert {r.predicted for r in toxicity.severity(odd, clean, {"doc_id": F.col("doc_id")}).collect()} == {0}
