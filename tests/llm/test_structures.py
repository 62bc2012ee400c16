"""Fingerprints, filter audit and conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from folioflow.llm import audit, prefixhash, trie
from folioflow.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import ROWS, SCHEMA
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Prefix hashes


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_extensions_equal_plain_comparison(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab\0", k=draw.randint(0, 25))) for _ in range(200)] + ["", "é\U0001f600" * 900, "é\U0001f600" * 700 + "x"]
    rows = []
    for _ in range(1500):
        a, b = draw.choice(texts), draw.choice(texts)
        rows.append((a, draw.randint(0, len(a)), b, draw.randint(0, len(b)), "x"))
    rows += [(None, None, "a", 0, "x"), ("aa", 5, "aa", 0, "x"), ("aa", -1, "aa", 0, "x"), ("aab", None, "aac", 0, None)]
    frame = spark.createDataFrame(rows, "text_a string, start_a bigint, text_b string, start_b bigint, score string")
    found = prefixhash.common_extensions(frame).collect()
    for r in found:
        a, b, i, j = r.text_a or "", r.text_b or "", r.start_a or 0, r.start_b or 0
        inside = 0 <= i <= len(a) and 0 <= j <= len(b)
        assert r.extension == (common(a[i:], b[j:]) if inside else 0)
    assert len(found) == len(rows)
    assert prefixhash.common_extensions(frame.limit(0)).count() == 0


def ladders(texts):
    hashes = prefixhash.PrefixHashes(texts)
    return prefixhash.Ladders.of(hashes.lengths, lambda row, end, which: hashes.spans(row, np.zeros_like(end), end, which))


def covered(a, b):
    """Likeness from the texts themselves: rungs found from the front and from the end, by the stated rule."""
    step = int(max(prefixhash.step_of(np.array([len(a), len(b)]))))
    rungs = min(len(a), len(b)) // step
    if a == b:
        return 1.0
    marks = [set(), set()]
    for k in range(rungs):
        if a[k * step : (k + 1) * step] == b[k * step : (k + 1) * step]:
            for m in marks:
                m.update(range(k * step, (k + 1) * step))
        x, y = ((t[len(t) - (k + 1) * step : len(t) - k * step]) for t in (a, b))
        if x == y:
            for m, t in zip(marks, (a, b)):
                m.update(range(len(t) - (k + 1) * step, len(t) - k * step))
    return (len(marks[0]) + len(marks[1])) / (len(a) + len(b))


def test_likeness_equals_marked_code_points():
    draw = random.Random(5)
    base = "".join(draw.choices("abcdefgh", k=700))
    a, b = [], []
    for _ in range(400):
        text = base[draw.randint(0, 300) :][: draw.randint(0, 400)]
        other = list(text)
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(other))
            other[at : at + draw.randint(0, 9)] = draw.choices("xyz", k=draw.randint(0, 9))
        a.append(text)
        b.append("".join(other))
    a += ["", "", "same", "z" * 3000]
    b += ["", "x", "same", "z" * 2000]
    got = prefixhash.likeness(ladders(a), ladders(b))
    assert np.allclose(got, [covered(x, y) for x, y in zip(a, b)])
    assert np.allclose(got, prefixhash.likeness(ladders(b), ladders(a)))
    again = prefixhash.Ladders.parse(ladders(a).texts())
    assert np.allclose(prefixhash.likeness(again, prefixhash.Ladders.parse(ladders(b).texts())), got)




def check_edits(found, rows):
    """Every row once; each edited digest comes from some row that may follow in the order."""
    assert Counter((r.doc_id, r.n_chars) for r in found) == Counter((i, len(t or "")) for i, t in rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    ids = sorted((i for i in by_id if i is not None), reverse=True) + ([None] if None in by_id else [])
    after = dict(zip(ids, ids[1:] + ids[:1]))

    def edit(text, follow):
        cut = len(text) // 3
        return text[: len(text) - cut] + follow[:cut]

    seen = {}
    for r in found:
        texts = [t for t in by_id[r.doc_id] if len(t) == r.n_chars]
        follows = by_id[r.doc_id] + by_id[after[r.doc_id]] if len(by_id[r.doc_id]) > 1 else by_id[after[r.doc_id]]
        options = {hashlib.sha256(e.encode()).hexdigest(): (t, e) for t in texts for f in follows for e in [edit(t, f)]}
        assert r.edited_sha256 in options
        text, edited = options[r.edited_sha256]
        for print_, t in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert ladders([t]).texts()[0] == print_ or len(options) > 1
        assert seen.setdefault(r.fingerprint, text) == text or len(options) > 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edited_fingerprints_of_odd_rows(spark, odd, none):
    rows = [(i, t) for i, t, *_ in ROWS]
    check_edits(prefixhash.edited_fingerprints(odd).collect(), rows)
    assert prefixhash.edited_fingerprints(none).count() == 0
    single = spark.createDataFrame([(7, "abcdef", "x")], "doc_id bigint, text string, _part string")
    (row,) = prefixhash.edited_fingerprints(single).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0


def test_shares_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(prefixhash, "PART_BYTES", 2_000)
    draw = random.Random(9)
    rows = [(i, "".join(draw.choices("abc d", k=draw.randint(0, 90)))) for i in range(-300, 300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = {r.doc_id: r for r in prefixhash.edited_fingerprints(frame).collect()}
    texts = dict(rows)
    assert len(found) == len(rows)
    for i, text in rows:
        follow, cut = texts[i - 1 if i > -300 else 299], len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].edited_fingerprint == ladders([edited]).texts()[0]
        assert found[i].near_edited == pytest.approx(covered(text, edited))
        assert found[i].near_next == pytest.approx(covered(text, follow))


def test_a_repeated_row_fills_several_shares(spark, monkeypatch):
    monkeypatch.setattr(prefixhash, "REPEATS", 100)
    rows = [(5, "abcdefghi")] * 2000 + [(i, f"text {i}") for i in range(10, 1000)] + [(4, "xyz")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    result = prefixhash.edited_fingerprints(frame)
    found = result.where("doc_id = 5").groupBy("edited_sha256").count().collect()
    expected = {hashlib.sha256(b"abcdefabc").hexdigest(): 1999, hashlib.sha256(b"abcdefxyz").hexdigest(): 1}
    assert {r[0]: r[1] for r in found} == expected
    assert result.count() == len(rows)


# Filter audit


def failed(text, copy):
    words = WORD.findall(text)
    conditions = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": copy,
    }
    return {f for f, fails in conditions.items() if fails}


def walk(docs, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    smallest = {}
    for i, text, *_ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, *_ in docs:
        parts[lang or ""].append((failed(text or "", i is not None and i > smallest[text or ""]), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(gone)
                redundant = sum(f in r[0] and bool(r[0] & set(order[:step])) for r in rows)
                alone = sum(r[0] == {f} for r in rows)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(share[order[step - 1]])
    return out


def test_audit_equals_a_walk_through_all_orders(spark, odd, none):
    draw = random.Random(4)
    words = ["red", "FOX", "hill#", "a", "\x0b", "b c", "runs"]
    docs = [(i % 70, " ".join(draw.choices(words, k=draw.choice([0, 2, 120]))), draw.choice(["en", "fr", None, ""]), "s", "x") for i in range(90)]
    docs += [r for r in ROWS] + [(None, ROWS[0][1], "en", "a", "x"), (99, docs[0][1], "fr", "b", "x")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = audit.filter_audit(frame, marks).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) and got == walk(docs, labels)
    assert audit.filter_audit(none, marks).count() == 0
    assert audit.filter_audit(frame, marks.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_min_plus_takes_the_least_sum():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 50, (6, 4)), draw.integers(0, 50, (4, 9))
    assert (audit.min_plus(a, b) == (a[:, :, None] + b[None]).min(axis=1)).all()


# Conversation trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in sorted(built.items()):
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = set()
    for key, inside in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in inside if len(built[c]) == len(key))
        children = sum(len(k) == len(key) + 1 for k in below)
        above = members[key[:-1]][0] if key else None
        out.add((inside[0], len(key), above, len(inside), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(draw, n, deepest):
    said = ["yes", "no no", "", None, "well then\tgo"]
    return [
        (c, draw.choice([t, t, None]), draw.choice(["user", "bot", None]) if t % 2 else "user", draw.choice(said[:2] if t < 3 else said))
        for c in draw.sample(range(-60, 120), n)
        for t in range(draw.choice([1, 2, 4, deepest]))
    ]


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("limit", [1, 5, 2048])
def test_trie_equals_a_plain_one(spark, limit):
    rows = talks(random.Random(limit), 60, 14) + [(7, 1, "user", "yes")] * 3 + [(None, 1, "user", "yes")]
    frame = spark.createDataFrame(rows, CONVERSATION).withColumn("depth", trie.F.lit("clash")).repartition(5)
    turns, convs = trie.shared_beginnings(trie.materialise(trie.ordered_turns(frame), "t"))
    found = trie.prefix_trie(turns, convs, limit).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == plain_trie(rows)


def test_trie_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert trie.conversation_trie(none).count() == 0
    for rows in ([(1, 0, "user", "a b")], [(3, None, None, None)] * 2, [(c, 0, "user", "x") for c in range(1, 9)]):
        found = trie.conversation_trie(spark.createDataFrame(rows, CONVERSATION)).collect()
        assert set(map(tuple, found)) == plain_trie(rows)


def test_a_long_conversation_spreads_and_splits(spark):
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(900)] + [(41, t, "user", f"turn {t % 7}") for t in range(700)]
    frame = spark.createDataFrame(rows, CONVERSATION).repartition(6)
    turns, convs = trie.shared_beginnings(trie.materialise(trie.ordered_turns(frame), "t"))
    found = {(r.conv_id, r.depth): r for r in trie.prefix_trie(turns, convs, 60).collect()}
    assert len(found) == 901  # one line of turns, 41 ends on the way
    assert found[40, 0].saved_tokens == 2 * 700 and found[40, 0].n_leaves == 1
    assert found[40, 700].saved_tokens == 2 and found[40, 701].saved_tokens == 0
    assert found[40, 700].ends_sha256 == hashlib.sha256(b"41").hexdigest()


def test_centroid_totals_equal_plain_sums():
    draw = random.Random(6)
    for n in (0, 1, 2, 50, 400):
        parents = [-1 if i == 0 or draw.random() < 0.03 else draw.randrange(max(0, i - 5), i) for i in range(n)]
        values = [[draw.randint(0, 9) for _ in range(n)] for _ in range(2)]
        expected = [list(v) for v in values]
        for total in expected:
            for i in reversed(range(n)):
                if parents[i] >= 0:
                    total[parents[i]] += total[i]
        assert trie.centroid_totals(parents, values) == expected


def test_digests_join_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK", 20)
    rows = [(d, 0, 0, c) for d in range(3) for c in range(-5, 200)]
    found = trie.id_digests(spark.createDataFrame(rows, "depth bigint, k1 bigint, k2 bigint, conv bigint").repartition(4)).collect()
    assert {r.digest for r in found} == {hashlib.sha256(",".join(map(str, range(-5, 200))).encode()).hexdigest()} and len(found) == 3


# Registered queries


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE_SQL[name]) is None


def test_registered_fingerprints(spark):
    found = QUERIES["op11_fingerprints"](spark, SMALL)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert found.dtypes == [
        ("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"),
        ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    ]
    check_edits(found.collect(), docs)
