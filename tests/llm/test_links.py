import itertools
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import graphann, licenses, mixing, multiindex, oddsketch
from folioflow.llm.components import connected_components
from folioflow.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import ROWS
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


def components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_paths_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300), (159, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {n: c for n, c in components({x for e in links for x in e}, links).items() if n in got} and len(got) == 102
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, components(sets, links)


def test_minhash_groups_equal_brute_force(spark, odd, none):
    draw = np.random.default_rng(4)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in draw.integers(0, 500, 120)]
        for _ in range(8):
            words = list(base)
            for at in draw.integers(0, len(words), draw.integers(0, 5)):
                words[at] = f"new{draw.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two three", "One  two\tthree", "", None, "a b c d e f", "a b c d e f g"])]
    got = {r.doc_id: r for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets, groups = near_groups(rows)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == groups
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    odd_rows = oddsketch.near_duplicates(odd).collect()
    assert len(odd_rows) == len(ROWS) and {r.component_id for r in odd_rows if r.doc_id in (1, 2)} == {1}
    assert oddsketch.near_duplicates(none).count() == 0


def test_one_row_of_each_group_with_null_and_repeated_ids(spark):
    """Repeated rows, groups without ids, an id of two texts: one row of every group stays, no other text goes."""
    import corpus_pipeline

    text = {n: " ".join(f"{n}{i}" for i in range(80)) for n in "abcdef"}
    near = {n: t + " more" for n, t in text.items()}
    rows = [
        (1, text["a"], "s"), (1, text["a"], "s"), (1, text["a"], "r"),  # repeats
        (None, text["b"], "s"), (None, text["b"], "s"), (None, near["b"], "s"),  # no id at all
        (2, text["c"], "s"), (None, text["c"], "s"), (None, near["c"], "s"),
        (3, text["d"], "s"), (4, near["d"], "s"), (4, text["e"], "s"),  # id 4: a duplicate and a clean text
        (5, text["f"], "s"), (5, "other words altogether", "s"), (6, near["f"], "s"),
        (7, "", "s"), (7, "", "s"), (8, None, "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(map(tuple, corpus_pipeline.one_of_near_duplicates(spark, docs, SMALL).collect()), key=repr)
    (without,) = [r for r in got if r[0] is None]
    assert without[1] in (text["b"], near["b"])
    whole = [
        (1, text["a"], "r"), (2, text["c"], "s"), (3, text["d"], "s"), (4, text["e"], "s"), (5, text["f"], "s"),
        (5, "other words altogether", "s"), (7, "", "s"), (7, "", "s"), (8, None, "s"), without,
    ]
    assert got == sorted(whole, key=repr)
    found = oddsketch.near_duplicates(docs).collect()
    assert len(found) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert oddsketch.decided(docs).where("kept").count() == len(whole)
    assert sorted(r.component_id for r in found if r.doc_id == 4) == [3, 4]


def test_torn_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A chain of texts, each near the next only, through blocks of two rows."""
    monkeypatch.setattr(oddsketch, "BLOCK_ROWS", 2)
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == near_groups(rows)[1]


def test_odd_sketch_estimates_difference():
    a = oddsketch.odd_sketch(oddsketch.minhash(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    assert len(a) == oddsketch.SKETCH_BITS // 64
    b = oddsketch.odd_sketch(oddsketch.minhash(np.arange(1, 420, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    assert np.bitwise_count((a ^ b).view(np.uint64)).sum() < oddsketch.MOST_BITS


VECTORS = "vec_id bigint, embedding array<float>, label int, n_links int"


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (900, None, 1, 0), (901, [0.0] * 8, 1, 0), (902, [1.0, None] + [0.0] * 6, 1, 0), (903, [nan] + [1.0] * 7, 1, 0),
        (904, [inf] + [1.0] * 7, 1, 0), (905, [1.0] * 8, None, 0), (906, [1.0] * 8, 1, 0), (907, [2.0] * 8, 1, 0), (908, [1.0] * 3, 1, 0),
        (909, [], 1, 0), (None, [1.0] * 8, 1, 0),
    ]


def test_multi_index_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(60, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 60] + draw.normal(size=8) * (0.12 if i >= 60 else 0)], int(i % 3), 0) for i in range(240)]
    rows += [(500 + i, rows[0][1], rows[0][2], 0) for i in range(30)] + odd_vectors()
    got = {r.vec_id: r for r in multiindex.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    used = {i: np.array(v) / np.linalg.norm(v) for i, v, lab, _ in rows if i is not None and (i < 900 or i in (906, 907, 908))}
    label = {i: lab for i, _, lab, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(used, 2) if len(used[a]) == len(used[b]) and label[a] == label[b] and used[a] @ used[b] >= 0.93]
    groups = components({i for i, *_ in rows if i is not None}, links)
    counts = {i: sum(i in e for e in links) for i in groups}
    found = sum(got[i].n_links for i in counts) / sum(counts.values())
    assert found >= 0.99 and all(got[i].n_links <= counts[i] for i in counts)
    assert found < 1 or {i: got[i].component_id for i in groups} == groups
    assert got[None].kept and got[905].n_links == 0 and got[906].component_id == got[907].component_id == 906
    assert multiindex.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_multi_index_keeps_vectors_of_one_id_apart(spark):
    """Ids 1 and 4 hold two vectors each: links, components and ``kept`` are those of the row."""
    a, w = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    b, c = [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0, 0.0]

    def near(v, at):
        return [x + (0.2 if i == at else 0.0) for i, x in enumerate(v)]

    rows = [(1, a), (1, w), (2, near(a, 5)), (3, near(w, 5)), (4, b), (4, near(b, 5)), (0, near(c, 5)), (9, c), (9, c)]
    table = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in multiindex.near_duplicates(table).collect())
    whole = [(0, 2, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    assert got == whole + [(9, 2, 0, False)] * 2


def test_places_count_the_nearer_cells():
    draw = np.random.default_rng(10)
    index = multiindex.fit(draw.normal(size=(300, 10)), 36)
    rows, partners = draw.normal(size=(2, 40, 10))
    every = len(index.halves[0]) * len(index.halves[1])
    assert (index.places(rows, partners) == (index.sequence(rows, every) == index.cells(partners)[:, None]).argmax(axis=1)).all()


def test_multi_sequence_is_the_order_of_the_product_grid():
    draw = np.random.default_rng(8)
    index = multiindex.fit(draw.normal(size=(300, 10)), 36)
    rows = draw.normal(size=(20, 10))
    first, second = index.distances(rows)
    whole = (first[:, :, None] + second[:, None, :]).reshape(20, -1)
    got = index.sequence(rows, 9)
    assert np.allclose(np.take_along_axis(whole, got, axis=1), np.sort(whole, axis=1)[:, :9])
    assert (got[:, 0] == index.cells(rows)).all()


def test_graph_search_recall_ties_and_odd_rows(spark):
    draw = np.random.default_rng(9)
    base = [[float(np.float32(x)) for x in v] for v in draw.normal(size=(900, 16))]
    rows = [(i, v, 0, 0) for i, v in enumerate(base)] + [(2000 + i, base[0], 0, 0) for i in range(40)] + odd_vectors()
    table = spark.createDataFrame(rows, VECTORS)
    got = graphann.nearest(table, table.where("vec_id % 20 = 0 OR vec_id = 901"), shard_rows=300).collect()
    used = {i: np.array(v) for i, v, *_ in rows if i is not None and i < 900 or i is not None and i >= 2000}
    names = np.array(list(used))
    points = np.stack(list(used.values()))
    hit = 0
    asked = [i for i in used if i % 20 == 0]
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert all(r.score == pytest.approx(float(used[q] @ used[r.vec_id]), abs=1e-12) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        scores = np.where(names == q, -np.inf, points @ used[q])
        best = names[np.lexsort((names, -scores))[:20]]
        hit += len(set(best.tolist()) & {r.vec_id for r in mine})
    assert hit >= 0.97 * 20 * len(asked)
    assert not [r for r in got if r.query_id in (901, 900)]
    few = graphann.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"))
    assert {r.vec_id for r in few.collect()} == {1, 2}
    empty = spark.createDataFrame([], VECTORS)
    assert graphann.nearest(empty, empty).count() == 0


def test_graph_search_of_lengths_over_many_decades(spark):
    """Lengths from 1e-3 to 1e3, one of 1e7, one whose square is no double: the short vectors' neighbours are found too."""
    draw = np.random.default_rng(15)
    base = draw.normal(size=(1500, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base *= 10.0 ** draw.uniform(-3, 3, size=(1500, 1))
    base[7] *= 1e7 / np.linalg.norm(base[7])
    base[9] *= 1e200 / np.linalg.norm(base[9])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for points, asked in ((table, table.where("vec_id % 20 = 0")), (table.where("vec_id NOT IN (7, 9)"), table.where("vec_id % 50 = 0"))):
        got = {}
        for r in graphann.nearest(points, asked, shard_rows=300).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        names = np.array([r.vec_id for r in points.select("vec_id").collect()])
        hit = 0
        for q in got:
            scores = np.where(names == q, -np.inf, base[names] @ base[q])
            hit += len(set(names[np.lexsort((names, -scores))[:20]].tolist()) & got[q])
        assert len(got) == asked.count() and hit >= 0.95 * 20 * len(got)
    short = table.where("vec_id NOT IN (7, 9)").select("vec_id", F.transform("embedding", lambda x: x / 1e9).alias("embedding"))
    assert graphann.nearest(short, short.where("vec_id = 0")).count() == 20


def test_graph_search_counts_ids_not_rows(spark):
    """One row 30 times, every row twice, an id with two vectors: still 20 different neighbours in one shard."""
    draw = np.random.default_rng(12)
    base = [[float(np.float32(x)) for x in v] for v in draw.normal(size=(60, 8))]
    hot = [3.0 * x for x in base[0]]
    rows = [(i, v, 0, 0) for i, v in enumerate(base)] * 2 + [(100, hot, 0, 0)] * 30 + [(101 + i, hot, 0, 0) for i in range(25)] + [(5, base[6], 0, 0)]
    table = spark.createDataFrame(rows, VECTORS)
    got = graphann.nearest(table, table.where("vec_id IN (0, 7)").dropDuplicates(["vec_id"])).collect()
    for q in (0, 7):
        best = {}
        for i, v, *_ in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.array(v) @ np.array(base[q])))
        whole = sorted(best, key=lambda i: (-round(best[i], 9), i))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == whole


def test_mix_reaches_targets(spark, odd, none):
    draw = np.random.default_rng(1)
    rows = [(i, "w " * int(draw.integers(1, 60)), "s%d" % (0 if i % 3 else i % 7)) for i in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sums = {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sums.setdefault((r.source, r.target, r.source_size), []).append(r.taken)
    assert sum(t for _, t, _ in sums) == pytest.approx(1.5 * sum(s for *_, s in sums))
    for (_, target, size), taken in sums.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= 60
    again = mixing.mix_sources(odd, keep=["lang"]).collect()
    assert len(again) == len(ROWS) and {r.size for r in again if r.doc_id in (3, 4)} == {0}
    assert mixing.mix_sources(none).count() == 0


def test_mix_of_repeated_rows_and_rows_without_an_id(spark):
    rows = [(None, "w " * (i % 5), "a") for i in range(700)] + [(7, "x y z", "a")] * 700 + [(i, "u v", "b") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5
    again = mixing.mix_sources(table.repartition(3)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, got)))


def test_licences_inherit_from_the_nearest_directory(spark):
    files = [
        ("a/LICENSE", "Some words\nLicensed under the Apache License, Version 2.0.\nmore", 1),
        ("a/b/x.txt", "nothing here", 2),
        ("a/b/c/COPYING", "Released under the MIT License.", 3),
        ("a/b/c/d/y.txt", "", 4),
        ("a/b/c/d/z.txt", "text\n" * 2000 + "This work is licensed under the GNU General Public License, version 3.", 5),
        ("other/x.txt", None, 6),
        (None, "Licensed under CC BY-NC 4.0.", 7),
        ("a/b/x.txt", "nothing here", 2),
    ]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string, line int")).collect()
    found = {(r.line, r.license, r.origin, r.origin_dir) for r in got}
    assert found == {
        (1, "Apache-2.0", "file", None), (2, "Apache-2.0", "inherited", "a"), (3, "MIT", "file", None), (4, "MIT", "inherited", "a/b/c"),
        (5, "GPL-3.0", "header", None), (6, None, None, None), (7, "CC-BY-NC-4.0", "header", None),
    }
    assert len(got) == len(files)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def wrapped(text, width=76, prefix=""):
    return "\n".join(prefix + line for line in textwrap.wrap(" ".join(text.split()), width))


def test_whole_licence_files_and_headers(spark):
    text = {}
    for name, _, body in licenses.parsed_templates():
        text[name] = max(text.get(name, ""), body, key=len)
    rest = "\n\n" + "\n".join(f"clause {i} of a long text that no template holds, word{i}" for i in range(400))
    gpl = "the Free Software Foundation\nEveryone is permitted to copy and distribute verbatim copies\nof this license document"
    lesser = "\nThe GNU Lesser General Public License version 3 may be what you want to do.\n"
    files = [
        ("MIT", "mit/LICENSE", "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + wrapped(text["MIT"]), "file"),
        ("MIT", "mit2/LICENSE.txt", "Copyright (c) 2024 A. Person\n\n" + wrapped(text["MIT"], 60), "file"),
        ("BSD-3-Clause", "bsd3/COPYING", "Copyright (c) 2024, A. Person\nAll rights reserved.\n\n" + wrapped(text["BSD-3-Clause"]), "file"),
        ("BSD-2-Clause", "bsd2/LICENSE", "Copyright (c) 2024, A. Person\n\n" + wrapped(text["BSD-2-Clause"]), "file"),
        ("ISC", "isc/LICENSE", "Copyright 2024 A. Person\n\n" + wrapped(text["ISC"]), "file"),
        ("Apache-2.0", "ap/LICENSE", "\n   Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n" + rest, "file"),
        ("GPL-3.0", "g3/COPYING", "  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 " + gpl + rest + lesser, "file"),
        ("GPL-2.0", "g2/COPYING", "  GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright (C) 1989 " + gpl + rest + lesser, "file"),
        ("LGPL-2.1", "l2/COPYING", "  GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n" + rest, "file"),
        ("MPL-2.0", "mpl/LICENSE", "Mozilla Public License Version 2.0\n====\n\n1. Definitions\n" + rest, "file"),
        ("MIT", "src/a.py", "# SPDX-License-Identifier: MIT\nimport os\n", "header"),
        ("BSD-3-Clause", "src/b.c", "/* SPDX-License-Identifier: BSD-3-Clause */\nint main() { return 0; }\n", "header"),
        ("CC-BY-NC-ND-4.0", "src/c.md", "SPDX-License-Identifier: CC-BY-NC-ND-4.0\n", "header"),
        ("GPL-2.0", "src/d.txt", "GNU General Public License, version 2", "header"),
        ("GPL-3.0", "src/e.py", wrapped("This program is free software: you can redistribute it and/or modify it " + text["GPL-3.0"], 72, "# "), "header"),
        ("GPL-2.0", "src/f.py", wrapped("This program is free software; you can redistribute it and/or modify it " + text["GPL-2.0"], 72, "# "), "header"),
        ("CC-BY-SA-4.0", "src/g.md", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "header"),
        ("MIT", "src/h.js", "// Copyright A. Person\n//\n" + wrapped(text["MIT"], 70, "// ") + "\nlet x = 1\n", "header"),
        ("MIT", "src/i.md", "# Project\n\nText.\n\n## License\n\nMIT\n", "header"),
        (None, "src/j.txt", "A driving licence is needed. With permission of the owner, you may use the car.", None),
        (None, "src/k.txt", "SPDX-License-Identifier: Proprietary", None),
        (None, "src/l.txt", "Redistribution of wealth was discussed at length in the parliament.", None),
    ]
    columns = "want string, path string, text string, score string, template string, others int, origin int"
    table = spark.createDataFrame([(want, path, body, "x", origin, 1, 2) for want, path, body, origin in files], columns)
    scanned = licenses.scan(table)
    assert scanned.columns == ["want", "path", "template", "others", "license", "score", "origin", "origin_dir"]
    got = {r.path: (r.license, r.origin) for r in scanned.collect()}
    assert got == {path: (want, origin) for want, path, _, origin in files}


def test_marker_loses_no_match():
    """Each template has a needed word that the marker finds, and a whole text's is one that opens it."""
    for _, needs, text in licenses.parsed_templates():
        assert any(re.search(licenses.MARKER, word) for word in needs), text
        assert set(needs) <= set(re.findall(licenses.TERM, text.lower()))
        assert len(text) < 500 or any(re.search(licenses.OPENING, word) for word in needs)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE_SQL[name]) is None


def test_pipeline_decisions_take_effect(spark):
    import corpus_pipeline
    from folioflow.llm.common import table
    from folioflow.session import materialise

    docs = table(spark, SMALL, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SMALL), f"test-{name}"))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    raw, good, civil, single, mix, packed = ([tuple(r) for r in d.collect()] for d in seen)
    assert set(civil) <= set(good) <= set(raw) and len(civil) < len(good) < len(raw)
    _, groups = near_groups([(r[0], r[1]) for r in civil])
    assert {r[0] for r in single} == {i for i, c in groups.items() if i == c}
    copies = {r[0]: mix.count(r) for r in single}
    targets = {}
    for r in mixing.mix_sources(seen[3]).collect():
        assert copies[r.doc_id] == r.copies
        targets.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert mix and set(mix) <= set(single)
    assert all(abs(taken - target) <= 20_000 for target, taken in targets.values())
    assert {r[0] for r in packed} == {r[0] for r in mix}


def test_columns_of_any_name_pass_through_the_pipeline(spark, odd):
    import corpus_pipeline

    names = ["score", "size", "predicted", "row", "copies", "_copy", "_kept_9", "a.b", "n_shingles", "Piece"]
    docs = odd.select("doc_id", "text", "source", *[F.col("lang").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert found.columns == docs.columns, name
        assert {tuple(r)[3:] for r in found.collect()} <= {(r.lang,) * len(names) for r in odd.collect()}
    assert corpus_pipeline.packed(spark, docs, SMALL).count() > 0
