import gzip
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.config import Settings
from folioflow.operators import aggregates
from folioflow.plans import streams
from folioflow.sources import corpus, readers, staging, writers
from folioflow.streaming import ingest
from tests.conftest import rows

PAGE = (
    '{"data": {"repository": {"discussions": {"nodes": [{"title": "x/2501.00001", "reactions": {"nodes": '
    '[{"content": "%s", "user": {"login": "me"}}]}}, {"title": "empty"}]}}}}'
)


def test_labels_stay_text_and_the_last_line_wins(spark, tmp_path):
    (tmp_path / "2025-04.csv").write_text("id,preference\n2410.1285,neutral\na,like\n")
    (tmp_path / "init.csv").write_text("id,preference\n2410.1285,dislike\nb,dislike\nb,like\na,dislike\n")
    (tmp_path / "note.txt").write_text("no labels")
    found = readers.scan_labels(spark, str(tmp_path))
    assert found.count() == 6
    latest = aggregates.dedupe_labels(found, readers.label_order())
    assert rows(latest) == [("2410.1285", "neutral"), ("a", "like"), ("b", "like")]


def test_missing_folder_is_an_error(spark, tmp_path):
    try:
        readers.scan_labels(spark, str(tmp_path / "nowhere")).collect()
    except Exception as error:
        assert "PATH_NOT_FOUND" in str(error)
    else:
        raise AssertionError("no error")


def test_json_corpus_leaves_out_meta_files_and_reports_broken_ones(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text('{"id": "a",\n "score": 0.5, "keywords": ["k"]}')
    (tmp_path / "deep" / "b.json").write_text('{"id": "b"')
    (tmp_path / "a.meta.json").write_text('{"id": "meta"}')
    bad = readers.json_corpus_to_table(spark, str(tmp_path), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "score", "source_file") == [("a", 0.5, "a.json")]
    assert rows(bad, "source_file") == [("b.json",)]


def test_markdown_of_one_file_or_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "2501.1.md").write_text("# A\ntext")
    (tmp_path / "x" / "b.md").write_text("B")
    (tmp_path / "x" / "c.txt").write_text("C")
    assert rows(readers.read_markdown_corpus(spark, str(tmp_path))) == [("2501.1", "# A\ntext"), ("b", "B")]
    assert rows(readers.read_markdown_corpus(spark, str(tmp_path / "2501.1.md"))) == [("2501.1", "# A\ntext")]


def test_reactions_with_missing_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text(PAGE % "HEART")
    found = readers.flatten_reactions(readers.read_reactions(spark, str(tmp_path)))
    assert rows(found) == [("empty", None, None), ("x/2501.00001", "HEART", "me")]


def test_label_month_is_created_then_merged(spark, tmp_path):
    as_of = datetime(2025, 4, 9)
    patch = spark.createDataFrame([("b", "like"), ("a", "like")], "id string, preference string")
    path = writers.write_label_month(patch, str(tmp_path), as_of, [F.col("preference")])
    assert Path(path).name == "2025-04.csv"
    writers.write_label_month(patch.where("id = 'a'").withColumn("preference", F.lit("dislike")), str(tmp_path), as_of, [F.col("preference")])
    assert rows(writers.read_label_month(spark, path)) == [("a", "dislike"), ("b", "like")]


def test_request_lines_keep_characters(spark, tmp_path):
    df = spark.createDataFrame([("é\n",)], "text string").select(F.struct("text").alias("request"))
    writers.write_requests_jsonl(df, str(tmp_path / "r"))
    assert rows(spark.read.text(str(tmp_path / "r"))) == [('{"text":"é\\n"}',)]


def test_a_folder_without_labels_is_an_error(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        readers.scan_labels(spark, str(tmp_path))


def test_start_year():
    assert readers.start_year(2025, 2017, 2024, 2023) == 2023
    assert readers.start_year(2025, 2017, 2010) == 2017


def test_label_stream_takes_files_once_and_a_replay_changes_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ids = spark.createDataFrame([("2501.00001",)], "id string")
    arguments = (spark, str(source), ids, "me", str(tmp_path / "log"), str(tmp_path / "state"))
    (source / "1.json").write_text(PAGE % "EYES")
    assert rows(ingest.stream_upsert_labels(*arguments)) == [("2501.00001", "neutral")]
    (source / "2.json").write_text(PAGE % "THUMBS_UP")
    assert rows(ingest.stream_upsert_labels(*arguments)) == [("2501.00001", "like")]
    assert rows(ingest.stream_upsert_labels(*arguments)) == [("2501.00001", "like")]
    # The same files from a fresh state overwrite the same batches.
    replay = ingest.stream_upsert_labels(*arguments[:5], str(tmp_path / "state2"), files_per_batch=1)
    assert rows(replay) == [("2501.00001", "like")]


def test_label_stream_follows_the_newest_state_of_a_discussion(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ids = spark.createDataFrame([("2501.00001",)], "id string")
    arguments = (spark, str(source), ids, "me", str(tmp_path / "log"), str(tmp_path / "state"))
    dated = PAGE.replace('"title": "x/', '"id": "D1", "updatedAt": "2025-01-0%d", "title": "x/')
    (source / "1.json").write_text(dated % (2, "THUMBS_UP"))
    assert rows(ingest.stream_upsert_labels(*arguments)) == [("2501.00001", "like")]
    (source / "2.json").write_text(dated % (3, "THUMBS_DOWN"))
    (source / "3.json").write_text(dated % (1, "EYES"))
    assert rows(ingest.stream_upsert_labels(*arguments)) == [("2501.00001", "dislike")]
    (source / "4.json").write_text((dated % (4, "EYES")).replace('"me"', '"someone"'))
    assert rows(ingest.stream_upsert_labels(*arguments)) == []


def test_summary_stream_keeps_the_latest_and_merges(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    published = spark.createDataFrame([("1", "old", "kept"), ("2", "only", None)], "id string, title string, abstract string")
    arguments = (spark, str(source), published, str(tmp_path / "log"), str(tmp_path / "state"))
    (source / "1.json").write_text('{"id": "1", "title": "first", "summary_time": "2025-01-01"}\n')
    ingest.stream_ingest_summaries(*arguments)
    (source / "2.json").write_text('{"id": "1", "title": "second", "summary_time": "2025-01-02"}\n{"id": "3", "title": "new"}\n')
    found = ingest.stream_ingest_summaries(*arguments)
    assert rows(found, "id", "title", "abstract") == [("1", "second", "kept"), ("2", "only", None), ("3", "new", None)]


def test_streams_take_pretty_printed_files_and_log_what_they_cannot_read(spark, tmp_path):
    source = tmp_path / "digests"
    (source / "a b").mkdir(parents=True)
    (source / "a b" / "one.json").write_text(json.dumps({"id": "1", "title": "one", "keywords": ["x", "y"]}, indent=4))
    (source / "lines.json").write_text('{"id": "2", "title": "two"}\n{"id": "3", "title"\n{"title": "no id"}\n')
    (source / "broken.json").write_text('{\n    "id": "4",\n    "title": \n')
    (source / "twice.json").write_text('{\n "id": "5"\n}\n{\n "id": "6"\n}\n')
    (source / "1.meta.json").write_text('{"id": "7", "title": "meta"}')
    stored = spark.createDataFrame([("9", "nine")], "id string, title string")
    log = str(tmp_path / "log")
    found = ingest.stream_ingest_summaries(spark, str(source), stored, log, str(tmp_path / "state"))
    assert rows(found, "id", "title") == [("1", "one"), ("2", "two"), ("9", "nine")]
    bad = ingest.unreadable_records(spark, log).collect()
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad) == ["broken.json", "lines.json", "lines.json", "twice.json"]

    pages = tmp_path / "pages"
    pages.mkdir()
    node = {"id": "d", "title": "posts/2501.00001", "reactions": {"nodes": [{"content": "THUMBS_UP", "user": {"login": "me"}}]}}
    (pages / "page.json").write_text(json.dumps({"data": {"repository": {"discussions": {"nodes": [node]}}}}, indent=2))
    (pages / "error.json").write_text(json.dumps({"errors": ["no"]}, indent=2))
    ids, log = spark.createDataFrame([("2501.00001",)], "id string"), str(tmp_path / "label-log")
    assert rows(ingest.stream_upsert_labels(spark, str(pages), ids, "me", log, str(tmp_path / "state2"))) == [("2501.00001", "like")]
    assert [r.file.rsplit("/", 1)[1] for r in ingest.unreadable_records(spark, log).collect()] == ["error.json"]


@pytest.mark.parametrize("whole_bytes", [0, ingest.WHOLE_BYTES])
def test_streams_read_small_and_long_files_alike(spark, tmp_path, monkeypatch, whole_bytes):
    monkeypatch.setattr(ingest, "WHOLE_BYTES", whole_bytes)
    source = tmp_path / "in"
    (source / "z.json").mkdir(parents=True)
    (source / "a {x}[1]*.json").write_text(json.dumps({"id": "1", "title": "é"}, indent=1))
    (source / "b.json").write_bytes(b'{"id": "2"}\r\n\r\n  {"id": "3"}\r[{"id": "4"}, {"id": "5"}]\n \n{"id": "6"')
    (source / "c.json").write_bytes(b'\xef\xbb\xbf{"id": "7"}\n')
    (source / "d.json").write_text('{"id": "8",\n"title": "two\\nlines"}')
    (source / "e.json").write_text('{"id": "9"} {"id": "x"}\nno record\n{"id": "10"}\n')
    (source / "f.json").write_text("\n\n")
    (source / "z.json" / "part-0.txt.gz").write_bytes(gzip.compress(b'{"id": "11"}\n{"id": "12"}\n'))
    log, stored = str(tmp_path / "log"), spark.createDataFrame([], "id string, title string")
    found = ingest.stream_ingest_summaries(spark, str(source), stored, log, str(tmp_path / "state"))
    assert {r.id: r.title for r in found.collect()} == {str(i): {1: "é", 8: "two\nlines"}.get(i) for i in (1, 2, 3, 4, 5, 7, 8, 10, 11, 12)}
    bad = sorted((r.file.rsplit("/", 1)[1], r.value) for r in ingest.unreadable_records(spark, log).collect())
    assert bad == [("b.json", '{"id": "6"'), ("e.json", "no record"), ("e.json", '{"id": "9"} {"id": "x"}')]


def test_a_call_works_out_the_published_ids_once_for_all_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(PAGE % "THUMBS_UP")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    # Published twice, so that an id that is listed again gives no second row.
    ids = spark.createDataFrame([("2501.00001",), ("2501.00001",)], "id string").select(counted("id").alias("id"))
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    found = ingest.stream_upsert_labels(spark, str(source), ids, "me", log, state, files_per_batch=1)
    assert rows(found) == [("2501.00001", "like")]
    assert spark.read.parquet(log).groupBy("batch").count().count() == spark.read.parquet(log).count() == 3
    assert seen.value == 2
    ingest.stream_upsert_labels(spark, str(source), ids, "me", log, state)
    assert seen.value == 2


def test_a_new_checkpoint_over_an_old_log_loses_nothing(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    log = str(tmp_path / "digests")
    stored = spark.createDataFrame([], "id string, title string, score double")
    for folder, ids in ((old, ("1", "2")), (new, ("2", "3"))):
        folder.mkdir()
        for i in ids:
            (folder / f"{i}.json").write_text(json.dumps({"id": i, "title": folder.name}, indent=1))
    (new / "note.md").write_text("no record")
    ingest.stream_ingest_summaries(spark, str(old), stored, log, str(tmp_path / "state1"))
    found = ingest.stream_ingest_summaries(spark, str(new), stored, log, str(tmp_path / "state2"))
    assert rows(found, "id", "title") == [("1", "old"), ("2", "new"), ("3", "new")]
    assert ingest.unreadable_records(spark, log).count() == 0


def test_snapshots_stand_for_the_batches_in_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "SNAPSHOT_AFTER", 2)
    log, ids = str(tmp_path / "log"), spark.createDataFrame([(f"2501.0000{i}",) for i in range(1, 5)], "id string")
    source = tmp_path / "pages"
    source.mkdir()

    def page(name, i, updated, content):
        reactions = [{"content": content, "user": {"login": "me"}}] if content else []
        node = {"id": f"d{i}", "title": f"2501.0000{i}", "updatedAt": updated, "reactions": {"nodes": reactions}}
        (source / f"{name}.json").write_text(json.dumps({"data": {"repository": {"discussions": {"nodes": [node]}}}}, indent=2))

    def run():
        return rows(ingest.stream_upsert_labels(spark, str(source), ids, "me", log, str(tmp_path / "state"), files_per_batch=1))

    page("a", 1, "1", "THUMBS_UP")
    page("b", 2, "1", "THUMBS_DOWN")
    first = run()
    assert [r[0] for r in first] == ["2501.00001", "2501.00002"]
    assert spark.read.parquet(f"{log}-covered").agg(F.max("last"), F.max("version")).first()[:] == (1, 1)
    # A snapshot that was lost before it was listed does not count.
    spark.createDataFrame([("x",)], "id string").write.parquet(f"{log}-snapshots/version=2")
    page("c", 1, "2", None)
    assert run() == [r for r in first if r[0] != "2501.00001"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = ingest.current_labels(spark, log)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "version=1]" in plan and "batch" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    page("d", 2, "0", "THUMBS_UP")
    page("e", 3, "1", "THUMBS_UP")
    found = run()
    assert [r[0] for r in found] == ["2501.00002", "2501.00003"] and found[0] == first[1]
    assert spark.read.parquet(f"{log}-covered").agg(F.max("version")).first()[0] == 2
    assert rows(ingest.current_labels(spark, log)) == found


def test_a_corpus_takes_new_and_changed_files_only(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    (source / "deep").mkdir(parents=True)
    (source / "a.json").write_text(json.dumps({"id": "a", "title": "one"}, indent=2))
    (source / "deep" / "b {x}.json").write_text(json.dumps({"id": "b", "title": "one"}, indent=2))
    (source / "c.json").write_text('{"id": ')
    (source / "a.meta.json").write_text("{}")
    assert rows(corpus.take_new_files(spark, str(source), table), "source_file") == [("c.json",)]
    assert rows(corpus.corpus_rows(spark, table), "id", "title") == [("a", "one"), ("b", "one")]
    assert corpus.take_new_files(spark, str(source), table).count() == 0
    (source / "c.json").write_text(json.dumps({"id": "c", "title": "mended"}, indent=2))
    (source / "a.json").write_text(json.dumps({"id": "a", "title": "changed"}, indent=2))
    # A call that was lost before its ledger was written is made again.
    spark.createDataFrame([("lost",)], "id string").write.parquet(f"{table}/run=2")
    assert corpus.take_new_files(spark, str(source), table).count() == 0
    assert spark.read.parquet(f"{table}/run=2").count() == 2
    assert rows(corpus.corpus_rows(spark, table), "id", "title") == [("a", "changed"), ("b", "one"), ("c", "mended")]
    (source / "a.json").write_text("broken now")
    assert corpus.take_new_files(spark, str(source), table).count() == 1
    assert rows(corpus.corpus_rows(spark, table), "id") == [("b",), ("c",)]


@pytest.mark.parametrize("stopped_at", ["write", "swap", "move"])
def test_a_month_survives_a_stop(spark, tmp_path, monkeypatch, stopped_at):
    as_of, order = datetime(2025, 4, 9), [F.col("preference")]
    old = spark.createDataFrame([("a", "like"), ("b", "like")], "id string, preference string")
    path = writers.write_label_month(old, str(tmp_path), as_of, order)

    def stop(*_):
        raise RuntimeError("stopped")

    patch = spark.createDataFrame([("a", "dislike")], "id string, preference string")
    with monkeypatch.context() as patched:
        if stopped_at == "move":
            moves = []
            move = staging._Folders.move

            def once(self, source, target):
                if moves:
                    stop()
                moves.append(source)
                move(self, source, target)

            patched.setattr(staging._Folders, "move", once)
        elif stopped_at == "swap":
            patched.setattr(staging, "swap", stop)
        else:
            patched.setattr(writers, "upsert_keep_last", stop)
        with pytest.raises(RuntimeError):
            writers.write_label_month(patch, str(tmp_path), as_of, order)
    stored = rows(writers.read_label_month(spark, path))
    assert stored == ([("a", "dislike"), ("b", "like")] if stopped_at == "move" else [("a", "like"), ("b", "like")])
    writers.write_label_month(patch, str(tmp_path), as_of, order)
    assert rows(readers.scan_labels(spark, str(tmp_path)), "id", "preference") == [("a", "dislike"), ("b", "like")]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_old")]


def test_pages_replace_pages(spark, tmp_path):
    lines = spark.createDataFrame([('{"id": "1"}',), ('{"id": "2"}',)], "value string")
    published = lines.select(F.from_json("value", readers.DIGEST_SCHEMA).alias("r")).select("r.*")
    writers.write_pages(published, str(tmp_path / "pages"))
    writers.write_pages(published.where("id = '2'"), str(tmp_path / "pages"))
    assert rows(spark.read.parquet(str(tmp_path / "pages")), "id") == [("2",)]


def test_year_files_and_an_absent_last_year(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "id string, n int").write.parquet(str(tmp_path / "2023.parquet"))
    spark.createDataFrame([("b",)], "id string").write.parquet(str(tmp_path / "2024.parquet"))
    spark.createDataFrame([("z", 9)], "id string, n int").write.parquet(str(tmp_path / "2020.parquet"))
    whole = [("a", 1, 2023), ("b", None, 2024)]
    for schema in (None, "id string, n int"):
        for last in (2024, 2025):
            assert rows(readers.scan_year_files(spark, str(tmp_path), 2023, last, schema), "id", "n", "year") == whole
    for first, last in ((2022, 2024), (2023, 2026), (2025, 2025)):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            readers.scan_year_files(spark, str(tmp_path), first, last)
    with pytest.raises(ValueError, match="no years"):
        readers.scan_year_files(spark, str(tmp_path), 2025, 2024)


def test_settings_file(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text(
        'content_repo = "x/y"\n[fit_predict]\ncategories = ["cs.CL"]\nseed = 7\nraw_data_dir = "./raw"\n'
        "[fit_predict.confidence_weighted_sampling]\nenable = false\n[fit_predict.logic_regression]\nC = 2\n"
        '[download_pdf]\ndelay = 3\n[summary]\nmodel = "m"\ntop_p = 0.5\n[settings]\npage_size = 9\n'
    )
    found = Settings.from_file(path, max_iter=5, as_of=datetime(2025, 1, 1))
    assert (found.categories, found.seed, found.confidence_weighting, found.regularisation_c) == (("cs.CL",), 7, False, 2.0)
    assert (found.top_p, found.page_size, found.max_iter, found.high_threshold) == (0.5, 9, 5, Settings.high_threshold)
    for line, match in (
        ("[fit_predict.predict]\nhigh_treshold = 0.9", "no setting fit_predict.predict.high_treshold"),
        ("[settings]\nnothing = 1", "no setting settings.nothing"),
        ("seed = 1", "no setting seed"),
        ('[fit_predict]\nseed = "1"', "is no int"),
        ("[fit_predict]\ncategories = [1]", "is no tuple"),
        ("[fit_predict.confidence_weighted_sampling]\nenable = 1", "is no bool"),
    ):
        path.write_text(line)
        with pytest.raises(ValueError, match=match):
            Settings.from_file(path)
    path.write_text("")
    assert Settings.from_file(path) == Settings()


def test_files_of_digests_grow_in_number_not_in_size(spark):
    digests = spark.createDataFrame([("a", "x" * 100), ("b", None), ("c", "é" * 50)], "id string, problem_background string")
    assert [streams.digest_files(digests, size) for size in (1000, 100, 10)] == [4, 4, 20]
    assert streams.digest_files(digests.limit(0)) == 4
