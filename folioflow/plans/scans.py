"""Sources and sinks: the bound tables are written in the file formats of the nightly run and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.operators.aggregates import dedupe_labels, reaction_to_label
from folioflow.operators.sampling import adaptive_quota
from folioflow.plans.bindings import OWNER, SETTINGS, VECTORS, Bound, with_ctes
from folioflow.plans.joining import quota_sql
from folioflow.plans.registry import query
from folioflow.session import materialise, scratch_path
from folioflow.sources import readers, writers

LABEL_FILE_SQL = """CASE WHEN d.updated < '2024-01-01' THEN 'init.csv' ELSE substr(d.updated, 1, 7) || '.csv' END"""


def by_file(rows: DataFrame, file: str, key: str) -> DataFrame:
    """Rows of a file side by side, so that a task writes few files; a large file is still split over tasks."""
    return rows.repartitionByRange(F.col(file), F.xxhash64(key))


@query(
    "scan_labels",
    with_ctes("docs", "label_rows")
    + f" SELECT l.id, l.preference, {LABEL_FILE_SQL} AS source_file FROM label_rows l JOIN docs d ON l.doc_id = d.doc_id",
)
def scan_labels(b: Bound) -> DataFrame:
    directory = scratch_path(b.spark, "labels")
    file = F.when(F.col("updated") < "2024-01-01", "init.csv").otherwise(F.concat(F.substring("updated", 1, 7), F.lit(".csv")))
    rows = b.labels.join(b.documents.select("id", "updated"), "id").select("id", "preference", file.alias("file"))
    by_file(rows, "file", "id").write.option("header", True).partitionBy("file").csv(directory)
    return readers.scan_labels(b.spark, directory).select("id", "preference", "source_file")


@query(
    "dedupe_labels",
    with_ctes("reactions")
    + """, log AS (SELECT id, CASE content WHEN 'THUMBS_UP' THEN 'like' WHEN 'HEART' THEN 'like' WHEN 'THUMBS_DOWN' THEN 'dislike'
        WHEN 'EYES' THEN 'neutral' ELSE 'unknown' END AS preference,
        content <> 'HEART' AS dated, strftime(ts, '%Y-%m-%d') AS day, event_id FROM reactions)
    SELECT id, arg_max(preference, CASE WHEN dated THEN [1::BIGINT, day_no, event_id] ELSE [0::BIGINT, 0::BIGINT, event_id] END) AS preference
    FROM (SELECT *, date_diff('day', date '2000-01-01', day::DATE) AS day_no FROM log) GROUP BY id""",
)
def dedupe_from_files(b: Bound) -> DataFrame:
    """Labels repeat over files and lines; the order comes from the files as written."""
    directory = scratch_path(b.spark, "label-log")
    kind = F.col("content")
    preference = F.when(kind.isin("THUMBS_UP", "HEART"), "like").when(kind == "THUMBS_DOWN", "dislike").when(kind == "EYES", "neutral")
    file = F.when(kind == "HEART", "init.csv").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")))
    log = b.reactions.select("id", preference.otherwise("unknown").alias("preference"), file.alias("file"), "event_id")
    ordered = log.repartitionByRange("file", "event_id").sortWithinPartitions("file", "event_id")
    ordered.drop("event_id").write.option("header", True).partitionBy("file").csv(directory)
    return dedupe_labels(readers.scan_labels(b.spark, directory), readers.label_order())


@query(
    "scan_papers_by_year",
    with_ctes("docs")
    + """ SELECT id, title, updated, 2016 + doc_id % 10 AS year, CASE WHEN 2016 + doc_id % 10 >= 2020 THEN lang END AS license
    FROM docs WHERE 2016 + doc_id % 10 BETWEEN 2019 AND 2026""",
)
def scan_papers_by_year(b: Bound) -> DataFrame:
    """Older years lack the licence column; the last year of the range has no files yet."""
    root = scratch_path(b.spark, "papers")
    dated = b.documents.withColumn("year", F.lit(2016) + F.col("doc_id") % 10).select(
        "id", "title", "updated", "year", F.col("lang").alias("license")
    )
    by_file(dated.where("year < 2020").drop("license"), "year", "id").write.partitionBy("year").parquet(root)
    by_file(dated.where("year >= 2020"), "year", "id").write.mode("append").partitionBy("year").parquet(root)
    first = readers.start_year(2026, SETTINGS.first_year, 2024, 2019)
    return readers.scan_papers_by_year(b.spark, root, first, 2026).select(
        "id", "title", "updated", F.col("year").cast("bigint").alias("year"), "license"
    )


@query(
    "scan_year_files",
    with_ctes("docs")
    + """ SELECT id, title, updated, 2016 + doc_id % 10 AS year, CASE WHEN 2016 + doc_id % 10 >= 2020 THEN lang END AS license
    FROM docs WHERE 2016 + doc_id % 10 BETWEEN 2019 AND 2026""",
)
def scan_year_files(b: Bound) -> DataFrame:
    """One table a year, older ones without the licence column; the last year of the range is not there yet."""
    root = scratch_path(b.spark, "paper-years")
    dated = materialise(
        b.documents.select("id", "title", "updated", F.col("lang").alias("license"), (F.lit(2016) + F.col("doc_id") % 10).alias("year")),
        "dated",
    )
    for year in range(2016, 2026):
        rows = dated.where(F.col("year") == year).drop("year")
        (rows.drop("license") if year < 2020 else rows).write.parquet(f"{root}/{year}.parquet")
    first = readers.start_year(2026, SETTINGS.first_year, 2024, 2019)
    found = readers.scan_year_files(b.spark, root, first, 2026, "id string, title string, updated string, license string")
    return found.select("id", "title", "updated", F.col("year").cast("bigint").alias("year"), "license")


@query(
    "scan_published",
    with_ctes("published")
    + " SELECT id, title, score, md5(problem_background) AS body_md5, array_to_string(keywords, ',') AS keywords FROM published",
)
def scan_published(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "published")
    b.published.write.parquet(path)
    return readers.scan_published(b.spark, path).select(
        "id", "title", "score", F.md5("problem_background").alias("body_md5"), F.array_join("keywords", ",").alias("keywords")
    )


@query(
    "json_corpus_to_table",
    with_ctes("docs", "digests")
    + """ SELECT CASE WHEN g.lang = 'es' THEN 'unreadable' ELSE 'ok' END AS status, d.source || '.json' AS source_file,
        CASE WHEN g.lang <> 'es' THEN g.id END AS id, CASE WHEN g.lang <> 'es' THEN md5(g.problem_background) END AS body_md5,
        CASE WHEN g.lang <> 'es' THEN g.score END AS score
    FROM digests g JOIN docs d ON g.doc_id = d.doc_id WHERE d.source <> 'src0'""",
)
def json_corpus_to_table(b: Bound) -> DataFrame:
    """One JSON file per source. Spanish records lack their last brace; the files of one source are side files."""
    corpus, table = scratch_path(b.spark, "corpus"), scratch_path(b.spark, "digests")
    line = F.to_json(F.struct(*[c for c in b.digests.columns if c != "doc_id"]))
    broken = F.when(F.col("lang") == "es", F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    source = b.documents.select("id", "source")
    file = F.concat("source", F.when(F.col("source") == "src0", "-meta").otherwise(""), F.lit(".json"))
    lines = b.digests.join(source, "id").select(broken.alias("value"), file.alias("file"))
    by_file(lines, "file", "value").write.partitionBy("file").text(corpus)
    bad = readers.json_corpus_to_table(b.spark, corpus, table, multi_line=False)
    good = b.spark.read.parquet(table)
    return good.select(
        F.lit("ok").alias("status"), "source_file", "id", F.md5("problem_background").alias("body_md5"), "score"
    ).unionByName(bad.select(F.lit("unreadable").alias("status"), "source_file"), allowMissingColumns=True)


@query("read_markdown_corpus", "SELECT printf('item-%d', item_id) AS id, text FROM benchmark")
def read_markdown_corpus(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "markdown")
    name = F.format_string("item-%d.md", F.col("item_id"))
    b.table("benchmark").select(F.col("text").alias("value"), name.alias("file")).write.partitionBy("file").text(path)
    # The text writer ends every record with a line break.
    whole = readers.read_markdown_corpus(b.spark, path)
    return whole.select("id", F.substr("text", F.lit(1), F.length("text") - 1).alias("text"))


@query("flatten_reactions", with_ctes("reactions") + " SELECT title, content, login FROM reactions")
def flatten_reactions(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "reactions")
    b.reaction_pages.write.json(path)
    return readers.flatten_reactions(readers.read_reactions(b.spark, path, multi_line=False))


@query(
    "write_predictions",
    quota_sql(SETTINGS.sample_rate) + ' SELECT id, title, updated, round(score, 6) AS score, "show" FROM flagged',
)
def write_predictions(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "predictions")
    scored = materialise(b.scored, "scored")
    flagged = adaptive_quota(scored, SETTINGS.sample_rate, SETTINGS.high_threshold, SETTINGS.boundary_threshold, SETTINGS.seed)
    writers.write_predictions(flagged, VECTORS, path)
    return b.spark.read.parquet(path).select(
        "id", "title", "updated", F.round("score", 6).alias("score"), F.col("show").cast("int").alias("show")
    )


@query(
    "write_label_month",
    with_ctes("label_rows", "reactions")
    + f""", patch AS (SELECT id, ['like','dislike','neutral','unknown'][1 + min(CASE content WHEN 'THUMBS_UP' THEN 0 WHEN 'HEART' THEN 0
        WHEN 'THUMBS_DOWN' THEN 1 WHEN 'EYES' THEN 2 ELSE 3 END)] AS preference FROM reactions WHERE login = '{OWNER}' GROUP BY id)
    SELECT coalesce(p.id, l.id) AS id, coalesce(p.preference, l.preference) AS preference
    FROM patch p FULL JOIN label_rows l ON p.id = l.id""",
)
def write_label_month(b: Bound) -> DataFrame:
    directory = scratch_path(b.spark, "months")
    writers.write_label_month(b.labels, directory, SETTINGS.as_of, [F.col("preference")])
    path = writers.write_label_month(reaction_to_label(b.reactions, OWNER), directory, SETTINGS.as_of, [F.col("preference")])
    return writers.read_label_month(b.spark, path)


INSTRUCTION = "Read the paper and answer in English."


@query(
    "write_requests_jsonl",
    f"""SELECT md5(to_json({{'contents': [{{'parts': [{{'text': '{INSTRUCTION}' || chr(10) || chr(10) || 'The content of the paper is as follows:'
        || chr(10) || chr(10) || chr(10) || text}}], 'role': 'user'}}],
        'config': {{'temperature': 0.1::DOUBLE, 'top_p': 0.8::DOUBLE, 'response_mime_type': 'application/json', 'response_schema': 'summary'}}}})::VARCHAR)
        AS line_md5 FROM documents""",
)
def write_requests_jsonl(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "requests")
    request = T.build_prompt_request(T.strip_references(F.col("text")), INSTRUCTION, response_schema="summary")
    writers.write_requests_jsonl(b.documents.select(request.alias("request")), path)
    return b.spark.read.text(path).select(F.md5("value").alias("line_md5"))


def page_sql(source: str) -> str:
    """Page text of every row of a published table."""
    nl = "chr(10)"
    gap = f"{nl} || {nl}"
    header = f" || {nl} || ".join(
        [
            "'---'",
            "'title: ' || coalesce(to_json(title)::VARCHAR, 'null')",
            "'slug: ' || to_json(id)::VARCHAR",
            """'description: "' || replace(one_sentence_summary, '"', '\\"') || '"'""",
            "'tags: ' || to_json(keywords)::VARCHAR",
            "'author: ' || to_json(model)::VARCHAR",
            "'pubDatetime: ' || summary_time",
            "'preference: ' || coalesce(to_json(preference)::VARCHAR, 'null')",
            "'score: ' || coalesce(round(score, 6)::DECIMAL(18,6)::VARCHAR, 'null')",
            "'featured: false'",
            "'draft: ' || coalesce(preference = 'dislike', false)::VARCHAR",
            "'---'",
        ]
    )
    body = f" || {gap} || ".join(
        [
            "'> ' || one_sentence_summary",
            "'> ' || array_to_string(keywords, ', ')",
            "'> ' || array_to_string(authors, ', ')",
            "'> ' || array_to_string(institution, ', ')",
            "'> Generated by ' || model",
            f"'## Background Problem' || {gap} || problem_background",
            f"'## Method' || {gap} || method",
            f"'## Experiment' || {gap} || experiment",
            f"'## Further Thoughts' || {gap} || further_thoughts",
        ]
    )
    return f" SELECT id, {header} AS header, {header} || {gap} || {body} AS page FROM {source}"


@query("write_pages", with_ctes("published") + ", pages_ AS (" + page_sql("published") + ") SELECT id, md5(page) AS page_md5 FROM pages_")
def write_pages(b: Bound) -> DataFrame:
    path = scratch_path(b.spark, "pages")
    writers.write_pages(b.published, path)
    return b.spark.read.parquet(path).select("id", F.md5("page").alias("page_md5"))
