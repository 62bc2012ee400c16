"""File sources with declared schemas; ids are always text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.text import once

LABEL_SCHEMA = "id string, preference string"

DIGEST_SCHEMA = (
    "title string, authors array<string>, institution array<string>, problem_background string, method string, "
    "experiment string, one_sentence_summary string, slug string, keywords array<string>, further_thoughts string, "
    "model string, temperature double, top_p double, lang string, id string, preference string, summary_time string, "
    "score double, abstract string, categories array<string>, created string, updated string"
)

REACTION_SCHEMA = (
    "data struct<repository struct<discussions struct<nodes array<struct<id string, title string, updatedAt string, "
    "url string, reactions struct<nodes array<struct<content string, user struct<login string>>>>>>>>>"
)


def source_name(suffix: str) -> Column:
    """Name of the input file. A folder named like the file (``x.csv/part-...``) counts as the file."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"([^/=]+{suffix})(?:/[^/]*)?$", 1)


def scan_labels(spark: SparkSession, directory: str) -> DataFrame:
    """All label CSVs under ``directory``, with what is needed to order their lines.

    ``source_file`` names the month, ``file_path``, ``block_start`` and ``line`` give the position: rows
    of one file split are read in order, so an id that grows within the task orders the lines of a
    split, and the split's start offset orders the splits of a file. A folder without label files is an
    error: training on no labels would go unnoticed.
    """
    lines = (
        spark.read.schema(LABEL_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(directory)
    )
    if not lines.inputFiles():
        raise FileNotFoundError(f"no label files in {directory}")
    return lines.select(
        "id",
        "preference",
        source_name(r"\.csv").alias("source_file"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line"),
    )


def label_order() -> list[Column]:
    """``init.csv`` first, then months; later lines later."""
    part = F.coalesce(F.regexp_extract("file_path", r"/part-(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("part")
    return [(F.col("source_file") != "init.csv").alias("dated"), F.col("source_file"), part, *map(F.col, ("file_path", "block_start", "line"))]


def start_year(year_now: int, first_year: int, *starts: int) -> int:
    """First year to scan."""
    return max(first_year, min(year_now, *starts))


def scan_papers_by_year(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Papers of years ``first .. last`` from a table partitioned by ``year``.

    Years are pruned as partitions, so an absent year needs no special case; columns missing in some
    files are null.
    """
    return spark.read.option("mergeSchema", True).parquet(root).where(F.col("year").between(first, last))


def scan_year_files(spark: SparkSession, root: str, first: int, last: int, schema: str | None = None) -> DataFrame:
    """Papers of ``{root}/{year}.parquet`` for years ``first .. last``, with the ``year`` of the file.

    Only the files of these years are opened; each is a file or a folder. The last year may be absent, any
    other is an error. Columns missing in some files are null. With a ``schema`` no footer is read before the
    scan and its columns are there whatever the files hold; else the footers of the files are merged.
    """
    paths = [f"{root}/{year}.parquet" for year in range(first, last + 1)]
    if not paths:
        raise ValueError(f"no years from {first} to {last}")
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    try:
        papers = reader.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or len(paths) == 1:
            raise
        papers = reader.parquet(*paths[:-1])
    return papers.withColumn("year", F.regexp_extract(source_name(r"\.parquet"), r"^(\d+)", 1).cast("int"))


def scan_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_corpus(
    spark: SparkSession, directory: str | list[str], schema: str = DIGEST_SCHEMA, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Digest records under ``directory``: good rows with ``file_path`` and ``source_file``, and unreadable ones.

    A file is one record on any number of lines; without ``multi_line``, every line is one. Files whose stem
    ends in ``meta`` are left out before they are opened.
    """
    raw = (
        spark.read.text(directory, wholetext=multi_line, recursiveFileLookup=True)
        .withColumn("file_path", F.col("_metadata.file_path"))
        .where(F.col("file_path").rlike(r"\.json(/[^/]*)?$"))
        .withColumn("source_file", source_name(r"\.json"))
        .where(~F.col("source_file").endswith("meta.json") & (F.trim("value") != ""))
    )
    record = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    parsed = raw.select("file_path", "source_file", "value", once(record).alias("r"))
    readable = F.col("r._corrupt_record").isNull()
    good = parsed.where(readable).select("r.*", "file_path", "source_file").drop("_corrupt_record")
    return good, parsed.where(~readable).select("file_path", "source_file", F.col("value").alias("record"))


def json_corpus_to_table(spark: SparkSession, directory: str, table: str, multi_line: bool = True) -> DataFrame:
    """Write the good records as one parquet table; returns the unreadable ones. ``corpus.take_new_files`` adds to a table."""
    good, bad = json_corpus(spark, directory, multi_line=multi_line)
    good.write.mode("overwrite").parquet(table)
    return bad


def read_markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per markdown file: ``id`` is the file stem."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .where(F.col("_metadata.file_path").rlike(r"\.md(/[^/]*)?$"))
        .select(F.regexp_extract(source_name(r"\.md"), r"^(.*)\.md$", 1).alias("id"), F.col("value").alias("text"))
    )


def read_reactions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Discussion pages, one per file; without ``multi_line``, one per line."""
    return spark.read.schema(REACTION_SCHEMA).option("multiLine", multi_line).json(path)


def flatten_reactions(discussions: DataFrame) -> DataFrame:
    """``title, content, login`` per reaction; a discussion without any keeps one row with nulls."""
    nodes = discussions.select(F.explode("data.repository.discussions.nodes").alias("d"))
    return nodes.select(F.col("d.title").alias("title"), F.explode_outer("d.reactions.nodes").alias("r")).select(
        "title", F.col("r.content").alias("content"), F.col("r.user.login").alias("login")
    )
