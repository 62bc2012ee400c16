"""A corpus of JSON files that grows: each call takes the files that are new or changed, and opens no other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.session import materialise, stored
from folioflow.sources.readers import DIGEST_SCHEMA, json_corpus

_FILE = "path string, length bigint, modificationTime timestamp"


def _beside(table: str, what: str) -> str:
    return f"{table.rstrip('/')}-{what}"


def take_new_files(spark: SparkSession, directory: str, table: str, schema: str = DIGEST_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Add the records of new files under ``directory`` to ``table``; returns the unreadable ones of this call.

    A file is new if the ledger ``<table>-ledger`` does not hold its path, size and time. Only file names are
    listed to find them. A call writes its records, what it could not read, and last its part of the
    ledger, each in a ``run=<n>`` folder, so a call that was lost halfway is simply made again and
    overwrites its folders. ``corpus_rows`` reads the table.
    """
    seen = stored(spark, _beside(table, "ledger"), _FILE + ", run int")
    run = (seen.agg(F.max("run")).first()[0] or 0) + 1
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(directory)
    listed = listed.select("path", "length", "modificationTime").where(~F.col("path").endswith("meta.json"))
    fresh = materialise(listed.join(seen, ["path", "length", "modificationTime"], "left_anti"), "new-files")
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r["path"]) for r in fresh.select("path").collect()]
    bad_path = f"{_beside(table, 'unreadable')}/run={run}"
    if not paths:
        return spark.createDataFrame([], "file_path string, source_file string, record string")
    good, bad = json_corpus(spark, paths, schema, multi_line)
    good.write.mode("overwrite").parquet(f"{table.rstrip('/')}/run={run}")
    bad.write.mode("overwrite").parquet(bad_path)
    fresh.write.mode("overwrite").parquet(f"{_beside(table, 'ledger')}/run={run}")
    return spark.read.schema(bad.schema).parquet(bad_path)


def corpus_rows(spark: SparkSession, table: str, schema: str = DIGEST_SCHEMA) -> DataFrame:
    """Records of every file as it was last taken; a changed file replaces its earlier records."""
    columns = "file_path string, run int"
    good = stored(spark, table, f"{schema}, source_file string, {columns}")
    bad = stored(spark, _beside(table, "unreadable"), columns)
    newest = good.select("file_path", "run").unionByName(bad.select("file_path", "run")).groupBy("file_path").agg(F.max("run").alias("run"))
    return good.join(newest, ["file_path", "run"], "left_semi").drop("run", "file_path")
