"""File streams that feed the label table and the published table.

Each micro-batch overwrites its own ``run=<number and query>/batch=<id>`` folder of a log, so a replayed batch
writes the same rows again, and a query with a new checkpoint gets a run of its own and overwrites nothing.
Tables are views over the log: its newest snapshot, one row per key, and the batches after it; see
``_current``. Only ``.json`` files and folders count, sub-folders too, files whose stem ends in ``meta`` do
not. Files hold one record each, on any number of lines, or one record per line. What cannot be read goes to
a second log beside the first, see ``unreadable_records``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from threading import Event
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from folioflow.operators.aggregates import rank_to_preference, reaction_rank
from folioflow.operators.filters import paper_id_filter
from folioflow.operators.joins import merge_tables
from folioflow.session import materialise, stored
from folioflow.sources.readers import DIGEST_SCHEMA, REACTION_SCHEMA

LABEL_LOG_SCHEMA = "discussion string, id string, updated string, rank int"

# Batches after a snapshot before the next one is written.
SNAPSHOT_AFTER = 20

# Files up to this size are read as a whole at once; of compressed ones the size says nothing.
WHOLE_BYTES = 8 << 20
_COMPRESSED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|xz|zst|zstd)$"

# Stands for a snapshot without a reaction of the owner; above every rank.
_NO_RANK = 1_000


def _file_stream(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """``file, size`` of the new files; none is opened."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = files.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(source)
    found = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return found.where(F.col("file").rlike(r"\.json(/[^/]*)?$") & ~F.col("file").rlike(r"meta\.json(/[^/]*)?$"))


def _read_files(spark: SparkSession, files: list[str], **options) -> DataFrame:
    """``value, file`` of text files named by their URIs; a name is no pattern."""
    if not files:
        return spark.createDataFrame([], "value string, file string")
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(f)) for f in files]
    return spark.read.text(paths, **options).select("value", F.col("_metadata.file_path").alias("file"))


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def _is_spread(line: Column) -> Column:
    """Whether a line that is not blank shows that records of its file run over several lines."""
    text = _strip(line)
    return text.isin("{", "[") | ~text.rlike(r"^[{\[]")


def _records() -> Column:
    """The texts of the records in ``value``, the text of a whole file."""
    opens = F.regexp_extract("value", r"^\s*([^\r\n]*?)\s*(?:[\r\n]|$)", 1).isin("{", "[")
    lines = F.filter(F.split("value", r"\r\n?|\n"), lambda x: _strip(x) != "")
    one = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull()
    return (
        F.when(opens, F.array("value"))
        .when(~F.exists(lines, _is_spread), lines)
        .when(one, F.array("value"))
        .otherwise(F.split("value", r"\r?\n"))
    )


def _texts(files: DataFrame, records: Column) -> DataFrame:
    """``value, file``: the text of each record.

    Where every line begins an object or a list and none is a lone bracket, a line is a record. Other files are one
    record, or by lines if that is no JSON and opens no bracket of its own. Small files are read once, as a whole;
    long ones by lines, and again as a whole if their lines say so.
    """
    spark = files.sparkSession
    # At most as many names as a batch has files.
    found = files.collect()
    long = [r.file for r in found if r.size > WHOLE_BYTES or re.search(_COMPRESSED, r.file)]
    whole = sorted({r.file for r in found}.difference(long))
    lines = None
    if long or not whole:
        lines = _read_files(spark, long).where(_strip(F.col("value")) != "")
        spread = [r.file for r in lines.groupBy("file").agg(F.max(_is_spread(F.col("value"))).alias("spread")).where("spread").collect()]
        lines = lines.where(~F.col("file").isin(spread))
        whole += spread
    if not whole:
        return lines
    texts = _read_files(spark, whole, wholetext=True).withColumn("value", F.ltrim("value", F.lit("\ufeff")))
    parts = texts.select(F.explode(records).alias("value"), "file").where(_strip(F.col("value")) != "")
    return lines.unionByName(parts) if lines is not None else parts


def _run_batches(
    stream: DataFrame, schema: str, readable: Column, transform, log: str, checkpoint: str, narrow=lambda rows: rows
) -> None:
    """``readable`` is a condition on the fields of ``schema``; records that fail it, or the parser, are logged as unreadable.

    Records are parsed once a batch: what ``narrow`` makes of them is kept for both logs. It keeps the column ``bad`` and
    a row for each record where that is not null; ``transform`` gets the other rows.
    """

    named, run = Event(), []
    records = _records()
    # A text with more behind its value is not one record, so it is parsed inside a list first.
    whole = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<variant>").isNotNull()
    parsed = F.explode_outer(F.when(whole, F.from_json("value", f"array<struct<{schema}>>"))).alias("r")
    bad = F.when(~F.coalesce(readable, F.lit(False)), F.struct("file", "value")).alias("bad")

    def store(batch: DataFrame, batch_id: int) -> None:
        named.wait()
        folder = f"run={run[0]}/batch={batch_id}"
        rows = _texts(batch, records).select("file", "value", parsed).select("file", "value", "r.*")
        rows = narrow(rows.withColumn("bad", bad).drop("file", "value")).persist()
        try:
            rows.where("bad IS NOT NULL").select("bad.*").write.mode("overwrite").parquet(f"{_unreadable(log)}/{folder}")
            transform(rows.where("bad IS NULL").drop("bad")).write.mode("overwrite").parquet(f"{log}/{folder}")
        finally:
            rows.unpersist()

    with _listing_by_cores(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        try:
            run.append(_run_name(stream.sparkSession, log, query.id))
        except BaseException:
            query.stop()
            raise
        finally:
            named.set()
        query.awaitTermination()


@contextmanager
def _listing_by_cores(spark: SparkSession) -> Iterator[None]:
    """A batch's files are looked up by as many tasks as there are cores, where Spark starts one for each file."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _run_name(spark: SparkSession, log: str, query_id: str) -> str:
    """The run of a query in a log: its number, so that later runs sort behind earlier ones, and the query's id.

    The id lies in the checkpoint, so a query that goes on keeps its run.
    """
    runs = [r["run"] for r in stored(spark, log, "run string").select("run").distinct().collect()]
    own = [r for r in runs if r.endswith(query_id)]
    return own[0] if own else f"{len(runs):06d}-{query_id}"


def _current(spark: SparkSession, log: str, schema: str, newest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``newest`` of all rows of a log, read from its newest snapshot and the batches after it.

    A snapshot is a table of its own, ``<log>-snapshots/version=<n>``, of what ``newest`` gives. It counts
    once the list of the runs and batches in it stands in ``<log>-covered``, which is written last, so
    a job that is lost between the two leaves the old snapshot valid. Batches in the list are not opened again.
    """
    fields = schema + ", run string, batch long"
    covered = stored(spark, f"{log.rstrip('/')}-covered", "upto string, last long, version int").collect()
    version = max((r["version"] for r in covered), default=0)
    last = {r["upto"]: r["last"] for r in covered if r["version"] == version}
    rows = stored(spark, log, fields)
    for run, batch in last.items():
        rows = rows.where(~((F.col("run") == run) & (F.col("batch") <= batch)))
    tail = [(r["run"], r["batch"]) for r in rows.select("run", "batch").distinct().collect()]
    if last:
        rows = rows.unionByName(spark.read.schema(fields).parquet(f"{log.rstrip('/')}-snapshots/version={version}"))
    if len(tail) < SNAPSHOT_AFTER:
        return newest(rows)
    for run, batch in tail:
        last[run] = max(batch, last.get(run, -1))
    path = f"{log.rstrip('/')}-snapshots/version={version + 1}"
    newest(rows).write.mode("overwrite").parquet(path)
    marks = spark.createDataFrame(sorted(last.items()), "upto string, last long").coalesce(1)
    marks.write.mode("overwrite").parquet(f"{log.rstrip('/')}-covered/version={version + 1}")
    return spark.read.schema(fields).parquet(path)


def _unreadable(log: str) -> str:
    return log.rstrip("/") + "-unreadable"


def unreadable_records(spark: SparkSession, log: str) -> DataFrame:
    """``file, value, run, batch`` of the records that a stream could not take into ``log``."""
    return spark.read.schema("file string, value string, run string, batch long").parquet(_unreadable(log))


def stream_upsert_labels(
    spark: SparkSession, source: str, published_ids: DataFrame, owner: str, log: str, checkpoint: str, files_per_batch: int = 1000
) -> DataFrame:
    """Take new reaction files into the log and return the label table.

    A batch stores the owner's lowest reaction rank per fetched discussion, null where there is none. A
    discussion without an id is known by its title.
    """
    stream = _file_stream(spark, source, files_per_batch)
    own = F.filter("d.reactions.nodes", lambda r: (r["user"]["login"] == owner) & (r["content"] != ""))

    def states(rows: DataFrame) -> DataFrame:
        nodes = rows.select("bad", F.explode_outer("data.repository.discussions.nodes").alias("d"))
        return nodes.select(
            "bad",
            F.coalesce("d.id", "d.title").alias("discussion"),
            F.col("d.title").alias("title"),
            F.coalesce("d.updatedAt", F.lit("")).alias("updated"),
            F.array_min(F.transform(own, lambda r: reaction_rank(r["content"]))).alias("rank"),
        )

    @cache
    def known() -> DataFrame:
        """Worked out by the first batch of a call, not by each. Few files, as every batch scans them and writes as many."""
        return materialise(published_ids.select("id").distinct().hint("rebalance"), "published-ids")

    def snapshots(found: DataFrame) -> DataFrame:
        return paper_id_filter(found, known(), distinct=True).select("discussion", "id", "updated", "rank")

    readable = F.col("data.repository.discussions.nodes").isNotNull()
    _run_batches(stream, REACTION_SCHEMA, readable, snapshots, log, checkpoint, states)
    return current_labels(spark, log)


def current_labels(spark: SparkSession, log: str) -> DataFrame:
    """One preference per paper from the newest snapshot of each of its discussions.

    Newest is the latest ``updatedAt``, then the latest run and batch; a reaction that is gone from it no longer
    counts. Snapshots that are equally new, and discussions of the same paper, give the lowest rank.
    """

    def newest(seen: DataFrame) -> DataFrame:
        place = F.struct("updated", "run", "batch", (-F.coalesce("rank", F.lit(_NO_RANK))).alias("minus"))
        found = seen.groupBy("discussion", "id").agg(F.max(place).alias("s"))
        rank = F.nullif(-F.col("s.minus"), F.lit(_NO_RANK)).cast("int").alias("rank")
        return found.select("discussion", "id", "s.updated", rank, "s.run", "s.batch")

    lowest = _current(spark, log, LABEL_LOG_SCHEMA, newest).where("rank IS NOT NULL").groupBy("id").agg(F.min("rank").alias("rank"))
    return lowest.select("id", rank_to_preference(F.col("rank")).alias("preference"))


def stream_ingest_summaries(
    spark: SparkSession, source: str, published: DataFrame, log: str, checkpoint: str, files_per_batch: int = 1000
) -> DataFrame:
    """Take new digest files into the log once and return the merged published table."""
    stream = _file_stream(spark, source, files_per_batch)
    _run_batches(stream, DIGEST_SCHEMA, F.col("id").isNotNull(), lambda batch: batch, log, checkpoint)
    return current_published(spark, published, log)


def current_published(spark: SparkSession, published: DataFrame, log: str) -> DataFrame:
    """Logged digests, the latest summary per id, merged over the published table."""
    digest = StructType.fromDDL(DIGEST_SCHEMA).fieldNames()
    fields = [c for c in digest if c != "id"]

    def newest(seen: DataFrame) -> DataFrame:
        whole = F.struct(*fields, "run", "batch")
        place = F.struct("run", "batch", "summary_time", F.to_json(F.struct(*fields)).alias("text"))
        return seen.groupBy("id").agg(F.max_by(whole, place).alias("d")).select("id", "d.*").select(*digest, "run", "batch")

    return merge_tables(_current(spark, log, DIGEST_SCHEMA, newest).select("id", *fields), published)
