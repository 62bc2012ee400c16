"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.common import small_batches, text_slices
from folioflow.llm.tokens import WORD_BPE, encoder
from folioflow.session import materialise, scratch_path

# Ids of one block of a file at most, unless a single document is longer.
BLOCK_IDS = 1 << 18
# Coded bytes of one file, about.
FILE_BYTES = 128 << 20
# Blocks of a file in one Arrow batch when files are read.
_BATCH_BLOCKS = 16
# Documents whose ids are counted at a time.
_COUNTED_ROWS = 256

# Four 2-bit lengths per control byte: _LENGTHS[control] are the bytes of its four values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values; small values take one byte."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    lengths = extra + np.uint8(1)
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    data[starts] = values.astype(np.uint8)
    for byte in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > byte)
        data[starts[longer] + byte] = (values[longer] >> np.uint32(8 * byte)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: lengths by table lookup, places by a running sum, bytes by gathering."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    values = raw[starts].astype(np.uint32)
    for byte in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > byte)
        values[longer] |= raw[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def tokenize(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """One row per document: its ids and ``end_id`` as little-endian numbers, and how many they are.

    A number has two bytes where the vocabulary allows it, else four; ranks, and so the code of the
    files, are only known when all ids are counted. A null or empty text holds only ``end_id``. Rows
    with a null or repeated ``doc_id`` are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = encoder(tokenizer)
        width = 2 if max(used.vocabulary, end_id + 1) <= 1 << 16 else 4
        for batch in text_slices(batches):
            ids, offsets = used.encode(batch.column("text"))
            ended = np.insert(ids, offsets[1:], end_id).astype(f"<u{width}")
            sizes = np.diff(offsets) + 1
            places = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
            plain = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(ended)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, type=pa.int64()), plain], names=["doc_id", "n_tokens", "ids"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary"
    )


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, over all documents; each Arrow batch sends only the ids it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(0, dtype=np.int64)
            for start in range(0, batch.num_rows, _COUNTED_ROWS):
                values = np.concatenate(list(_numbers(batch.slice(start, _COUNTED_ROWS))))
                found = np.bincount(values, minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
            ids = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    return tokens.select("n_tokens", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_order(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids of the vocabulary, the most frequent first, ties by id. The table has ``vocabulary`` rows at most."""
    counts = np.zeros(vocabulary, dtype=np.int64)
    found = id_counts(tokens).toPandas()
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return np.lexsort((np.arange(vocabulary), -counts)).astype("<u4")


def write_files(tokens: DataFrame, order: np.ndarray, path: str) -> None:
    """Write documents in ascending ``doc_id`` as blocks of coded ranks; nulls come first, equal ids by content.

    Documents are range-partitioned on the id, so file numbers ascend with it. A row of a file is a
    block: the ids and lengths of its documents, where it starts in its file, control and data bytes.
    """
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order), dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, number = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def block() -> pa.RecordBatch:
            sizes = [len(h) for h in held]
            control, data = encode_values(rank[np.concatenate(held)])
            row = {"part": part, "block": number, "start": start, "doc_ids": doc_ids, "sizes": sizes, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        size = 0
        for batch in batches:
            for doc_id, values in zip(batch.column("doc_id").to_pylist(), _numbers(batch), strict=True):
                if held and size + len(values) > BLOCK_IDS:
                    yield block()
                    start, number, size = start + size, number + 1, 0
                    held.clear()
                    doc_ids.clear()
                held.append(values)
                doc_ids.append(doc_id)
                size += len(values)
        if held:
            yield block()

    coded = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-coded // FILE_BYTES))
    # Rows of one id go by their ids, equal rows by their place in the stored table, so that repeats fill many parts.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    ordered = (
        tokens.withColumns({"_tie": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .drop("_tie", "_row")
    )
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


BLOCKS = "part int, block int, start bigint, doc_ids array<bigint>, sizes array<bigint>, control binary, data binary"
_BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)


def read_files(spark: SparkSession, path: str, order: np.ndarray, keep_ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it: the place in the file plus the sizes of the
    files before, a table of one row per file.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("part", F.explode("sizes").alias("size")).groupBy("part").agg(F.sum("size").alias("size")).collect()
    bases, base = {}, 0
    for part, size in sorted(sizes):
        bases[part], base = base, base + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                lengths = np.array(block["sizes"], dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = order[decode_values(block["control"], block["data"], int(ends[-1]))]
                parts = [ids[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], type=pa.int64()),
                        pa.array(ends - lengths + bases[block["part"]] + block["start"]),
                        pa.array(lengths),
                        pa.array([zlib.crc32(p) for p in parts], type=pa.int64()),
                        pa.array([p.tobytes() if keep_ids else None for p in parts], type=pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                ).select(list(range(4 + keep_ids)))

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return blocks.select("part", "start", "doc_ids", "sizes", "control", "data").mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each row; no row is without ids, so the bytes tell how wide a number is."""
    rows = zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)
    return (np.frombuffer(data, dtype=f"<u{len(data) // n}") for data, n in rows)


def token_files(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """Encode, count, write and read back. Texts are tokenized once; an empty table gives no rows.

    One file's worth of documents' ids lies in a task; every further step streams over blocks.
    """
    path = scratch_path(docs.sparkSession, "token-files")
    with small_batches(docs.sparkSession):
        tokens = materialise(tokenize(docs, tokenizer, end_id), "tokens")
        order = frequency_order(tokens, encoder(tokenizer).vocabulary)
        write_files(tokens, order, path)
    with small_batches(docs.sparkSession, _BATCH_BLOCKS):
        return materialise(read_files(docs.sparkSession, path, order), "token-rows")
