"""Packing token pieces into fixed-length sequences by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.common import small_batches, text_slices
from folioflow.llm.tokens import WORD_BPE, encoder
from folioflow.session import materialise

SEQUENCE = 4096
OPEN_BINS = 1024
# Tokens that one packing task handles; its rows are narrow, so this bounds rows rather than memory.
TASK_TOKENS = 1 << 25
_TASK_BITS = 32

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, size: int = SEQUENCE, keep_ids: bool = False
) -> DataFrame:
    """Token pieces of every whole text: the ids, then ``end_id``, cut every ``size`` tokens.

    Only documents longer than ``size`` have more than one piece. A null or empty text is the single
    token ``end_id``; a null ``doc_id`` stays null; every row counts, repeated ids or rows too. Other
    columns of ``docs`` are not read. ``keep_ids`` adds the ids as little-endian uint32.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4")
        for batch in text_slices(batches):
            ids, offsets = encode(batch.column("text"))
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                whole = np.concatenate([ids[offsets[row] : offsets[row + 1]], end])
                for number, start in enumerate(range(0, len(whole), size)):
                    part = whole[start : start + size]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(number)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part.tobytes() if keep_ids else None)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out)).select(list(range(5 + keep_ids)))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


class BestFit:
    """Online best fit over a fixed number of open bins.

    A bitset has one bit for each amount of free space that some open bin has. The tightest bin that
    takes an item is the lowest set bit from the item's length upwards; when too many bins are open,
    the fullest, which is the lowest set bit of all, is closed. Full bins close at once.
    """

    def __init__(self, size: int, open_bins: int) -> None:
        self.size = size
        self.open_bins = open_bins
        self.opened = 0
        self._free = 0
        self._bins: list[list[int]] = [[] for _ in range(size + 1)]
        self._count = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin number and the offset that an item gets."""
        fitting = self._free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.size, self.opened
            self.opened += 1
        left = room - length
        if left:
            self._free |= 1 << left
            self._bins[left].append(number)
            self._count += 1
            if self._count > self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)
        return number, self.size - room

    def _take(self, room: int) -> int:
        bins = self._bins[room]
        number = bins.pop()
        if not bins:
            self._free ^= 1 << room
        self._count -= 1
        return number


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, number: str | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``size`` tokens.

    Pieces are dealt by a hash of their whole key to tasks of about ``TASK_TOKENS`` tokens, so a hot
    document or id splits as any other rows do, and each task packs its share in the order of that
    hash with at most ``open_bins`` open bins. ``number``, a column that is stored with the pieces and goes,
    tells equal rows apart, so that repeats spread too. Sequence numbers hold the task's number in their
    upper bits. Rows and partitions are functions of the stored pieces alone: a task that runs again gives
    the same. No rows give no rows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_TOKENS))
    key = F.xxhash64("doc_id", "piece", "length", "ids_crc32", *([number] if number else []))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.drop_columns(["_key"]).columns,
                    pa.array([base + number for number, _ in placed], type=pa.int64()),
                    pa.array([offset for _, offset in placed], type=pa.int64()),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != number)
    dealt = pieces.withColumn("_key", key).drop(*([number] if number else [])).repartition(tasks, "_key").sortWithinPartitions("_key", "start", "doc_id")
    return dealt.mapInArrow(fit, schema + ", sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their places. The narrow pieces are stored once between both steps."""
    with small_batches(docs.sparkSession):
        numbered = cut_pieces(docs, tokenizer, end_id, size).withColumn("_number", F.monotonically_increasing_id())
        pieces = materialise(numbered, "pieces")
    return pack(pieces, size, number="_number")
