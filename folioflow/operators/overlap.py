"""Common terms of pairs of texts, without a text sent along with a pair.

A text's distinct terms are stored once and dealt by a hash of the term into parts. A task holds one part of all
texts as numbers and streams the pairs past it. So a term of a text is moved once, however many pairs the text
is in; a pair is two numbers a part on the way in and a count a part on the way out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

from folioflow.session import materialise

# Numbers of terms that a task holds, and ids up to which texts that no pair asks for are left out where they lie.
RESIDENT_BYTES, ASKED_IDS = 32 << 20, 1 << 24
# Terms that are dealt at once, pairs of a slice; queries, their terms and terms that look at them in one look-up.
_DEALT, _SLICE = 1 << 20, 1 << 14
_QUERIES, _MARKED, _LOOKED_UP = 1 << 9, 1 << 13, 1 << 20
# Of the terms of some texts in one part: numbers of texts, terms a text, places in a list of words, and that list.
_DEALT_COLUMNS = ("numbers", "sizes", "codes", "lengths", "words")
# Weights of the bytes of a term in its hash.
_WEIGHTS = np.arange(1, 1025, dtype=np.uint32) * np.uint32(2654435761) ^ np.uint32(0x9E3779B9)
_ROW_BITS = 33


def common_terms(pairs: DataFrame, texts: DataFrame, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """``q_id, id, q_size, size, common``: distinct terms of both texts of a pair, and how many they share.

    ``pairs`` holds ``q_id, id``, ``texts`` ``id, text`` with lower-case texts, split at white space. As in a join, a
    pair comes once for each two rows of ``texts`` with its ids, and not at all where one has no text.
    """
    pairs = materialise(pairs.select("q_id", "id").where("q_id IS NOT NULL AND id IS NOT NULL"), "pairs")
    sets = materialise(_term_sets(texts, _asked(pairs, texts)).withColumn("place", F.monotonically_increasing_id()), "term-sets")
    source = F.shiftrightunsigned("place", _ROW_BITS)
    sources = sets.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("terms")).orderBy("source").collect()
    starts, n_texts = [], 0  # a row for each task that stored texts
    for s in sources:
        starts.append((s["source"], n_texts))
        n_texts += s["rows"]
    starts = F.broadcast(pairs.sparkSession.createDataFrame(starts, "source bigint, start bigint"))
    number = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sets = sets.withColumn("source", source).join(starts, "source").withColumn("number", number.cast("int"))
    n_parts = _parts(pairs.sparkSession, sum(s["terms"] for s in sources), resident_bytes)
    slices = _slices(pairs, sets.select("id", "number", "size"))
    return _summed(slices, _counted(_dealt(sets, n_parts), slices, n_parts, n_texts))


def _parts(spark, n_terms: int, resident_bytes: int) -> int:
    """Parts fit ``resident_bytes`` and keep all cores busy."""
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return max(1, tasks, -(-4 * n_terms // resident_bytes))


def _asked(pairs: DataFrame, texts: DataFrame) -> np.ndarray | None:
    """Hashes of the ids of pairs, in order; None where there are too many to hold or equal ids may differ in theirs."""
    kinds = [texts.schema["id"].dataType, pairs.schema["q_id"].dataType, pairs.schema["id"].dataType]
    if kinds.count(kinds[0]) < 3 or not (kinds[0] == StringType() or isinstance(kinds[0], IntegralType)):
        return None
    hashes = pairs.select(F.xxhash64("q_id").alias("hash")).union(pairs.select(F.xxhash64("id"))).distinct()
    hashes = materialise(hashes, "asked")
    if hashes.count() > ASKED_IDS:
        return None
    return np.sort(hashes.toArrow().column("hash").to_numpy())


def _term_sets(texts: DataFrame, asked: np.ndarray | None) -> DataFrame:
    """``id, terms, size`` of texts whose id may be asked for, terms with a space between.

    Bytes split at the white space that ``terms_of`` splits at.
    """
    shared = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None and batch.num_rows:
                wanted, hashes = shared.value, batch.column("hash").to_numpy()
                place = np.searchsorted(wanted, hashes)
                found = np.zeros(batch.num_rows, dtype=bool)
                inside = place < len(wanted)
                found[inside] = wanted[place[inside]] == hashes[inside]
                batch = batch.filter(pa.array(found))
            if not batch.num_rows:
                continue
            listed, sizes = [], []
            for text in batch.column("text"):
                terms = set((text.as_py() or b"").split())
                listed.append(b" ".join(terms))
                sizes.append(len(terms))
            columns = [batch.column("id"), pa.array(listed, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "terms", "size"])

    kind = texts.schema["id"].dataType.simpleString()
    read = texts.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("hash"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(split, f"id {kind}, terms binary, size int")


def _slices(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with the numbers and sizes of their texts, some thousands a row, in order of the first number."""
    found = pairs.join(texts, "id")
    found = found.join(texts.select(F.col("id").alias("q_id"), F.col("number").alias("q_number"), F.col("size").alias("q_size")), "q_id")
    numbers = ["q_number", "number", "q_size", "size"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(start, _SLICE)
                rows = rows.take(pa.array(np.argsort(rows.column("q_number").to_numpy(), kind="stable")))
                columns = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(name)) for name in ("q_id", "id")]
                columns += [pa.array([rows.column(name).to_numpy().astype(np.int32).tobytes()], pa.binary()) for name in numbers]
                yield pa.RecordBatch.from_arrays(columns, names=["q_id", "id", *numbers])

    kinds = [f"{name} array<{found.schema[name].dataType.simpleString()}>" for name in ("q_id", "id")]
    sliced = found.select("q_id", "id", *numbers).mapInArrow(cut, ", ".join([*kinds, *[f"{name} binary" for name in numbers]]))
    return materialise(sliced.withColumn("slice", F.monotonically_increasing_id()), "pair-slices")


def _dealt(sets: DataFrame, n_parts: int) -> DataFrame:
    """``part`` and ``_DEALT_COLUMNS``: of some texts the terms of one part, as places in a list of words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers = batch.column("size").to_numpy(), batch.column("number").to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = ends[start] - sizes[start]
                end = max(start + 1, int(np.searchsorted(ends, before + _DEALT, "right")))
                terms = pc.split_pattern(batch.column("terms").slice(start, end - start), b" ").flatten()
                yield dealt(numbers[start:end], sizes[start:end], terms)
                start = end

    def dealt(numbers: np.ndarray, sizes: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        coded = terms.dictionary_encode()
        part_of = _part_of(coded.dictionary, n_parts)
        by_part = np.argsort(part_of, kind="stable")
        first_word = np.searchsorted(part_of[by_part], np.arange(n_parts + 1))
        code_of = np.empty(len(by_part), dtype=np.int32)
        code_of[by_part] = np.arange(len(by_part)) - first_word[part_of[by_part]]
        words, lengths = _bytes_of(coded.dictionary.take(pa.array(by_part)))
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        places = coded.indices.to_numpy()
        part, text = part_of[places], np.repeat(np.arange(len(numbers)), sizes)
        order = np.argsort(part.astype(np.uint16) if n_parts < 1 << 16 else part, kind="stable")  # far faster for short numbers
        first = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
        rows: list[tuple] = []
        for p in np.flatnonzero(np.diff(first)).tolist():
            own, start, end = order[first[p] : first[p + 1]], first_word[p], first_word[p + 1]
            times = np.bincount(text[own], minlength=len(numbers)).astype(np.int32)
            some = np.flatnonzero(times)
            held = numbers[some], times[some], code_of[places[own]], lengths[start:end], words[ends[start] : ends[end]]
            rows.append((p, *[column.tobytes() for column in held]))
        part, *rest = zip(*rows, strict=True)
        columns = [pa.array(part, pa.int32()), *[pa.array(column, pa.binary()) for column in rest]]
        return pa.RecordBatch.from_arrays(columns, names=["part", *_DEALT_COLUMNS])

    kinds = ", ".join(f"{name} binary" for name in _DEALT_COLUMNS)
    return sets.where("size > 0").select("number", "size", "terms").mapInArrow(deal, f"part int, {kinds}")


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``words`` one after the other, and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _part_of(words: pa.Array, n_parts: int) -> np.ndarray:
    """A part for each word, of which none is empty, by a hash of its bytes."""
    found, lengths = _bytes_of(words)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    place = np.arange(len(found)) - np.repeat(starts, lengths)
    summed = np.add.reduceat((found + np.uint32(1)) * _WEIGHTS[place % len(_WEIGHTS)], starts, dtype=np.uint32)
    return ((summed ^ summed >> np.uint32(15)) % np.uint32(n_parts)).astype(np.int64)


class _Held:
    """The terms of one part, text by text: what is added first, and once pairs come, numbers only."""

    def __init__(self, n_texts: int):
        self.starts, self.sizes = np.zeros(n_texts, dtype=np.int64), np.zeros(n_texts, dtype=np.int32)
        self.added: list[tuple[np.ndarray, pa.Array]] = []
        self.n_codes = 0
        self.codes: np.ndarray | None = None
        self.marks = np.zeros(0, dtype=np.int32)
        self.seen = np.zeros(0, dtype=bool)

    def add(self, numbers: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, words: bytes) -> None:
        self.starts[numbers] = self.n_codes + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[numbers] = sizes
        self.n_codes += len(codes)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        listed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
        self.added.append((codes.copy(), listed))

    def _number(self) -> None:
        """Equal words of all lists get one number."""
        self.codes = np.empty(self.n_codes, dtype=np.int32)
        if not self.added:
            return
        coded = pa.concat_arrays([words for _, words in self.added]).dictionary_encode()
        number_of = coded.indices.to_numpy()
        at = first = 0
        for codes, words in self.added:
            self.codes[at : at + len(codes)] = number_of[first + codes]
            at, first = at + len(codes), first + len(words)
        self.marks = np.zeros(len(coded.dictionary), dtype=np.int32)
        self.added.clear()

    def common(self, asked: np.ndarray, met: np.ndarray) -> np.ndarray:
        """How many terms the texts of each pair share; ``asked`` rises.

        The terms of some texts of ``asked`` get a mark each, and each of these texts a row with a cell for each
        mark. The terms of ``met`` look at the cells; 0 is the mark of a term that none of the texts has.
        """
        if self.codes is None:
            self._number()
        out = np.zeros(len(asked), dtype=np.int32)
        first = np.diff(asked, prepend=-1) > 0
        row = np.cumsum(first) - 1
        to_mark = np.cumsum(np.where(first, self.sizes[asked], 0), dtype=np.int64)
        to_see = np.cumsum(self.sizes[met], dtype=np.int64)
        start = 0
        while start < len(asked):
            end = min(
                np.searchsorted(row, row[start] + _QUERIES),
                np.searchsorted(to_mark, to_mark[start] - self.sizes[asked[start]] + _MARKED, "right"),
                np.searchsorted(to_see, to_see[start] - self.sizes[met[start]] + _LOOKED_UP, "right"),
            )
            end = max(start + 1, int(end))
            own = row[start:end] - row[start]
            texts, others = asked[start:end][np.diff(own, prepend=-1) > 0], met[start:end]
            marked = self._terms(texts)
            width = len(marked) + 1
            self.marks[marked] = np.arange(1, width, dtype=np.int32)
            if len(self.seen) < len(texts) * width:
                self.seen = np.zeros(len(texts) * width, dtype=bool)
            cells = np.repeat(np.arange(len(texts)) * width, self.sizes[texts]) + self.marks[marked]
            self.seen[cells] = True
            sizes = self.sizes[others]
            hits = self.seen[np.repeat(own * width, sizes) + self.marks[self._terms(others)]]
            hits = np.concatenate([[0], np.cumsum(hits)])
            self.seen[cells], self.marks[marked] = False, 0
            ends = np.cumsum(sizes, dtype=np.int64)
            out[start:end] = hits[ends] - hits[ends - sizes]
            start = end
        return out

    def _terms(self, texts: np.ndarray) -> np.ndarray:
        """The terms of ``texts``, one text after the other."""
        sizes = self.sizes[texts]
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        return self.codes[np.arange(sizes.sum(dtype=np.int64)) + np.repeat(self.starts[texts] - before, sizes)]


def _counted(dealt: DataFrame, slices: DataFrame, n_parts: int, n_texts: int) -> DataFrame:
    """``slice, counts``: the common terms of each pair of a slice in one part."""
    held = dealt.select("part", F.lit(None).cast("bigint").alias("slice"), *_DEALT_COLUMNS)
    over = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))
    empty = [F.lit(None).cast("binary").alias(name) for name in _DEALT_COLUMNS[2:]]
    met = slices.select(over.alias("part"), "slice", F.col("q_number").alias("numbers"), F.col("number").alias("sizes"), *empty)
    both = held.unionByName(met).repartitionById(n_parts, F.col("part")).sortWithinPartitions(F.col("slice").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_texts)
        for batch in batches:
            for number, *columns in zip(batch.column("slice").to_pylist(), *[batch.column(name) for name in _DEALT_COLUMNS], strict=True):
                if number is None:
                    held.add(*[np.frombuffer(c.as_buffer(), dtype=np.int32) for c in columns[:4]], columns[4].as_py())
                    continue
                first, second = (np.frombuffer(c.as_buffer(), dtype=np.int32) for c in columns[:2])
                counts = held.common(first, second)
                if counts.any():
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["slice", "counts"])

    return both.mapInArrow(count, "slice bigint, counts binary")


def _summed(slices: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs of slices with their counts of all parts added up."""
    counts = counted.groupBy("slice").agg(F.collect_list("counts").alias("counts"))
    whole = slices.drop("q_number", "number").join(counts, "slice", "left").drop("slice")
    kinds = [whole.schema[name].dataType.elementType.simpleString() for name in ("q_id", "id")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_size, size = (np.frombuffer(batch.column(name)[row].as_buffer(), dtype=np.int32) for name in ("q_size", "size"))
                common = np.zeros(len(size), dtype=np.int32)
                for counts in batch.column("counts")[row].as_py() or []:
                    common += np.frombuffer(counts, dtype=np.int32)
                columns = [batch.column("q_id")[row].values, batch.column("id")[row].values, *map(pa.array, (q_size, size, common))]
                yield pa.RecordBatch.from_arrays(columns, names=["q_id", "id", "q_size", "size", "common"])

    return whole.mapInArrow(add, f"q_id {kinds[0]}, id {kinds[1]}, q_size int, size int, common int")
