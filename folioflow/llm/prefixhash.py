"""Fingerprints from prefix polynomial hashes: equality of any two spans, common extensions by binary search."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.common import text_slices
from folioflow.operators.ordering import with_rank
from folioflow.session import materialise

# Two primes below 2^31 and a base for each; products of residues fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1047552433, 777767777)
# A fingerprint has more than RUNGS / 2 and at most RUNGS steps from either end, or one for each code point.
RUNGS = 32
# Bytes of text that one task orders and hashes, and keys drawn for each such share.
PART_BYTES = 32 << 20
DRAWS = 16
# A repeated row fills several shares only if each gets so many of them that none stays empty.
REPEATS = 1_000
# Text that is hashed at once; prefix arrays and powers take about 60 bytes a code point.
SLICE = 1 << 20


class Powers:
    """Powers of a base and of its inverse modulo a prime, grown by doubling as longer texts come."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime = prime
        self._tables = [(base, np.ones(1, dtype=np.uint64)), (pow(base, -1, prime), np.ones(1, dtype=np.uint64))]

    def _table(self, which: int, size: int) -> np.ndarray:
        base, table = self._tables[which]
        while len(table) < size:
            step = np.uint64(pow(base, len(table), self.prime))
            table = np.concatenate([table, table * step % np.uint64(self.prime)])
        self._tables[which] = base, table
        return table

    def upto(self, size: int) -> np.ndarray:
        return self._table(0, size)[:size]

    def shift(self, by: np.ndarray) -> np.ndarray:
        """base ** by for signed exponents."""
        most = int(np.abs(by).max(initial=0)) + 1
        return np.where(by >= 0, self._table(0, most)[np.abs(by)], self._table(1, most)[np.abs(by)])


POWERS = tuple(Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))


class PrefixHashes:
    """Modular prefix arrays of many texts; a text's hash is the sum of code point times base ** position.

    One array a prime holds running sums over all texts, so the span [a, b) of a text is a difference of
    two entries, moved to position 0 by a power of the inverse base. Memory is 16 bytes a code point.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        codes += np.uint64(1)  # U+0000 counts too
        self.sums = []
        for powers in POWERS:
            prime = np.uint64(powers.prime)
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            # Residues stay below 2^31, so running sums of 2^32 of them fit and need no reduction.
            np.cumsum(codes * powers.upto(len(codes)) % prime, out=sums[1:])
            self.sums.append(sums)

    def spans(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash modulo prime ``which`` of code points [start, end) of each text, as if they began at 0."""
        powers, sums, at = POWERS[which], self.sums[which], self.starts[text]
        prime = np.uint64(powers.prime)
        return (sums[at + end] - sums[at + start]) % prime * powers.shift(-(at + start)) % prime

    def equal(self, text_a, start_a, text_b, start_b, length) -> np.ndarray:
        """Whether spans of ``length`` code points are equal, by both primes."""
        same = np.ones(len(text_a), dtype=bool)
        for which in range(len(PRIMES)):
            same &= self.spans(text_a, start_a, start_a + length, which) == self.spans(text_b, start_b, start_b + length, which)
        return same

    def extension(self, text_a, start_a, text_b, start_b) -> np.ndarray:
        """Length of the longest common extension of pairs of positions, by binary search on span equality."""
        low = np.zeros(len(text_a), dtype=np.int64)
        high = np.minimum(self.lengths[text_a] - start_a, self.lengths[text_b] - start_b)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(text_a, start_a, text_b, start_b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def step_of(length: np.ndarray) -> np.ndarray:
    """Distance of a fingerprint's rungs: the least power of two with at most ``RUNGS`` of them."""
    short = np.maximum(1, -(-length // RUNGS))
    return np.left_shift(1, np.ceil(np.log2(short)).astype(np.int64))


class Ladders:
    """Fingerprints of many texts as arrays: prefix hashes at multiples of a step from the front and from the end.

    Row i, column k of ``front`` is the hash of the first k steps, of ``back`` that of the text without its
    last k steps; both modulo the first prime. ``whole`` has the whole text's hash modulo both.
    """

    def __init__(self, length: np.ndarray, front: np.ndarray, back: np.ndarray, whole: np.ndarray) -> None:
        self.length, self.step = length, step_of(length)
        self.rungs = length // self.step
        self.front, self.back, self.whole = front, back, whole

    @classmethod
    def of(cls, length: np.ndarray, prefix) -> Ladders:
        """``prefix(row, end, which)`` gives hashes of prefixes of the texts."""
        step = step_of(length)
        rungs = length // step
        columns = np.arange(RUNGS + 1)[None]
        at = np.minimum(columns, rungs[:, None]) * step[:, None]
        row = np.broadcast_to(np.arange(len(length))[:, None], at.shape)
        front = prefix(row.ravel(), at.ravel(), 0).reshape(at.shape)
        back = prefix(row.ravel(), (length[:, None] - at).ravel(), 0).reshape(at.shape)
        rows = np.arange(len(length))
        whole = np.stack([prefix(rows, length, which) for which in range(len(PRIMES))], axis=1)
        return cls(length, front, back, whole)

    @classmethod
    def parse(cls, found: Sequence[str]) -> Ladders:
        """The arrays of fingerprints written by ``texts``."""
        heads, bodies = zip(*(f.split(":") for f in found), strict=True) if found else ((), ())
        length = np.array([int(h[:-16]) for h in heads], dtype=np.int64)
        whole = np.array([[int(h[-16:-8], 16), int(h[-8:], 16)] for h in heads], dtype=np.uint64).reshape(-1, 2)
        rungs = length // step_of(length)
        front, back = (np.zeros((len(found), RUNGS + 1), dtype=np.uint64) for _ in range(2))
        back[:] = whole[:, :1]
        for row, (body, n) in enumerate(zip(bodies, rungs.tolist(), strict=True)):
            values = [int(body[k : k + 8], 16) for k in range(0, len(body), 8)]
            front[row, 1 : n + 1], back[row, 1 : n + 1] = values[:n], values[n:]
            front[row, n + 1 :], back[row, n + 1 :] = front[row, n], back[row, n]
        return cls(length, front, back, whole)

    def texts(self) -> list[str]:
        """The fingerprints: decimal length, hash by both primes, a colon, front rungs, back rungs, 8 hex digits each."""
        front, back = (np.ascontiguousarray(a[:, 1:].astype(">u4")) for a in (self.front, self.back))
        heads = np.ascontiguousarray(self.whole.astype(">u4"))
        return [
            f"{n}{heads[i].tobytes().hex()}:{front[i, :k].tobytes().hex()}{back[i, :k].tobytes().hex()}"
            for i, (n, k) in enumerate(zip(self.length.tolist(), self.rungs.tolist(), strict=True))
        ]

    def take(self, rows: np.ndarray) -> Ladders:
        return Ladders(self.length[rows], self.front[rows], self.back[rows], self.whole[rows])


def likeness(a: Ladders, b: Ladders) -> np.ndarray:
    """Share, 0 to 1, of both texts' code points that lie in equal aligned spans, from fingerprints alone.

    Spans are aligned by their distance from the front or from the end, on the coarser of both steps.
    From each end, the longest common extension is found by binary search over the rungs, the step where
    it ends is skipped, and the search goes on behind it. Code points found from both ends count once.
    Equal texts have 1, as have two empty ones.
    """
    n = len(a.length)
    step = np.maximum(a.step, b.step)
    rungs = np.minimum(a.length, b.length) // step
    covered = [np.zeros((n, 2 * RUNGS + 2), dtype=bool) for _ in range(2)]  # by rung from the front, from the end
    prime = np.uint64(PRIMES[0])
    shift = POWERS[0].shift(b.length - a.length)
    every = np.arange(n)

    def differences(side: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = []
        for ladder in (a, b):
            table, scale = getattr(ladder, side), step // ladder.step
            from_, to = (np.minimum(k * scale, RUNGS) for k in (low, high))
            found.append((table[every, to] + prime - table[every, from_]) % prime)
        return found[0] * shift % prime == found[1] if side == "back" else found[0] == found[1]

    for side, marks in (("front", covered[0]), ("back", covered[1])):
        start = np.zeros(n, dtype=np.int64)
        while (start < rungs).any():
            low, high = start.copy(), np.maximum(rungs, start)
            while (low < high).any():
                middle = (low + high + 1) >> 1
                same = differences(side, start, middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            columns = np.arange(marks.shape[1])[None]
            marks |= (columns >= start[:, None]) & (columns < low[:, None])
            start = low + 1
    total = np.zeros(n, dtype=np.int64)
    for length in (a.length, b.length):
        # A code point at p lies in front rung p // step and in back rung (length - 1 - p) // step: union by rung edges.
        for k in range(int(rungs.max(initial=0))):
            total += covered[0][:, k] * step
            first, last = length - (k + 1) * step, length - k * step
            inside = np.zeros(n, dtype=np.int64)
            for near in (0, 1):  # a back rung meets at most two front rungs
                rung = np.clip(first // step + near, 0, 2 * RUNGS + 1)
                both = np.minimum(last, (rung + 1) * step) - np.maximum(first, rung * step)
                inside += covered[0][every, rung] * np.maximum(both, 0)
            total += covered[1][:, k] * (step - inside)
    out = total / np.maximum(a.length + b.length, 1)
    same = (a.length == b.length) & (a.whole == b.whole).all(axis=1)
    return np.where(same, 1.0, np.minimum(out, 1.0))


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_chars`` and ``fingerprint`` of every whole text; a null text counts as empty.

    One scan, nothing is shuffled. Equal texts have equal fingerprints; ``likeness`` compares two of them.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text_", SLICE):
            hashes = PrefixHashes([t or "" for t in batch.column("_text_").to_pylist()])
            ladders = Ladders.of(hashes.lengths, lambda row, end, which: hashes.spans(row, np.zeros_like(end), end, which))
            arrays = [*batch.drop_columns(["_text_"]).columns, pa.array(hashes.lengths), pa.array(ladders.texts(), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_chars", "fingerprint"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text_")).mapInArrow(run, schema + ", n_chars bigint, fingerprint string")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """Adds ``extension`` to pairs (``text_a``, ``start_a``, ``text_b``, ``start_b``): code points that agree from there on.

    A null text counts as empty, a null start as 0; starts outside a text have extension 0. Pairs stay
    where they lie. All input columns are kept, so ``extension`` must not be one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text_a", SLICE):
            a, b = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text_a", "text_b"))
            n = batch.num_rows
            hashes = PrefixHashes([*a, *b])
            texts = np.arange(n), np.arange(n, 2 * n)
            starts = [np.array([s or 0 for s in batch.column(c).to_pylist()], dtype=np.int64) for c in ("start_a", "start_b")]
            inside = np.ones(n, dtype=bool)
            for text, start in zip(texts, starts, strict=True):
                inside &= (start >= 0) & (start <= hashes.lengths[text])
            starts = [np.where(inside, s, hashes.lengths[t]) for s, t in zip(starts, texts, strict=True)]
            found = np.where(inside, hashes.extension(texts[0], starts[0], texts[1], starts[1]), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "extension"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, schema + ", extension bigint")


# The order of documents: descending doc_id, nulls last, ties by a hash of the text.
_ORDER = ["_nil", "_down", "_hash"]
_KEY = "_nil int, _down bigint, _hash bigint"


def _ordered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    down = F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("bigint"))
    return docs.select(
        doc_id.isNull().cast("int").alias("_nil"), down.alias("_down"), F.xxhash64(text).alias("_hash"), doc_id.alias("doc_id"), text.alias("text")
    )


def _bounds(rows: DataFrame) -> tuple[list[tuple], tuple | None]:
    """Keys that begin a new share of about ``PART_BYTES``, and the first key of all; one row for each share.

    Keys are drawn in proportion to the bytes of their text, ordered by Spark, and every ``DRAWS``-th is
    kept, so a key that many rows have may be several bounds. Small tables still have a share for each
    shuffle partition. A text of several shares draws one key: no bound lies inside a row.
    """
    spark = rows.sparkSession
    keys = materialise(rows.select(*_ORDER, (F.octet_length("text").cast("bigint") + 16).alias("_size")), "document-keys")
    stats = keys.agg(F.sum("_size").alias("size"), F.min(F.struct(*_ORDER)).alias("first")).first()
    if stats["size"] is None:
        return [], None
    parts = max(-(-stats["size"] // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = keys.where(F.rand(7) * F.lit(stats["size"] / parts / DRAWS) < F.col("_size")).select(*_ORDER)
    kept = with_rank(drawn, [F.col(c) for c in _ORDER]).where(F.col("rank") % DRAWS == 0)
    times = Counter(tuple(r)[:3] for r in kept.collect())
    often = [k for k, n in times.items() if n > 1]
    if often:
        sought = spark.createDataFrame(often, _KEY)
        for *key, n in keys.join(F.broadcast(sought), _ORDER).groupBy(*_ORDER).count().collect():
            times[tuple(key)] = max(1, min(times[tuple(key)], n // REPEATS))
    return sorted(times.elements()), tuple(stats["first"])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its text edited with the next document's beginning.

    Documents are ordered by descending ``doc_id``, rows without an id last, rows of one id by a hash of
    their text, and the last one is followed by the first. The edited text is the text with its last
    floor(n_chars / 3) code points replaced by as many first ones, or all, of the next text. Null texts
    are empty. A single document follows itself; an empty table gives no rows. Other columns are not read.

    Result: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Whole texts are shuffled once, into shares of the order cut at keys that
    are in the table; the first row of each share is also sent to the share before it. Rows of one key and
    text are alike and spread over the shares that the key fills. An edited text is never hashed: its
    prefix hashes follow from those of the two texts.
    """
    spark = docs.sparkSession
    rows = _ordered(docs)
    bounds, first = _bounds(rows)
    if first is None:
        return spark.createDataFrame([], _EDITED)
    parts = len(bounds) + 1

    @F.pandas_udf("int")
    def part_of(nil: pd.Series, down: pd.Series, hashed: pd.Series, salt: pd.Series) -> pd.Series:
        found = []
        for key, s in zip(zip(nil, down, hashed, strict=True), salt, strict=True):
            low, high = bisect.bisect_left(bounds, key), bisect.bisect_right(bounds, key)
            found.append(high if high - low < 2 else low + 1 + s % (high - low))
        return pd.Series(found, dtype="int32")

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20).cast("bigint"))
    dealt = rows.withColumn("_part", part_of(*_ORDER, salt)).withColumn("_after", F.lit(0))
    # What follows share p is a row of bound p; the first row of all follows the last share.
    follows = spark.createDataFrame(
        [(*key, part, 1) for part, key in enumerate([*bounds, first])], f"{_KEY}, _part int, _after int"
    )
    heads = rows.join(F.broadcast(follows.select(*_ORDER).distinct()), _ORDER, "left_semi").dropDuplicates(_ORDER)
    heads = heads.join(F.broadcast(follows), _ORDER).select(*dealt.columns)
    shares = dealt.unionByName(heads).repartitionById(parts, "_part").sortWithinPartitions("_after", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in text_slices(batches, most=SLICE):
            ids, texts, after = (batch.column(c).to_pylist() for c in ("doc_id", "text", "_after"))
            if held:
                ids.insert(0, held[0])
                texts.insert(0, held[1])
                after.insert(0, 0)
            own = after.count(0)
            if own == 0:
                return  # a share without rows of its own
            if own < len(texts):  # the row that follows this share
                yield _edit(ids[:own], texts[: own + 1])
                return
            if own > 1:
                yield _edit(ids[:-1], texts)
            held = ids[-1], texts[-1]

    return shares.select("doc_id", "text", "_after").mapInArrow(run, _EDITED)


_EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edit(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Result rows of all texts but the last, each followed by the next one."""
    n = len(ids)
    hashes = PrefixHashes(texts)
    cut = hashes.lengths[:-1] // 3
    stay = hashes.lengths[:-1] - cut
    come = np.minimum(cut, hashes.lengths[1:])

    def prefix(row: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return hashes.spans(row, np.zeros_like(end), end, which)

    def edited_prefix(row: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        powers, prime = POWERS[which], np.uint64(PRIMES[which])
        kept = np.minimum(end, stay[row])
        return (prefix(row, kept, which) + prefix(row + 1, end - kept, which) * powers.shift(kept)) % prime

    ladders = Ladders.of(hashes.lengths, prefix)
    edited = Ladders.of(stay + come, edited_prefix)
    own, following = ladders.take(np.arange(n)), ladders.take(np.arange(1, n + 1))
    digests = [
        hashlib.sha256((a[:s] + b[:c]).encode("utf-8", "surrogatepass")).hexdigest()
        for a, b, s, c in zip(texts, texts[1:], stay.tolist(), come.tolist(), strict=False)
    ]
    arrays = [
        pa.array(ids, pa.int64()),
        pa.array(own.length),
        pa.array(digests, pa.string()),
        pa.array(own.texts(), pa.string()),
        pa.array(edited.texts(), pa.string()),
        pa.array(likeness(own, edited)),
        pa.array(likeness(own, following)),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(arrays, names=names)
