"""MinHash near-duplicates with odd sketches.

Shingle sets are compared by MinHash bands; odd sketches (parity bitmaps of the MinHash samples, whose
XOR counts estimate high similarities well) leave out pairs that cannot link; every link is confirmed
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import by_ids, text_slices
from folioflow.llm.components import connected_components
from folioflow.session import materialise

WORDS = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS = 32
BAND_ROWS = 5
SKETCH_BITS = 512
# At 75 % similarity 40 of the 160 samples differ (deviation 5.5) and about 69 of the 512 bits do
# (deviation 10); five deviations more lose fewer than one link in a million.
MOST_BITS = 118

# Classes of one chunk of a bucket; a block of work holds two chunks and their sets.
BLOCK_ROWS = 512

_SAMPLES = BANDS * BAND_ROWS
_DRAW = np.random.default_rng(20_240)
_FACTOR = (_DRAW.integers(1, 1 << 32, _SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _DRAW.integers(0, 1 << 32, _SAMPLES, dtype=np.uint64).astype(np.uint32)
_BAND_SALT = _DRAW.integers(1, 1 << 62, BANDS, dtype=np.uint64)
_SLOT_SALT = _DRAW.integers(1, 1 << 62, _SAMPLES, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    A-Z are lower-cased and words end at ASCII white space. A text of fewer words is one shingle, a text
    without words has none.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    if len(split) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(split), len(split))], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    rolled = hashed[: len(split) - words + 1].copy()
    for k in range(1, words):
        rolled *= _PRIME
        rolled += hashed[k : len(split) - words + 1 + k]
    return np.unique(_mixed(rolled))


def minhash(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(_SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(x), _BLOCK):
        values = np.multiply.outer(_FACTOR, x[start : start + _BLOCK])
        values += _SHIFT[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    keys = _BAND_SALT.copy()
    for column in samples.reshape(BANDS, BAND_ROWS).T:
        keys = keys * _PRIME + column
    return _mixed(keys).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit."""
    bits = np.bincount((_mixed(samples + _SLOT_SALT) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


KEY = ["key_a", "key_b"]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``KEY``, a 128-bit hash of id and text: equal for exact repeats only."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return docs.withColumns({"key_a": F.xxhash64(doc_id, text), "key_b": F.xxhash64(F.length(text), doc_id, text)})


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, key, ``n_shingles``, a 128-bit signature of the set (null if empty), band keys and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, first, second, bands, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                if not len(found):
                    first.append(None), second.append(None), bands.append(None), sketches.append(None)
                    continue
                signature = np.frombuffer(xxhash.xxh3_128_digest(found), dtype=np.int64)
                samples = minhash(found)
                first.append(signature[0]), second.append(signature[1])
                bands.append(band_keys(samples)), sketches.append(odd_sketch(samples))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(batch.column(c) for c in KEY),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(first, type=pa.int64()),
                    pa.array(second, type=pa.int64()),
                    pa.array(bands, type=pa.list_(pa.int64())),
                    pa.array(sketches, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", *KEY, "n_shingles", "sig_a", "sig_b", "bands", "sketch"],
            )

    schema = "doc_id bigint, key_a bigint, key_b bigint, n_shingles bigint, sig_a bigint, sig_b bigint, bands array<bigint>, sketch array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), *KEY, F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The key and the full set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEY), pa.array(sets, type=pa.list_(pa.int64()))], names=[*KEY, "shingles"]
            )

    return docs.select(*KEY, F.col("text").cast("string")).mapInArrow(run, "key_a bigint, key_b bigint, shingles array<bigint>")


def _may_link() -> Column:
    """Whether sets of ``n_a`` and ``n_b`` shingles with sketches ``s_a`` and ``s_b`` can be near enough."""
    bits = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    near_size = F.lit(100) * F.least("n_a", "n_b") >= F.lit(PERCENT) * F.greatest("n_a", "n_b")
    return near_size & (bits <= MOST_BITS)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose full sets reach the similarity."""
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"x_{c}")) for c in ("a", "b"))
    common = F.size(F.array_intersect("x_a", "x_b"))
    enough = F.lit(100) * common >= F.lit(PERCENT) * (F.size("x_a") + F.size("x_b") - common)
    return pairs.select("a", "b").join(one, "a").join(other, "b").where(enough).select("a", "b")


def _across(block: pa.Table) -> pa.Table:
    """Confirmed links between different parts of a bucket, the likeliest pairs first, as few as connect them.

    A block holds two chunks of a bucket (or one, with itself). A pair that shares several buckets is
    compared in the first of them only.
    """
    table = block.combine_chunks()
    same = table.column("chunk").to_numpy() == table.column("turn").to_numpy()
    if same.any():
        left = right = np.flatnonzero(same)
    else:
        low = table.column("chunk").to_numpy() < table.column("turn").to_numpy()
        left, right = np.flatnonzero(low), np.flatnonzero(~low)
    ids, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
    sets = table.column("shingles").to_numpy()
    sizes = np.array([len(x) for x in sets])
    sketches = np.stack(table.column("sketch").to_numpy()).astype(np.int64).view(np.uint64)
    bands = np.stack(table.column("bands").to_numpy()).astype(np.int64)
    here = table.column("bucket")[0].as_py()
    found: list[tuple[int, int, int]] = []
    for at in left.tolist():
        others = right[parts[right] != parts[at]]
        bits = np.bitwise_count(sketches[others] ^ sketches[at]).sum(axis=1)
        near = 100 * np.minimum(sizes[others], sizes[at]) >= PERCENT * np.maximum(sizes[others], sizes[at])
        near &= (bits <= MOST_BITS) & ((ids[others] > ids[at]) if same.any() else (ids[others] != ids[at]))
        others, bits = others[near], bits[near]
        if len(others):
            shared = (bands[others] == bands[at]).argmax(axis=1)
            first = bands[at][shared] == here
            found.extend(zip(bits[first].tolist(), [at] * int(first.sum()), others[first].tolist(), strict=True))
    root = {p: p for p in set(parts.tolist())}

    def top(part: int) -> int:
        while root[part] != part:
            root[part] = part = root[root[part]]
        return part

    links = []
    for _, x, y in sorted(found):
        p, q = top(int(parts[x])), top(int(parts[y]))
        if p == q:
            continue
        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * common >= PERCENT * (sizes[x] + sizes[y] - common):
            root[max(p, q)] = min(p, q)
            links.append((int(ids[x]), int(ids[y])))
    return pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema=_PAIRS)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents link if 100 * intersection >= 75 * union of their sets of five-word shingles; see
    ``shingles`` for short texts. Texts that are null or without words link with nothing; their component is
    their own id and they are kept. A component is named by its smallest id, null if no row has one, and
    every row with that id is kept; ``one_of_each`` decides between rows of one id. Ids need not differ.
    Other columns are not read; an empty table gives no rows.

    Equal sets are one class, known by the number of its first row. In every band bucket all classes are
    compared with the bucket's smallest one. Buckets that these links do not connect are compared again
    across components, in pairs of blocks of bounded size that return links only, so no step emits the pairs
    of a large group. All candidates are confirmed on full sets, which are built again for the first rows of
    classes in shared buckets.
    """
    rows = decided(docs).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def decided(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with ``KEY``, where ``kept`` is one row of every component.

    It is a row of the smallest id (rows without id come last), then of the smallest key, and one of exact repeats.
    """
    docs = keyed(docs)
    # Rows are numbered once, in the stored table; the numbers name rows but decide only between exact repeats.
    found = materialise(profiles(docs).withColumn("row", F.monotonically_increasing_id()), "profiles")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY, "row")
    classes = found.where("n_shingles > 0").groupBy("sig_a", "sig_b").agg(F.min(first).alias("first"))
    classes = materialise(classes.withColumn("node", F.col("first.row")), "text-classes")
    heads = (
        found.where("n_shingles > 2")  # smaller sets link with equal ones only
        .join(classes.select(F.col("node").alias("row")), "row")
        .select(F.col("row").alias("node"), *KEY, "n_shingles", "bands", "sketch")
    )
    heads = materialise(heads, "class-profiles")
    spread = heads.select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    members = spread.join(materialise(buckets.select("bucket", "head"), "buckets"), "bucket")
    members = materialise(members.select("bucket", "node", "head"), "bucket-members")
    shared = heads.select("node", *KEY).join(members.select("node").distinct(), "node")
    shared = materialise(shared, "shared-keys")
    sets = shingle_sets(by_ids(docs, shared, "left_semi", KEY)).dropDuplicates(KEY)
    sets = materialise(sets.join(shared, KEY).select("node", "shingles"), "shingle-sets")

    traits = heads.select("node", "n_shingles", "sketch")
    one, other = (
        traits.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")
    )
    stars = members.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialise(stars.join(one, "a").join(other, "b").where(_may_link()).select("a", "b"), "star-pairs")
    links = materialise(_confirmed(stars, sets), "star-links")

    parts = materialise(connected_components(links), "star-parts")
    part = F.coalesce("component", "node")
    placed = members.select("bucket", "node").join(parts, "node", "left").select("bucket", "node", part.alias("part"))
    placed = materialise(placed, "bucket-parts")
    torn = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
    torn = torn.where("low < high AND n > 2")  # the ends of a bucket of two have been compared
    torn = materialise(torn.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("chunks")), "torn-buckets")
    chunk, turn = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = placed.join(torn, "bucket").select("bucket", "node", "part", chunk.alias("chunk"), turn.alias("turn"))
    rows = rows.join(heads.select("node", "sketch", "bands"), "node").join(sets, "node")
    blocks = rows.groupBy("bucket", F.least("chunk", "turn"), F.greatest("chunk", "turn"))
    across = blocks.applyInArrow(_across, "a bigint, b bigint")
    links = links.unionByName(materialise(across, "cross-links"))

    parts = connected_components(links)
    named = classes.join(parts, "node", "left").select("sig_a", "sig_b", "first", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "class-components")
    firsts = named.groupBy("component").agg(F.min("first").alias("f")).select("component", F.col("f.doc_id").alias("component_id"), F.col("f.row").alias("kept_row"))
    named = named.select("sig_a", "sig_b", "component").join(firsts, "component").select("sig_a", "sig_b", "component_id", "kept_row")
    return (
        found.select("doc_id", *KEY, "row", "n_shingles", "sig_a", "sig_b")
        .join(materialise(named, "text-components"), ["sig_a", "sig_b"], "left")
        .select(
            "doc_id",
            *KEY,
            "n_shingles",
            F.when(F.col("kept_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("kept_row") == F.col("row"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps.

    Keys that keep no row go by an anti join. Only where a key keeps fewer rows than it has are its rows
    reduced to one, the smallest by all columns.
    """
    counts = decided(docs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("m")).where("m < n")
    counts = materialise(counts, "near-duplicates")
    rows = keyed(docs)
    whole = by_ids(rows, counts, "left_anti", KEY).select(*docs.columns)
    repeated = by_ids(rows, counts.where("m > 0"), "left_semi", KEY)
    return whole.unionByName(repeated.groupBy(*KEY).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
