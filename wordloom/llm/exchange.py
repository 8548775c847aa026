"""Shared plumbing: compact hash lists, chunks of documents, settled tables, and connected components.

`reduce_over_chunks` decides something about every hash of a corpus (how many
documents hold it, which chunk holds it first) without a row per hash: documents
are dealt into chunks, each chunk sends its sorted distinct hashes with a value
each, cut by hash range and delta-coded, and gets the value reduced over all
chunks back for each. A hash in a third of all documents costs a chunk one entry.
A chunk sends at most 2**FAN_BITS messages, so that a message keeps some thousand
hashes at any input size: with more chunks than that, messages meet in several
levels, each of which merges the hashes of a group of senders in one range and
cuts what is left finer.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from wordloom.storage import settle

#: Rows of an Arrow batch between Spark and Python: a batch of long texts is then a few MB, on both sides.
BATCH_ROWS = 1000
#: Bytes of text in a chunk, on average; a chunk is one group of a grouped map.
CHUNK_BYTES = 4 << 20
#: Chunks that a task takes, and tasks that so few chunks are dealt over before any takes several.
TASK_CHUNKS = 4
LEAST_TASKS = 64
#: Binary logarithm of the most messages that a chunk sends.
FAN_BITS = 9

MESSAGE = "prefix long, id long, sender long, hashes binary, size long, reduced binary"
_REPLY = "prefix long, id long, part long, reduced binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_bytes(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack_bytes(blob: bytes, dtype: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def levels(chunks: int) -> list[int]:
    """How many bits of the hash each level of messages is cut by."""
    bits = chunks.bit_length() - 1
    n = max(1, -(-bits // FAN_BITS))
    return [bits // n + (i < bits % n) for i in range(n)]


def messages(sender: int, hashes: np.ndarray, values: np.ndarray, bits: int, prefix: int = 0, done: int = 0, last: bool = True) -> pa.Table:
    """Sorted hashes that agree in their first `done` bits, the prefix, cut by the next `bits`: a message for each range that has any."""
    edges = np.array([(prefix << bits | i) << 64 - done - bits for i in range(1, 1 << bits)], dtype=np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
    some = [i for i in range(1 << bits) if cuts[i] < cuts[i + 1]]
    longs = lambda x: pa.array(x, pa.int64())
    return pa.table({
        "prefix": longs([prefix << bits | i for i in some]),
        "id": longs([0 if last else sender >> bits] * len(some)),
        "sender": longs([sender] * len(some)),
        "hashes": pa.array([pack_sorted(hashes[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
        "size": longs([int(cuts[i + 1] - cuts[i]) for i in some]),
        "reduced": pa.array([pack_bytes(values[cuts[i] : cuts[i + 1]].astype(np.uint32)) for i in some], pa.binary()),
    })


def _reduced(table: pa.Table, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of some messages, their reduced values, and each entry's place among them."""
    hashes, place = np.unique(np.concatenate([unpack_sorted(b) for b in table.column("hashes").to_pylist()]), return_inverse=True)
    values = np.concatenate([unpack_bytes(b, np.uint32) for b in table.column("reduced").to_pylist()]).astype(np.int64)
    if how == "sum":
        return hashes, np.minimum(np.bincount(place, weights=values, minlength=len(hashes)), 2**32 - 1).astype(np.int64), place
    order = np.lexsort((values, place))
    first = np.searchsorted(place[order], np.arange(len(hashes)))
    several = np.bincount(place, weights=values & 1, minlength=len(hashes)) + np.bincount(place, minlength=len(hashes)) > 1
    return hashes, values[order][first] & ~1 | several, place


def _replies(table: pa.Table, per_entry: np.ndarray, bits: int) -> pa.Table:
    """A reply to each message of the table."""
    cuts = np.cumsum(table.column("size").to_numpy())[:-1]
    prefix = table.column("prefix").to_numpy()
    return pa.table({
        "prefix": pa.array(prefix >> bits, pa.int64()),
        "id": table.column("sender"),
        "part": pa.array(prefix & (1 << bits) - 1, pa.int64()),
        "reduced": pa.array([pack_bytes(p.astype(np.uint32)) for p in np.split(per_entry, cuts)], pa.binary()),
    })


def replied(table: pa.Table) -> np.ndarray:
    """The reduced values of all hashes that a chunk sent, in their order."""
    blobs = sorted(zip(table.column("part").to_pylist(), table.column("reduced").to_pylist(), strict=True))
    return np.concatenate([*(unpack_bytes(b, np.uint32) for _, b in blobs), np.zeros(0, np.uint32)]).astype(np.int64)


def reduce_over_chunks(requests: DataFrame, chunks: int, how: str) -> DataFrame:
    """(id, part, reduced) for each chunk id, of MESSAGE rows that its function made with `messages` and the first of `levels`.

    The values of equal hashes are reduced by `how`: "sum", up to 2**32 - 1, or "first": the least of
    chunk ids sent as 2 * id, plus 1 if more than one chunk sent the hash.
    """
    steps = levels(chunks)

    def meet(sent: DataFrame, level: int, done: int) -> DataFrame:
        bits = steps[level]

        def answer(table: pa.Table) -> pa.Table:
            _, values, place = _reduced(table, how)
            return _replies(table, values[place], bits)

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            hashes, values, _ = _reduced(table, how)
            return messages(key[1].as_py(), hashes, values, steps[level + 1], key[0].as_py(), done, level + 2 == len(steps))

        def pass_on(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            return _replies(table, replied(told)[_reduced(table, how)[2]], bits)

        if level + 1 == len(steps):
            return sent.groupBy("prefix", "id").applyInArrow(answer, _REPLY)
        above = meet(sent.groupBy("prefix", "id").applyInArrow(merge, MESSAGE), level + 1, done + steps[level + 1])
        return sent.groupBy("prefix", "id").cogroup(above.groupBy("prefix", "id")).applyInArrow(pass_on, _REPLY)

    return meet(requests, 0, steps[0])


def give_back() -> None:
    """Return memory that is free to the system, where the C library can; a worker that has done with a chunk then keeps little of it for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def in_batches(table: pa.Table, rows: int = 256) -> pa.Table:
    """The table in batches of some rows, which go to Spark one by one; memory that the making of it has freed is given back."""
    give_back()
    return pa.Table.from_batches(table.to_batches(max_chunksize=rows), table.schema)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass that reads a single column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def chunk_count(size: int) -> int:
    """A power of two, so that chunks and hash ranges both hold about CHUNK_BYTES of text at any input size."""
    return 1 << max(3, (size // CHUNK_BYTES).bit_length())


def dealt(rows: DataFrame, chunks: int, key: str) -> DataFrame:
    """The rows dealt over tasks by an int chunk id: all tasks get equally many chunks, at most TASK_CHUNKS if there are many, at any input size."""
    return rows.repartitionById(max(min(chunks, LEAST_TASKS), chunks // TASK_CHUNKS), key)


def loose(kind: S.DataType) -> S.DataType:
    """The type with nulls allowed everywhere, as Arrow functions return it."""
    if isinstance(kind, S.StructType):
        return S.StructType([S.StructField(f.name, loose(f.dataType)) for f in kind])
    if isinstance(kind, S.ArrayType):
        return S.ArrayType(loose(kind.elementType))
    if isinstance(kind, S.MapType):
        return S.MapType(loose(kind.keyType), loose(kind.valueType))
    return kind


def packed(df: DataFrame, columns: list[str]) -> Column:
    """Columns carried through an operator as one struct, so that their names meet none of its own."""
    kinds = S.StructType([S.StructField("row", S.BooleanType()), *(S.StructField(f"c{i}", loose(df.schema[c].dataType)) for i, c in enumerate(columns))])
    return F.struct(F.lit(True).alias("row"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).cast(kinds)


def unpacked(columns: list[str], carried: str = "carried") -> list[Column]:
    return [F.col(carried)[f"c{i}"].alias(c) for i, c in enumerate(columns)]


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most BATCH_ROWS rows at a time.

    Results are lazy, so the setting stays: it bounds memory and never changes a result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge (a, b).

    Alternating large-star and small-star steps; both send every node's
    neighbours to the smallest of them by partial aggregation and plain
    equi-joins, so that a hub with very many links is no single group in
    memory, and the rounds grow with the logarithm of the graph's diameter.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = settle(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        pairs = settle(small)
        now = tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(pairs.select(F.col("lo"), F.col("lo")).distinct())
        before = now
