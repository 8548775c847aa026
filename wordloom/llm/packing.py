"""Packing documents into token sequences of bounded length.

Method: shortest-pack-first over the length histogram.

1. Each document is tokenised once; its ids and an end id are cut at every
   multiple of the sequence length, which leaves full pieces and one shorter.
2. The histogram of piece lengths, at most one number a length, goes to the
   driver. Lengths are placed longest first, each into the emptiest packs that
   still have room: a pack is a pattern of lengths with the number of sequences
   that follow it, so that a step moves a whole count at once.
3. Pieces are ranked within their length, by hash bucket and then inside each
   bucket, so that a common length is no single task. A pattern owns a range of
   ranks of each of its lengths, and that joins it back to the pieces.

Defined results: a null or empty text is its end id alone. Ids are those of the
tokenizer file as it is: the string of a special token in a text is that token,
and no token is added around a text. Equal rows are
interchangeable. A null doc_id is kept. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm import exchange as X
from wordloom.llm.bpe import encoder
from wordloom.storage import settle

SEQUENCE = 2048
END_ID = 1
BUCKETS = 1024

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, ranks: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ranks, special_as_text=False)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.batch(batch.column("text")), strict=True):
                ids = np.append(ids, END_ID).astype("<u4")
                for start in range(0, len(ids), sequence):
                    piece = ids[start : start + sequence]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)

    return run


def pack_histogram(counts: dict[int, int], sequence: int) -> list[tuple[int, list[int]]]:
    """Patterns (number of sequences, lengths) that hold every piece of the histogram once.

    Packs are kept by free room; a length goes into the packs with most room. If
    none has room, new packs take the length as often as it fits.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []  # a heap of the rooms in use, largest first
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if left <= 0:
            continue
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else -1
            times = 1
            if room < length:
                times = min(left, sequence // length)
                number, lengths, room = left // times, [], sequence
            else:
                number, lengths = by_room[room].pop()
                if number > left:
                    by_room[room].append((number - left, lengths))
                    number = left
            left -= number * times
            room -= length * times
            if not by_room[room]:
                heapq.heappush(rooms, -room)
            by_room[room].append((number, lengths + [length] * times))
    return [pack for room in sorted(by_room) for pack in by_room[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place in each pattern."""
    out, taken, base = [], defaultdict(int), 0
    for number, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, taken[length], number, base, offset))
            taken[length] += number
            offset += length
        base += number
    return out


def _placed(table: list[tuple[int, int, int, int, int]]):
    length, first, _, base, offset = np.array(sorted(table), dtype=np.int64).reshape(-1, 5).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length << 48 | first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, own << 48 | rank, side="right") - 1
            columns = [batch.column(c.split()[0]) for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base[at] + rank - first[at]), pa.array(offset[at])], [*(c.split()[0] for c in _PIECES.split(", ")), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    X.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(docs.mapInArrow(_pieces(tokenizer, ranks, sequence), _PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    buckets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in buckets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `sequence` rows
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = buckets.select("length", "bucket", before.alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("inside") - 1).cast("long"))
    table = slots(pack_histogram(histogram, sequence))
    return ranked.mapInArrow(_placed(table), _PIECES + ", sequence_id long, offset long")
