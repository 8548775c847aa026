"""Substring deduplication: words covered by a repeated window of words go, the earliest copy stays.

Method: De Bruijn compaction. Every window of k words is an edge of the De
Bruijn graph, from its first k-1 words to its last k-1.

1. Documents are dealt into chunks by ranges of doc_id. Each chunk reduces its
   edges to distinct ones, however often they repeat, and an exchange over all
   chunks tells it for each edge the first chunk that has it, which is its
   source as chunks are ordered by doc_id, and whether others have it too.
2. In its chunk, an edge's source coordinate is its smallest (document, start).
   Edges off their source that follow each other in a document and have one
   source chunk are compacted into a path. A path into the own chunk is compared
   with its source there. Any other is sent to its source chunk, equal paths
   once, and meets by a join the repeated paths of that chunk's source edges.
3. There each edge of a path is looked up, the path is compacted into stretches
   without a branch, whose edges have consecutive source coordinates, and the
   words of each stretch are compared byte for byte with those at its source. A
   chunk to which very many paths lead is met in parts by size.
4. Where a comparison fails, which takes two windows with the same 64-bit hash,
   the edge is taken out of its path and the documents concerned are cut anew.
   Hashes have a secret of the run, so that no text is made to bring this about:
   among n distinct windows it befalls one by chance with a probability of n / 2**64.

Defined results: a null or empty text has no words and keeps none; its digest
is that of the empty string. A text with fewer words than a window is never
shortened. Rows with equal doc_id share their coordinates, so that equal starts
in them are not earlier than each other. Null doc_ids order after all others;
each such row is a document, ordered by a hash of its text, and equal texts
share their coordinates. Extra columns are ignored, or carried in a struct; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.llm import exchange as X
from wordloom.llm import textblocks as T
from wordloom.storage import settle

WINDOW_WORDS = 20
#: doc_id quantiles held as a literal in the plan; finer chunks divide the steps between them evenly.
QUANTILES = 256

_SPANS = pa.list_(pa.struct([("source", pa.int64()), ("digest", pa.binary()), ("begin", pa.int64()), ("n", pa.int64()), ("text", pa.string())]))
_REGIONS = pa.list_(pa.string())
_OUTCOME = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_PATHS = "chunk long, place long, spans array<struct<source:long,digest:binary,begin:long,n:long,text:string>>, regions array<string>"


def range_chunk(docs: DataFrame, chunks: int, nameless: int) -> Column:
    """A long column that never falls as (doc_id, tie) rises; about as many rows for each value. Null ids come last, in `nameless` chunks."""
    steps = min(chunks, QUANTILES)
    finer = chunks // steps
    cuts = docs.select(F.percentile_approx("doc_id", [i / steps for i in range(steps + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    last = F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * nameless), F.lit(nameless - 1))
    if len(cuts) == 1:
        return F.when(F.col("doc_id").isNull(), 1 + last).otherwise(0).cast("long")
    at = F.greatest(F.lit(1), F.size(F.filter(F.array(*(F.lit(c) for c in cuts[:-1])), lambda c: c <= F.col("doc_id"))))
    low = F.element_at(F.array(*(F.lit(float(c)) for c in cuts)), at)
    high = F.element_at(F.array(*(F.lit(float(c)) for c in cuts)), at + 1)
    inner = F.least(F.lit(finer - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low) / (high - low) * finer)))
    return F.when(F.col("doc_id").isNull(), len(cuts) * finer + last).otherwise(at * finer + inner).cast("long")


class _Windows:
    """The words and windows of some texts, in order, and the distinct edges among them.

    begins: the first word of each window; place: its edge among `distinct`; coordinate: (rank of its document, start)
    as one number; source: the window at the smallest coordinate of each edge. Words are numbered over all texts.
    """

    def __init__(self, texts: pa.Array, rank: np.ndarray, k: int, secret: int = 0) -> None:
        self.data, self.offsets = T.buffers(texts)
        self.k = k
        starts, ends, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        edges, begins, coordinates = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        words = 0
        for first, last in T.slices(self.offsets):
            base = self.offsets[first]
            data = self.data[base : self.offsets[last]]
            s, e, c = T.word_bounds(data, self.offsets[first : last + 1] - base)
            own = T.window_hashes(T.span_hashes(data, s, e, secret), k)
            at = np.arange(len(own))
            text = np.repeat(np.arange(last - first), np.diff(c))[: len(own)]
            whole = at + k <= c[text + 1]  # the window ends in the text in which it starts
            at, text = at[whole], text[whole]
            edges.append(own[whole])
            begins.append(at + words)
            coordinates.append(rank[first + text] << 32 | (at - c[text]))
            starts.append(s + base)
            ends.append(e + base)
            counts.append(c[1:] + words)
            words += len(s)
        small = np.int32 if len(self.data) < 1 << 31 else np.int64
        self.starts, self.ends, self.counts = np.concatenate(starts).astype(small), np.concatenate(ends).astype(small), np.concatenate(counts)
        self.begins, self.coordinate, hashes = np.concatenate(begins).astype(small), np.concatenate(coordinates), np.concatenate(edges)
        del starts, ends, begins, coordinates, edges
        order = np.lexsort((self.coordinate, hashes))
        ordered = hashes[order]
        new = np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))
        self.distinct, self.hashes = ordered[new], hashes
        self.place = np.empty(len(hashes), small)
        self.place[order] = np.cumsum(new) - 1
        self.source = order[new].astype(small)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.counts, words, side="right") - 1

    def paths(self, windows: np.ndarray, *kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of consecutive windows of one text, with equal kinds, begins and how many it has; windows ascend."""
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.begins[windows]
        text = self.text_of(at)
        breaks = (np.diff(at) != 1) | (np.diff(text) != 0)
        for kind in kinds:
            breaks |= np.diff(kind) != 0
        first = np.concatenate(([0], np.flatnonzero(breaks) + 1))
        return first, np.diff(np.append(first, len(at)))

    def words(self, begin: int, n: int) -> str:
        """n words, joined by single spaces."""
        return b" ".join(self.data[self.starts[begin] : self.ends[begin + n - 1]].tobytes().split()).decode()


def _equal(a: _Windows, x: np.ndarray, b: _Windows, y: np.ndarray) -> np.ndarray:
    """Whether windows x of a hold the same words as windows y of b; stretches that run alike in both are compared once."""
    good = np.zeros(len(x), bool)
    if not len(x):
        return good
    p, q = a.begins[x], b.begins[y]
    breaks = (np.diff(p) != 1) | (np.diff(q) != 1)
    first = np.concatenate(([0], np.flatnonzero(breaks) + 1))
    n = np.diff(np.append(first, len(x))) + a.k - 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.repeat(p[first], n) + step, np.repeat(q[first], n) + step
    sizes = a.ends[i] - a.starts[i]
    unlike = sizes != b.ends[j] - b.starts[j]
    unlike |= ~T.same_bytes(a.data, a.starts[i], b.data, b.starts[j], np.where(unlike, 0, sizes))
    bad = np.concatenate(([0], np.cumsum(unlike)))
    at = np.repeat(np.cumsum(n) - n, n - a.k + 1) + np.arange(len(x)) - np.repeat(first, n - a.k + 1)
    return bad[at + a.k] == bad[at]


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk's rows in order of (doc_id, tie), and the rank of each one's document."""
    table = table.combine_chunks()
    nameless = np.array(table.column("doc_id").is_null())
    ids = table.column("doc_id").fill_null(0).to_numpy()
    ties = table.column("tie").to_numpy()
    order = np.lexsort((ties, ids, nameless))
    nameless, ids, ties = nameless[order], ids[order], ties[order]
    new = (np.diff(ids) != 0) | (np.diff(nameless) != 0) | (nameless[1:] & (np.diff(ties) != 0))
    return table.take(pa.array(order)), np.concatenate((np.zeros(min(1, len(ids)), np.int64), np.cumsum(new)))


def _windows(table: pa.Table, k: int, secret: int) -> tuple[pa.Table, _Windows]:
    rows, rank = _ordered(table)
    return rows, _Windows(rows.column("text").combine_chunks(), rank, k, secret)


def _request(chunks: int, k: int, secret: int):
    bits = X.levels(chunks)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        edges = _windows(table, k, secret)[1].distinct
        X.give_back()
        return X.messages(key[0].as_py(), edges, np.full(len(edges), 2 * key[0].as_py()), bits[0], last=len(bits) == 1)

    return run


def _outcomes(rows: pa.Table, own: _Windows, gone: np.ndarray, carry: bool) -> dict:
    """The columns of _OUTCOME, and the kept text and the carried struct, where the windows `gone` are removed."""
    cover = np.zeros(len(own.starts) + 1, np.int32)
    first, n = own.paths(np.flatnonzero(gone))
    at = own.begins[np.flatnonzero(gone)[first]]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n + own.k - 1, -1)
    removed = np.cumsum(cover[:-1]) > 0
    n_words, n_removed, digests, texts = [], [], [], []
    for first, last in T.slices(own.offsets):
        base, low, high = own.offsets[first], own.counts[first], own.counts[last]
        starts, ends, counts = own.starts[low:high] - base, own.ends[low:high] - base, own.counts[first : last + 1] - low
        data = np.append(own.data[base : own.offsets[last]], np.uint8(32))
        kept = np.flatnonzero(~removed[low:high])
        sums = np.concatenate(([0], np.cumsum(~removed[low:high])))
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[kept]] += 1
        mark[ends[kept]] -= 1
        shown = np.cumsum(mark[:-1]).astype(bool)
        kept_counts = sums[counts]
        final = np.zeros(len(kept), bool)
        has = np.flatnonzero(np.diff(kept_counts))
        final[kept_counts[has + 1] - 1] = True  # no space after a text's last kept word
        gaps = ends[kept[~final]]
        data[gaps] = 32
        shown[gaps] = True
        for i in range(last - first):
            a, b = own.offsets[first + i] - base, own.offsets[first + i + 1] - base
            text = data[a:b][shown[a:b]].tobytes()
            n_words.append(int(counts[i + 1] - counts[i]))
            n_removed.append(n_words[-1] - int(kept_counts[i + 1] - kept_counts[i]))
            digests.append(hashlib.sha256(text).hexdigest())
            if carry:
                texts.append(text.decode())
    out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return out | ({"text": pa.array(texts, pa.string()), "carried": rows.column("carried")} if carry else {})


def _compacted(k: int, carry: bool, secret: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        rows, own = _windows(docs, k, secret)
        told = X.replied(replies)
        source = (told >> 1).astype(np.int32)[own.place]
        off = own.coordinate > own.coordinate[own.source[own.place]]
        here = np.flatnonzero((source == chunk) & off)
        gone = source < chunk
        spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        regions: list[list[str]] = [[] for _ in range(rows.num_rows)]
        sent: set[tuple[int, bytes]] = set()
        there = np.flatnonzero(gone)
        first, n = own.paths(there, source[there])
        for window, count in zip(there[first].tolist(), n.tolist(), strict=True):
            begin, of = int(own.begins[window]), int(source[window])
            words = own.words(begin, count + k - 1)
            digest = hashlib.blake2b(words.encode(), digest_size=16).digest()
            text = int(own.text_of(np.array([begin]))[0])
            spans[text].append({"source": of, "digest": digest, "begin": begin - int(own.counts[text]), "n": count, "text": None if (of, digest) in sent else words})
            sent.add((of, digest))
        # what others repeat of this chunk's source edges
        shown = own.source[((told >> 1) == chunk) & ((told & 1) == 1)]
        shown.sort()
        first, n = own.paths(shown)
        for begin, count in zip(own.begins[shown[first]].tolist(), n.tolist(), strict=True):
            regions[int(own.text_of(np.array([begin]))[0])].append(own.words(begin, count + k - 1))
        same = here[_equal(own, here, own, own.source[own.place[here]])]
        gone[same] = True
        first, n = own.paths(same)
        for begin, count in zip(own.begins[same[first]].tolist(), n.tolist(), strict=True):
            text = int(own.text_of(np.array([begin]))[0])
            spans[text].append({"source": chunk, "digest": None, "begin": begin - int(own.counts[text]), "n": count, "text": None})
        out = pa.table(_outcomes(rows, own, gone, carry) | {"chunk": pa.array([chunk] * rows.num_rows, pa.int64()), "place": pa.array(range(rows.num_rows), pa.int64()), "spans": pa.array(spans, _SPANS), "regions": pa.array(regions, _REGIONS)})
        return X.in_batches(out)

    return run


def _verified(k: int, secret: int = 0):
    """The paths sent to a source chunk of which some edge's words are not those at its source, and which edges are good."""

    def run(key: tuple, asked: pa.Table, regions: pa.Table) -> pa.Table:
        here = _Windows(regions.column("text").combine_chunks(), np.arange(regions.num_rows), k, secret)
        paths = _Windows(asked.column("text").combine_chunks(), np.arange(asked.num_rows), k, secret)
        at = np.searchsorted(here.distinct, paths.hashes)
        at[at == len(here.distinct)] = 0
        found = np.flatnonzero(here.distinct[at] == paths.hashes) if len(here.distinct) else np.zeros(0, np.int64)
        good = np.zeros(len(paths.begins), bool)
        good[found] = _equal(paths, found, here, here.source[at[found]])
        of = paths.text_of(paths.begins)
        bad = np.unique(of[~good])
        digests = asked.column("digest").to_pylist()
        return pa.table({
            "source": pa.array([key[0].as_py()] * len(bad), pa.int64()),
            "digest": pa.array([digests[i] for i in bad], pa.binary()),
            "good": pa.array([good[of == i].tobytes() for i in bad], pa.binary()),
        })

    return run


def _cut_anew(k: int, carry: bool, secret: int):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        rows, own = _windows(docs, k, secret)
        gone = np.zeros(len(own.begins), bool)
        for place, begin, n, good in zip(*(spans.column(c).to_pylist() for c in ("place", "begin", "n", "good")), strict=True):
            at = np.searchsorted(own.begins, own.counts[place] + begin)
            gone[at : at + n] = np.frombuffer(good, bool) if good is not None else True
        return pa.table(_outcomes(rows, own, gone, carry))

    return run


def dedup_substrings(docs: DataFrame, window_words: int = WINDOW_WORDS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs(doc_id, text); with `carry`, also the kept text and those columns as the struct `carried`."""
    k, kept, secret = window_words, carry is not None, T.new_secret()
    X.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), *([X.packed(docs, carry).alias("carried")] if kept else []))
    null = F.col("doc_id").isNull()
    size, nameless = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.when(null, F.octet_length("text"))), F.lit(0))).first()
    chunks, parts = X.chunk_count(size), max(1, nameless // X.CHUNK_BYTES)
    dealt = docs.withColumn("chunk", range_chunk(docs, chunks, parts))
    replies = X.reduce_over_chunks(dealt.groupBy("chunk").applyInArrow(_request(chunks, k, secret), X.MESSAGE), chunks, "first")
    outcome = StructType.fromDDL(_OUTCOME)
    if kept:
        outcome = outcome.add("text", "string").add("carried", X.loose(docs.schema["carried"].dataType))
    rows = settle(dealt.groupBy("chunk").cogroup(replies.groupBy("id")).applyInArrow(_compacted(k, kept, secret), StructType([*outcome, *StructType.fromDDL(_PATHS)])))

    spans = rows.select("chunk", "place", F.explode("spans").alias("s")).select("chunk", "place", "s.*")
    asked = spans.where("text is not null").groupBy("source", "digest").agg(F.min("text").alias("text"))
    asked = settle(asked)
    units = asked.groupBy("source").agg(F.ceil(F.sum(F.octet_length("text")) / X.CHUNK_BYTES).alias("units"))
    unit = F.pmod(F.xxhash64("digest"), F.col("units"))
    asked = asked.join(units, "source").select("source", unit.alias("unit"), "digest", "text")
    regions = rows.select(F.col("chunk").alias("source"), F.explode("regions").alias("text")).join(units, "source").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"), "text")
    bad = settle(asked.groupBy("source", "unit").cogroup(regions.groupBy("source", "unit")).applyInArrow(_verified(k, secret), "source long, digest binary, good binary"))

    # chunks with an edge that is not what its hash says: seldom any
    wrong = settle(spans.join(bad, ["source", "digest"], "left_semi").select("chunk").distinct())
    again = spans.join(wrong, "chunk", "left_semi").join(bad, ["source", "digest"], "left").select("chunk", "place", "begin", "n", "good")
    anew = dealt.join(wrong, "chunk", "left_semi").groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(_cut_anew(k, kept, secret), outcome)
    return rows.join(wrong, "chunk", "left_anti").select(*anew.columns).unionByName(anew)


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(0, len(w) - 19)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS edge FROM d WHERE len(w) >= 20
), sources AS (SELECT edge, min(struct_pack(doc_id, start)) AS source FROM windows GROUP BY edge HAVING count(*) > 1
), gone AS MATERIALIZED (SELECT doc_id, start FROM windows JOIN sources USING (edge) WHERE struct_pack(doc_id, start) > source
), words AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d
), marked AS (
  SELECT w.doc_id, pos, word, max(CASE WHEN g.start IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.start = w.pos
), kept AS (
  SELECT doc_id, CAST(sum(removed) AS BIGINT) AS n_removed, string_agg(CASE WHEN removed = 0 THEN word END, ' ' ORDER BY pos) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
