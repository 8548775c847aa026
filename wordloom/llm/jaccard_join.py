"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, grouped into components.

Method: set-relation skipping over prefix index lists.

1. Shingle sets come from whole texts. Every distinct shingle gets its
   document-frequency class by an exchange over all documents; the class is read
   off the shingle's leading hash bits, which are enough to order shingles: rare
   class first, then hash. Two sets with a Jaccard similarity of t share a
   shingle within their first n - ceil(t * n) + 1 of that order, so only those
   are indexed, and of them only shingles that occur in more than one document.
2. Equal sets collapse into one, within a chunk and then by fingerprint.
3. An index list holds the sets of one shingle, in blocks of set sizes (a block
   spans a ratio of 1/t, so only neighbouring blocks can link). Each block has a
   hub; every member is compared with the hub of its own block and of the next,
   exactly.
4. A set's answers come from its hub's: a set linked with a hub has the hub's
   component, and members of one component need no comparison among themselves.
   What remains are members of one list in different components. Within a list,
   sets of a size block stand in order of the shingle's position, so that a run
   of sets whose positions leave too small an overlap is skipped as a block, as
   are size blocks that are too far apart; no pair of them is formed. Of the
   others, Jaccard distance is a metric, so a pair whose distances to a common
   hub differ by more than 1 - t needs no comparison, nor does one whose parity
   bitmaps differ in more bits than the sets may differ in shingles (each bit is
   the parity of the shingles hashed to it). All others are compared exactly. No
   link between different components is lost.
5. A long list is cut into parts by a hash of the document; each pair of parts is
   a unit of work of bounded size, so that a shingle of a third of all documents
   is no single task. Sets are compared in a stream: a hub's set comes once
   before its partners', in parts by their summed size.

Sets are compared by 64-bit hashes of their shingles, which scramble word by
word (`textblocks`) under a secret drawn for each run, so that no text can be
made to have two alike.

Defined results: a null text, or one without words, has an empty set, links
with nothing and is its own component. A text with fewer words than a shingle
has its whole word sequence as its only shingle. Rows with equal doc_id are one
document with the union of their shingles, returned once per row. A row with a
null doc_id takes no part in links and has a null component. Extra columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import exchange as X
from wordloom.llm import textblocks as T
from wordloom.storage import settle

SHINGLE_WORDS = 5
THRESHOLD = Fraction(4, 5)

#: Members of a list that one unit of work takes on either side, rows of the units that go together, and pairs looked at together.
LIST_ROWS = 4096
BUCKET_ROWS = 1 << 16
PAIRS_AT_ONCE = 1 << 20
PARITY = ("bits0", "bits1", "bits2", "bits3")
#: Shingles that a hub's set is compared with before its partners go to another unit.
UNIT_SHINGLES = 1 << 21

_CHUNK_SCHEMA = "doc_id long, n_shingles long, local_rep long, f1 long, f2 long, tokens array<long>, places array<int>, bits array<long>, shingles binary"


def _document_sets(table: pa.Table, k: int, secret: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct doc_ids of a chunk, ascending, and the sorted distinct shingle hashes of each."""
    ids, sets = np.zeros(0, np.int64), []
    table = table.combine_chunks()
    if not table.num_rows:
        return ids, sets
    rows: list[np.ndarray] = []
    for first, last, words, counts in T.text_words(table.column("text").chunk(0), True, secret):
        windows = T.window_hashes(words, k)
        for i in range(last - first):
            a, b = counts[i], counts[i + 1]
            if b - a >= k:
                rows.append(np.unique(windows[a : b - k + 1]))
            elif b > a:
                rows.append(T.window_hashes(words[a:b], int(b - a)))
            else:
                rows.append(np.zeros(0, np.uint64))
    doc_ids = table.column("doc_id").to_numpy()
    order = np.argsort(doc_ids, kind="stable")
    ids, firsts = np.unique(doc_ids[order], return_index=True)
    for own in np.split(order, firsts[1:]):
        sets.append(rows[own[0]] if len(own) == 1 else np.unique(np.concatenate([rows[i] for i in own])))
    return ids, sets


def _leading(size: int) -> np.uint64:
    """A mask of the leading hash bits that tell the shingles of so many bytes of text apart, but for one in 256 or fewer."""
    bits = min(64, -(-(size.bit_length() + 8) // 8) * 8)
    return np.uint64((1 << 64) - (1 << 64 - bits))


def _request(chunks: int, k: int, mask: np.uint64, secret: int):
    bits = X.levels(chunks)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, sets = _document_sets(table, k, secret)
        hashes, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) & mask, return_counts=True)
        del sets
        X.give_back()
        return X.messages(key[0].as_py(), hashes, counts, bits[0], last=len(bits) == 1)

    return run


def _prefix_length(n: int, t: Fraction) -> int:
    return n + t.numerator * -n // t.denominator + 1  # n - ceil(t * n) + 1


def _indexed(k: int, t: Fraction, mask: np.uint64, secret: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sets = _document_sets(docs, k, secret)
        classes = np.ceil(np.log2(np.maximum(X.replied(replies), 1))).astype(np.uint8)  # 0 is one document, then powers of two
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        place = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) & mask, return_inverse=True)[1]
        columns: dict[str, list] = {name: [] for name in ("local_rep", "f1", "f2", "tokens", "places", "bits", "shingles")}
        seen: dict[tuple, int] = {}
        end = 0
        for doc_id, own in zip(ids.tolist(), sets, strict=True):
            start, end = end, end + len(own)
            mixed = T.mix(own ^ np.uint64(0x5851F42D4C957F2D))
            print_ = (len(own), int(own.sum(dtype=np.uint64).view(np.int64)), int(mixed.sum(dtype=np.uint64).view(np.int64))) if len(own) else (0, doc_id, 0)
            rep = seen.setdefault(print_, doc_id)
            first = rep == doc_id and len(own) > 0
            columns["local_rep"].append(rep)
            columns["f1"].append(print_[1] if first else None)
            columns["f2"].append(print_[2] if first else None)
            tokens = places = bits = blob = None
            if first:
                ranks = classes[place[start:end]]
                prefix = np.argsort(ranks, kind="stable")[: _prefix_length(len(own), t)]  # hashes ascend already
                at = np.flatnonzero(ranks[prefix])
                if len(at):
                    tokens, places, blob = own[prefix[at]].view(np.int64), at.astype(np.int32), X.pack_sorted(own)
                    bits = np.packbits((np.bincount(own >> np.uint64(56), minlength=256) & 1).astype(bool)).view(np.int64)
            columns["tokens"].append(tokens)
            columns["places"].append(places)
            columns["bits"].append(bits)
            columns["shingles"].append(blob)
        del sets, place, classes
        X.give_back()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "n_shingles": pa.array(lengths, pa.int64()),
            "local_rep": pa.array(columns["local_rep"], pa.int64()),
            "f1": pa.array(columns["f1"], pa.int64()),
            "f2": pa.array(columns["f2"], pa.int64()),
            "tokens": pa.array(columns["tokens"], pa.list_(pa.int64())),
            "places": pa.array(columns["places"], pa.list_(pa.int32())),
            "bits": pa.array(columns["bits"], pa.list_(pa.int64())),
            "shingles": pa.array(columns["shingles"], pa.binary()),
        })

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact intersection size of each pair of sets: a's set precedes its partners', which follow it in the stream."""
    of, own, size = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        rows: list[tuple] = []
        for a, b, n, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "shingles")), strict=True):
            other = X.unpack_sorted(blob)
            if b is None:
                of, own, size = a, other, n
                continue
            if a != of:
                raise ValueError("a pair without its first set")
            small, large = (own, other) if len(own) < len(other) else (other, own)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            rows.append((a, b, size, n, int(np.count_nonzero(large[at] == small))))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "na", "nb", "shared"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of distinct pairs (a, b)."""
    pairs = settle(pairs)
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias("n"), "shingles")
    sized = pairs.join(of("b").select("b", "n"), "b")
    units = sized.groupBy("a").agg(F.ceil(F.sum("n") / UNIT_SHINGLES).cast("int").alias("units"))
    first = units.join(of("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.lit(None).cast("long").alias("b"), "n", "shingles")
    unit = F.pmod(F.xxhash64("b"), F.col("units")).cast("int")
    others = pairs.join(units, "a").select("a", unit.alias("unit"), "b").join(of("b"), "b").select("a", "unit", "b", "n", "shingles")
    stream = first.union(others).repartition("a", "unit").sortWithinPartitions("a", "unit", F.col("b").asc_nulls_first())
    return settle(stream.select("a", "b", "n", "shingles").mapInArrow(_compare, "a long, b long, na long, nb long, shared long"))


def _near(t: Fraction):
    """Candidate pairs of some units of index lists: of members outside a list's main component with all members of another part.

    The other side stands in order of list, size block and position, so that a
    member reads one run of each neighbouring block and skips the rest of it.
    """
    up, down = t.denominator - t.numerator, t.denominator + t.numerator
    names = ("doc_id", "n", "block", "place", "component", "main", "hub", "far", *PARITY)

    def run(table: pa.Table) -> pa.Table:
        every = {c: table.column(c).to_numpy() for c in (*names, "token", "x", "y", "left")}
        order = np.lexsort((every["y"], every["x"], every["token"]))
        changes = sum((np.diff(every[c][order], prepend=every[c][order][:1]) != 0 for c in ("token", "x", "y")), np.zeros(len(order), bool))
        every["unit"] = np.empty(len(order), np.int64)
        every["unit"][order] = np.cumsum(changes)
        left = every["left"]
        x, y = ({c: every[c][side] for c in (*names, "unit")} for side in (left, ~left))
        key = lambda unit, block, place: unit << 40 | (block.astype(np.int64) + 1) << 32 | place
        keys = key(y["unit"], y["block"], y["place"].astype(np.int64))
        order = np.argsort(keys, kind="stable")
        keys, y = keys[order], {c: v[order] for c, v in y.items()}
        found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for step in (-1, 0, 1):
            block = x["block"] + step
            most = np.floor(np.power(float(1 / t), block + 1) + 1e-6).astype(np.int64)  # the largest set of the block
            far = (x["n"] + most) * up // down - x["place"]  # from there on, too little is left to share
            start = np.searchsorted(keys, key(x["unit"], block, np.int64(0)))
            runs = np.where(far < 0, 0, np.searchsorted(keys, key(x["unit"], block, np.clip(far, 0, 2**32 - 1)), side="right") - start)
            through = np.cumsum(runs)
            first = 0
            while first < len(runs):  # a bounded number of pairs at once
                last = max(first + 1, int(np.searchsorted(through, (through[first - 1] if first else 0) + PAIRS_AT_ONCE, side="right")))
                own = np.arange(first, last)
                i = np.repeat(own, runs[own])
                j = np.arange(len(i)) - np.repeat(np.cumsum(runs[own]) - runs[own], runs[own]) + np.repeat(start[own], runs[own])
                fit = _open(x, y, i, j, t, up, down)
                found.append(np.sort(np.stack((x["doc_id"][i[fit]], y["doc_id"][j[fit]])), axis=0))
                first = last
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return run


def _open(x: dict, y: dict, i: np.ndarray, j: np.ndarray, t: Fraction, up: int, down: int) -> np.ndarray:
    """Which of the pairs (row of x, row of y) have to be compared."""
    n, m = x["n"][i], y["n"][j]
    open_ = (x["place"][i].astype(np.int64) + y["place"][j]) * down <= (n + m) * up
    open_ &= np.minimum(n, m) * t.denominator >= np.maximum(n, m) * t.numerator
    a, b = x["component"][i], y["component"][j]
    open_ &= (a != b) & ((b == y["main"][j]) | (x["doc_id"][i] < y["doc_id"][j]))
    with np.errstate(invalid="ignore"):
        open_ &= ~((x["hub"][i] == y["hub"][j]) & (np.abs(x["far"][i] - y["far"][j]) > float(1 - t) + 1e-9))
    at = np.flatnonzero(open_)
    i, j = i[at], j[at]
    unlike = np.zeros(len(at), np.int64)
    for c in PARITY:
        unlike += np.bitwise_count(x[c][i].view(np.uint64) ^ y[c][j].view(np.uint64))
    return at[unlike * down <= (n + m)[at] * up]


def _meeting(rows: DataFrame, left: bool) -> DataFrame:
    """Members of a list's parts on one side of the units (token, x, y) in which they meet those of another part."""
    return rows.drop("parts").withColumn("left", F.lit(left))


def _links(compared: DataFrame, t: Fraction) -> DataFrame:
    return compared.where(F.col("shared") * t.denominator >= (F.col("na") + F.col("nb") - F.col("shared")) * t.numerator).select("a", "b")


def jaccard_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    t, k, secret = Fraction(threshold), shingle_words, T.new_secret()
    X.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = X.text_bytes(docs)
    chunks, mask = X.chunk_count(size), _leading(size)
    dealt = X.dealt(docs.where("doc_id is not null").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")), chunks, "chunk")
    replies = X.reduce_over_chunks(dealt.groupBy("chunk").applyInArrow(_request(chunks, k, mask, secret), X.MESSAGE), chunks, "sum")
    replies = X.dealt(replies.withColumn("id", F.col("id").cast("int")), chunks, "id")
    rows = settle(dealt.groupBy("chunk").cogroup(replies.groupBy("id")).applyInArrow(_indexed(k, t, mask, secret), _CHUNK_SCHEMA))

    # One set for each fingerprint over all chunks: at most one row a chunk has the same one.
    local = rows.where("f1 is not null").select("local_rep", "n_shingles", "f1", "f2")
    whole = local.groupBy("n_shingles", "f1", "f2").agg(F.min("local_rep").alias("rep"))
    reps = settle(local.join(whole, ["n_shingles", "f1", "f2"]).select("local_rep", "rep"))
    sets = rows.where("shingles is not null").join(reps.where("local_rep = rep").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "tokens", "places", "bits", "shingles")

    block = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(float(1 / t))) + 1e-9).cast("int")
    lists = sets.select("doc_id", F.col("n_shingles").alias("n"), block.alias("block"), F.explode(F.arrays_zip("tokens", "places")).alias("e")).select("doc_id", "n", "block", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"))
    shared = lists.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    lists = settle(lists.join(shared, "token"))
    hubs = lists.groupBy("token", "block").agg(F.min(F.struct("place", "doc_id")).getField("doc_id").alias("hub"))
    own = lists.join(hubs, ["token", "block"]).select("hub", "doc_id")
    following = hubs.join(hubs.select("token", (F.col("block") - 1).alias("block"), F.col("hub").alias("doc_id")), ["token", "block"]).select("hub", "doc_id")
    stars = own.union(following).where("doc_id <> hub").toDF("a", "b").distinct()
    first = _compared(stars, sets)
    known = settle(X.components(_links(first, t)))

    # Lists whose members are in more than one component; what is not in a list's main component meets the rest of it.
    named = lists.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("members"))
    main = sizes.groupBy("token").agg(F.max(F.struct("members", "component")).getField("component").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
    distance = first.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("far"))
    mixed = named.join(main, "token").join(hubs, ["token", "block"]).join(distance, ["doc_id", "hub"], "left").withColumn("far", F.when(F.col("doc_id") == F.col("hub"), 0.0).otherwise(F.col("far")))
    mixed = mixed.join(sets.select("doc_id", *(F.element_at("bits", i + 1).alias(c) for i, c in enumerate(PARITY))), "doc_id")
    mixed = settle(mixed.select("token", "main", "doc_id", "n", "block", "place", "component", "hub", "far", *PARITY))
    outside = F.col("component") != F.col("main")
    parts = mixed.groupBy("token").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    mixed = mixed.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # a part meets only parts that have a member outside the main component: rows grow with the list and with its outsiders, not with their product
    asking = mixed.where(outside).groupBy("token", F.col("part").alias("x")).agg(F.count("*").alias("outsiders"))
    asking = settle(asking)
    x = _meeting(mixed.where(outside).withColumnRenamed("part", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), True)
    y = _meeting(mixed.withColumnRenamed("part", "y").join(asking.select("token", "x"), "token"), False)
    asked = asking.groupBy("token").agg(F.count("*").alias("x_parts"), F.sum("outsiders").alias("outsiders")).join(parts, "token")
    units = asked.agg(F.coalesce(F.sum(F.col("parts") * (F.col("x_parts") * LIST_ROWS + F.col("outsiders"))), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("token", "x", "y"), F.lit(max(1, -(-units // BUCKET_ROWS))))
    rest = x.unionByName(y).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_near(t), "a long, b long").distinct()
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(first, ["a", "b"], "left_anti")
    rest = _compared(rest, sets)
    more = _links(rest, t)
    bridges = more.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = X.components(bridges)
    final = known.join(over.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component_id"))
    final = settle(final.union(over.join(known.select(F.col("node")), "node", "left_anti").select("node", "component")))

    named_reps = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("local_rep", F.coalesce("component_id", "rep").alias("component_id"))
    by_id = rows.select("doc_id", "n_shingles", "local_rep").join(named_reps, "local_rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    copies = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    each = by_id.join(copies, "doc_id").select("doc_id", "n_shingles", "component_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("time")
    nameless = docs.where("doc_id is null").mapInArrow(_sizes(k), "doc_id long, n_shingles long, component_id long")
    return each.unionByName(nameless)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": batch.column("text")})
            sizes = [len(s) for s in _document_sets(rows, k)[1]]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(n, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "component_id": pa.nulls(n, pa.int64())})

    return run


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reached AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT v, top FROM reached JOIN edges ON u = node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(top) AS component_id FROM reached GROUP BY node) t ON t.node = d.doc_id
"""
