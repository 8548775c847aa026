"""Near-duplicate embeddings by cosine similarity, compared in tiles of PCA-ordered dimensions.

Method:

1. Equal vectors collapse into one class, within a group of rows and then over
   all, so that many copies of one vector are one comparison.
2. Unit vectors are rotated to the principal axes of a bounded sample, those with
   most variance first. A rotation keeps every inner product, so the sample only
   decides how soon comparisons stop.
3. Classes are dealt into tiles of bounded size, and tiles into squares of
   SQUARE tiles a side. A square is one task's work: its tiles arrive in a stream,
   those of its rows are held and each of its columns meets them in turn. A tile is
   sent once for every square that it is part of. Leading dimensions are multiplied
   first; by Cauchy-Schwarz the rest adds at most the product of the suffix norms.
   Pairs whose bound stays below the threshold stop there; the others take further
   dimensions, and what remains is decided on the original vectors in doubles.
4. A tile pair returns each vector's number of links and a spanning forest of its
   links, not the links themselves; the forests' components are those of all
   links.

The comparison is quadratic in the number of distinct vectors, with a small
constant: exact search at this threshold over vectors without structure leaves
no whole tile to skip. A task's memory and input do not grow with the input, the
number of tasks and what is sent do, with its square over TILE_ROWS * SQUARE.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component. A row without vec_id
has no links, a null component and is not kept. Shorter vectors are continued
with zeros. Rows with equal vec_id each count as a vector and reach each other.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import exchange as X
from wordloom.llm.vectors import matrix, shape, usable_vectors
from wordloom.storage import settle

THRESHOLD = 0.9
#: Classes of a tile, rows of an inner block, and the rows that principal axes are fitted on.
TILE_ROWS = 8192
#: Tiles of a square's side.
SQUARE = 4
BLOCK_ROWS = 1024
SAMPLE_ROWS = 20_000
STEP = 16
#: What single-precision products of unit vectors may be off by.
SLACK = 1e-4
PAIRS_AT_ONCE = 1 << 16


def _local(key: tuple, table: pa.Table) -> pa.Table:
    """The classes of equal vectors in one group: each row's class, and each class's vector, size and smallest id on its first row."""
    ids = table.column("vec_id").to_numpy()
    width = max((len(v) for v in table.column("v")), default=1)
    own = matrix(table.column("v"), width) + 0.0  # -0.0 becomes 0.0
    _, first, where = np.unique(own, axis=0, return_index=True, return_inverse=True)
    where = where.ravel()
    sizes = np.bincount(where, minlength=len(first))
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, where, ids)
    own_class = key[0].as_py() << 32 | where
    heads = np.zeros(len(ids), bool)
    heads[first] = True
    vectors = table.column("v").combine_chunks()
    keep = lambda x: pa.array([v if h else None for v, h in zip(x, heads, strict=True)], pa.int64())
    return pa.table({
        "vec_id": table.column("vec_id"),
        "local": pa.array(own_class, pa.int64()),
        "least": keep(least[where].tolist()),
        "copies": keep(sizes[where].tolist()),
        "v": pa.array([v if h else None for v, h in zip(vectors.to_pylist(), heads, strict=True)], pa.list_(pa.float64())),
    })


def principal_axes(vectors: DataFrame, width: int, rows: int) -> np.ndarray:
    """An orthogonal matrix, its columns by falling variance over at most SAMPLE_ROWS unit vectors chosen by a hash of the id."""
    turn = F.pmod(F.xxhash64("least"), F.lit(1 << 30))
    some = vectors.where(turn < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, rows)))).select("v").limit(SAMPLE_ROWS).toArrow()
    sample = matrix(some.column("v").cast(pa.list_(pa.float64())), width) if some.num_rows else np.zeros((0, width))
    sample = sample / np.abs(sample).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), np.finfo(float).tiny)
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def _packed(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A tile in one row."""
        names = [np.ascontiguousarray(table.column(c).to_numpy()).tobytes() for c in ("class", "least", "copies")]
        blobs = zip(("class", "least", "copies", "data"), [*names, matrix(table.column("v"), width).tobytes()], strict=True)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([b], pa.binary()) for c, b in blobs}})

    return run


def _squares(packed: DataFrame, tiles: int) -> DataFrame:
    """(low, high, column, tile, ...): each tile as a row and as a column of every square on or above the diagonal that it is part of.

    Of few tiles squares are smaller, so that there are as many as keep the cores busy.
    """
    cores = packed.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(SQUARE, int(tiles / np.sqrt(4 * cores))))
    sides = -(-tiles // side)
    own = F.floor(F.col("tile") / side).cast("int")
    as_row = packed.withColumn("low", own).withColumn("column", F.lit(False)).withColumn("high", F.explode(F.sequence(own, F.lit(sides - 1))))
    as_column = packed.withColumn("high", own).withColumn("column", F.lit(True)).withColumn("low", F.explode(F.sequence(F.lit(0), own)))
    both = as_row.unionByName(as_column)
    # the squares on or above the diagonal, numbered by column, are the partitions
    square = (F.col("high") * (F.col("high") + 1) / 2 + F.col("low")).cast("int")
    return both.withColumn("square", square).repartitionById(sides * (sides + 1) // 2, "square").sortWithinPartitions("square", "column", "tile")


class _Tile:
    def __init__(self, row: dict, width: int, axes: np.ndarray) -> None:
        self.number = row["tile"]
        self.classes, self.least, self.copies = (np.frombuffer(row[c], np.int64) for c in ("class", "least", "copies"))
        data = np.frombuffer(row["data"], np.float64).reshape(-1, width)
        data = data / np.abs(data).max(axis=1, keepdims=True)  # no square over- or underflows
        self.unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        self.turned = (self.unit @ axes).astype(np.float32)
        squares = np.cumsum(self.turned[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate((squares, np.zeros((len(data), 1))), axis=1)).astype(np.float32)


def _linked(a: _Tile, b: _Tile, i: slice, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) of two blocks with a cosine of at least the threshold."""
    width = a.turned.shape[1]
    done = min(STEP, width)
    bound = a.turned[i, :done] @ b.turned[j, :done].T
    bound += np.outer(a.suffix[i, done], b.suffix[j, done])
    x, y = np.nonzero(bound >= threshold - SLACK)
    x, y = x + i.start, y + j.start
    if a is b:
        x, y = x[x < y], y[x < y]
    found = [np.zeros((2, 0), np.int64)]
    for p in range(0, len(x), PAIRS_AT_ONCE):
        s, t = x[p : p + PAIRS_AT_ONCE], y[p : p + PAIRS_AT_ONCE]
        product = np.einsum("ij,ij->i", a.turned[s, :done], b.turned[t, :done])
        for k in range(done, width, STEP):
            stop = min(k + STEP, width)
            product = product + np.einsum("ij,ij->i", a.turned[s, k:stop], b.turned[t, k:stop])
            open_ = product + a.suffix[s, stop] * b.suffix[t, stop] >= threshold - SLACK
            s, t, product = s[open_], t[open_], product[open_]
        exact = np.einsum("ij,ij->i", a.unit[s], b.unit[t]) >= threshold
        found.append(np.stack((s[exact], t[exact])))
    both = np.concatenate(found, axis=1)
    return both[0], both[1]


def _labels(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest labels spread over the links (x, y)."""
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _met(a: _Tile, b: _Tile, threshold: float, block: int) -> pa.RecordBatch:
    """The links of two tiles, or within one, by class: their numbers and a spanning forest."""
    same = a is b
    shift = 0 if same else len(a.unit)
    links = np.zeros(shift + len(b.unit), np.int64)
    label = np.arange(len(links))
    for i in range(0, len(a.unit), block):
        for j in range(i if same else 0, len(b.unit), block):
            x, y = _linked(a, b, slice(i, min(i + block, len(a.unit))), slice(j, min(j + block, len(b.unit))), threshold)
            if len(x):
                np.add.at(links, x, b.copies[y])
                np.add.at(links, y + shift, a.copies[x])
                label = _labels(len(label), x, y + shift, label)
    classes = a.classes if same else np.concatenate((a.classes, b.classes))
    least = a.least if same else np.concatenate((a.least, b.least))
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict({"class": pa.array(classes[some]), "links": pa.array(links[some]), "a": pa.array(least[some]), "b": pa.array(least[label[some]])})


def _compare(width: int, axes: np.ndarray, threshold: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[_Tile] = []
        square = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["square"] != square:
                    square, rows = row["square"], []
                if not row["column"]:
                    rows.append(_Tile(row, width, axes))
                    continue
                other = next((t for t in rows if t.number == row["tile"]), None) or _Tile(row, width, axes)
                for tile in rows:
                    if tile.number <= other.number:
                        yield _met(tile, other, threshold, block)

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings(vec_id, embedding)."""
    good = usable_vectors(embeddings)
    good = good.where(F.exists("v", lambda x: x != 0))
    rows, width = shape(good)
    groups = max(1, -(-rows // TILE_ROWS))
    local = good.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).groupBy("group").applyInArrow(_local, "vec_id long, local long, least long, copies long, v array<double>")
    local = settle(local)
    heads = local.where("v is not null")
    # -0.0 and zeros after a shorter vector are the same class as without them
    whole = F.concat(F.transform("v", lambda x: x + F.lit(0.0)), F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    classes = settle(heads.groupBy(whole.alias("v")).agg(F.min("local").alias("class"), F.min("least").alias("least"), F.sum("copies").alias("copies")))
    n = classes.count()
    tiles = max(1, -(-n // TILE_ROWS))
    axes = principal_axes(classes, width, n)
    packed = settle(classes.withColumn("tile", F.pmod(F.xxhash64("class"), F.lit(tiles)).cast("int")).groupBy("tile").applyInArrow(_packed(width), "tile int, class binary, least binary, copies binary, data binary"))
    met = settle(_squares(packed, tiles).mapInArrow(_compare(width, axes, threshold, BLOCK_ROWS), "class long, links long, a long, b long"))
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    reached = X.components(met.select("a", "b").where("a <> b"))
    of_local = heads.select("local", whole.alias("v")).join(classes, "v").select("local", "class", "least", "copies")
    of_local = of_local.join(links, "class", "left").join(reached.select(F.col("node").alias("least"), "component"), "least", "left")
    of_local = of_local.select("local", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    linked = local.select("vec_id", "local").join(of_local, "local").select("vec_id", "n_links", "component_id")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rest = vectors.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (SELECT vec_id AS node, vec_id AS top FROM embeddings UNION SELECT edges.v, top FROM reached JOIN edges ON u = node
), tops AS (SELECT node, min(top) AS component_id FROM reached GROUP BY node
), linked AS (SELECT u, count(*) AS n_links FROM edges GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN tops ON node = vec_id LEFT JOIN linked ON u = vec_id
"""
