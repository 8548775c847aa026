"""Mixing sources to target weights: a time-varying curriculum over all documents.

Method (DataFrame and SQL functions only):

1. Sizes are word counts of whole texts. Sources, in code point order with null
   last, get weights 3, 1, 2, repeating. The mix has 1.5 times all words; a
   source's target is its share by weight, at most twice its size, what exceeds
   that being shared again by weight (water-filling, solved in closed form).
2. A source's documents stand in a fixed pseudo-random order, by the MD5 of
   their id and text. Their cumulative sizes are summed in two levels, over 4,096 hash
   buckets and then within each bucket, so that no source is one task. The mix
   runs through that order until the target is reached, at most twice.
3. A source's weight may rise or fall over training: its rate at time t is
   target * (1 + slope * (2 t - 1)). The integral of the rate is the words
   demanded until t; inverting it gives each copy's training position from the
   words before it. `training_order` range-sorts copies by position.

The last document that a source takes may be taken in part, so that the words
taken are the target rounded down.

Defined results: a null or empty text has size 0 and takes nothing. A null
doc_id is hashed as an empty string beside its text. Equal rows are interchangeable and share
the words of both. Extra columns are ignored unless carried. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm import exchange as X
from wordloom.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The change of a source's rate over training, by the same turn as WEIGHTS.
SLOPES = (-0.5, 0.5, 0.0)
SHARE = 1.5
MOST_PASSES = 2.0


def _turn(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def _position(words_before: Column) -> Column:
    """The time at which a source has asked for so many words: the inverse of its cumulative demand."""
    u, a = F.try_divide(words_before.cast("double"), F.col("goal").cast("double")), F.col("slope")
    return 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, goal, slope) from (source, size): one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(in_order))
    ranked = ranked.withColumn("weight", _turn(WEIGHTS, F.col("rank"))).withColumn("slope", _turn(SLOPES, F.col("rank")))
    cap = F.col("source_size") * F.lit(MOST_PASSES)
    below = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum(cap).over(below), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(cap, F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"), F.floor(target).cast("long").alias("goal"), "slope")


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken, first_position, second_position; with `carry`, also those columns as the struct `carried`."""
    # rows that share an id, or have none, go by their text, so that no id is one window
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).cast("binary"))
    # a source's name in a form that is never null, so that windows and the join have the same keys and rows are dealt once
    source = F.col("source").cast("string")
    of = F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))
    sized = docs.select("doc_id", source.alias("source"), of.alias("of"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"), *([X.packed(docs, carry).alias("carried")] if carry is not None else []))
    if carry is None:
        sized = settle(sized)
    buckets = settle(sized.groupBy("of", "source", "bucket").agg(F.sum("size").alias("size")))
    before = F.sum("size").over(Window.partitionBy("of").orderBy("bucket")) - F.col("size")
    targets = source_targets(buckets).withColumnRenamed("source", "named")
    offsets = buckets.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("named")))
    offsets = offsets.select("of", "bucket", "before", "source_size", "target", "goal", "slope")
    inside = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("through", F.sum("size").over(inside)).join(offsets, ["of", "bucket"])
    at = F.col("before") + F.col("through") - F.col("size")
    again = at + F.col("source_size")
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start))
    return placed.select(
        "doc_id", "size", "source_size", "target", (part(at) + part(again)).cast("long").alias("taken"),
        F.when(part(at) > 0, _position(at)).alias("first_position"), F.when(part(again) > 0, _position(again)).alias("second_position"),
        *(["carried"] if carry is not None else []),
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first copy; those that the mix leaves out come last."""
    out = mixed.columns
    far = F.coalesce("first_position", F.lit(2.0))  # positions are at most 1
    keyed = mixed.withColumn("at", far).repartitionByRange("at", "doc_id", "size")
    return keyed.sortWithinPartitions("at", "doc_id", "size").select(*out)


def training_order(docs: DataFrame) -> DataFrame:
    """A row of docs for each copy that the mix takes, range-sorted by training position; a copy taken in part keeps its first words, joined by spaces.

    Whole rows are dealt twice: by source and bucket, and by position.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    mixed = mix(docs, [*own, "text"])
    first = F.least("size", "taken")
    copies = F.array(F.struct(F.col("first_position").alias("position"), first.alias("words")), F.struct(F.col("second_position").alias("position"), (F.col("taken") - first).alias("words")))
    each = mixed.select("doc_id", F.col("carried")[f"c{len(own)}"].cast("string").alias("text"), "carried", "size", F.explode(F.filter(copies, lambda c: c["position"].isNotNull())).alias("copy"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("copy.words").cast("int"))
    text = F.when(F.col("copy.words") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " "))
    each = each.select("doc_id", text.alias("text"), F.col("copy.position").alias("position"), F.struct(F.lit(True).alias("row"), *(F.col("carried")[f"c{i}"].alias(f"c{i}") for i in range(len(own)))).alias("carried"))
    each = each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    size = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return each.select("doc_id", "text", *size, *X.unpacked(own)).select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CAST(CASE (rank - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS slope,
         CAST(2 AS DOUBLE) * source_size AS cap
  FROM sources
), levelled AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, slope, least(cap, max(level) OVER () * weight) AS target FROM levelled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS goal,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS began
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), parts AS (
  SELECT *, greatest(0, least(size, goal - began)) AS once, greatest(0, least(size, goal - began - source_size)) AS twice,
         CAST(began AS DOUBLE) / nullif(goal, 0) AS u, CAST(began + source_size AS DOUBLE) / nullif(goal, 0) AS v
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
       CASE WHEN once > 0 THEN 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END AS first_position,
       CASE WHEN twice > 0 THEN 2 * v / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * v)) END AS second_position
FROM parts
"""
