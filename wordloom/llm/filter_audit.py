"""Filter interaction audit: what every filter removes in every order of filters, for each part of a corpus.

Method: a subset-zeta transform.

1. One pass over the texts tells each document's mask of failing filters, bit i
   for the i-th filter, and a digest of its text. Of equal texts all but those
   with the smallest doc_id are copies; the smallest id of each digest comes from
   a partial aggregation and meets the documents by digest and id together, so
   that a text in a third of all rows is no single task. Labels join by id.
2. Documents are counted for each part and mask: 2**n figures a part.
3. The zeta transform over subsets, n butterfly steps on an array of 2**n
   figures, turns the counts of exact masks into the counts of documents whose
   mask lies within a set, which are the survivors of the other filters.
4. A step of an order is the difference between the survivors of two
   neighbouring subsets; so it is for the survivors among labelled documents. A
   filter's Shapley value over all orders is the sum of its differences, each as
   often as orders come through it.

Defined results: a null text is empty and a null lang is the empty string, one
part with it. A document is a row: rows that repeat count each. Null ids come
after all others and are equal to each other. A document has a label if any of
its id's label rows has; one without id has none. Extra columns are ignored. A
table without rows has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.storage import settle

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT, MOST_CAPITALS = 50, 3  # per cent
SYMBOLS = "[#$%&*|]"
_SPACES = "\t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is followed through the orders: all documents, and those with a label.
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text that is not null fails each of the filters A to D."""
    split = F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " ", -1)
    words, distinct = F.size(F.array_remove(split, "")), F.size(F.array_remove(F.array_distinct(split), ""))
    size = F.length(text)
    capitals = size - F.length(F.translate(text, _CAPITALS, ""))
    return [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * size, text.rlike(SYMBOLS)]


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many documents of docs(doc_id, text, lang) have an id, a part and a mask of failing filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))]
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    seen = docs.select("doc_id", part.alias("part"), text.alias("text")).select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), digest.alias("digest"), F.octet_length("text").alias("size"))
    seen = settle(seen.groupBy("digest", "size", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    first = seen.groupBy("digest", "size").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    # nulls in one more column than the id itself, so that both sides meet by plain equality
    known = lambda rows: rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("nameless", F.col("doc_id").isNull())
    joined = known(seen).join(known(first).drop("doc_id"), ["digest", "size", "id", "nameless"], "left")
    copies = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    return joined.select("doc_id", "part", (F.col("mask") + copies).alias("mask"), "n")


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of documents(doc_id, part, mask, n) and labels(doc_id, quality, toxic)."""
    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    named = documents.where("doc_id is not null").join(told, "doc_id", "left")
    nameless = documents.where("doc_id is null").withColumns({"is_good": F.lit(None).cast("boolean"), "is_toxic": F.lit(None).cast("boolean")})
    both = named.select("part", "mask", "n", "is_good", "is_toxic").unionByName(nameless.select("part", "mask", "n", "is_good", "is_toxic"))
    labelled = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), labelled("is_good").alias("good"), labelled("is_toxic").alias("toxic"))


def survivors(counts: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """A row a part, with an array for each measure: the number of documents that every subset of filters, as a mask, leaves."""
    out = counts.groupBy("part").agg(*(F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(1 << bits))).alias(c) for c in MEASURES))
    for b in range(bits):  # one step of the transform at a time, so that expressions stay small
        step = lambda c, b=b: F.transform(c, lambda v, i: v + F.when(F.getbit(i, F.lit(b)) == 1, F.get(F.col(c), i - (1 << b))).otherwise(0))
        out = out.select("part", *(step(c).alias(c) for c in MEASURES))
    # a subset leaves the documents whose masks lie within the other filters
    return out.select("part", *(F.reverse(c).alias(c) for c in MEASURES))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of every part, order and step, from (part, mask, n, good, toxic)."""
    n = len(filters)
    everything = (1 << n) - 1
    left = survivors(counts, n)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    at = lambda c, subset: F.get(F.col(c), subset)
    weights = [0] * (1 << n)  # through how many orders each subset is what came before a filter
    for p in permutations(range(n)):
        for k in range(n):
            weights[sum(1 << i for i in p[:k])] += 1
    # of all orders with a given set before, each filter that is not in the set comes next equally often
    weight = F.array(*(F.lit(w // max(1, n - m.bit_count())).cast("long") for m, w in enumerate(weights)))
    each = left.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = F.expr(f"aggregate(sequence(1, {n}), 0, (a, i) -> a + if(i < step, shiftleft(1, instr('{filters}', substring(filter_order, i, 1)) - 1), 0))")
    each = each.withColumn("own", F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, step, 1)) - 1)")).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))
    removed = at("n", F.col("before")) - at("n", F.col("after"))
    fails = at("n", F.lit(0)) - at("n", F.col("own"))
    shapley = F.expr(f"aggregate(sequence(0, {everything}), 0L, (a, s) -> a + if((s & own) = 0, weight[s] * (n[s] - n[s + own]), 0L))")
    return each.withColumn("weight", weight).select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (at("n", F.lit(everything) - F.col("own")) - at("n", F.lit(everything))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"), (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs(doc_id, text, lang) with labels(doc_id, quality, toxic)."""
    return audit(settle(mask_counts(masked(docs), labels)))


#: Plain counting: every document's mask against every order and step.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failing AS MATERIALIZED (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL) THEN 1 ELSE 0 END AS e
  FROM texts
), counts AS MATERIALIZED (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM failing GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM letter v, letter w, letter x, letter y, letter z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), judged AS (
  SELECT part, filter_order, step, n, good, toxic, a + b + c + d + e AS failed,
         list_contains(f, substr(filter_order, step, 1)) AS own, len(list_filter(f, lambda x: instr(filter_order, x) < step)) > 0 AS earlier
  FROM (SELECT *, list_filter([CASE a WHEN 1 THEN 'A' END, CASE b WHEN 1 THEN 'B' END, CASE c WHEN 1 THEN 'C' END, CASE d WHEN 1 THEN 'D' END, CASE e WHEN 1 THEN 'E' END], lambda x: x IS NOT NULL) AS f FROM counts), steps
), rows AS (
  SELECT part, filter_order, step, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM rows
"""
