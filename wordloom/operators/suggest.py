"""Correction candidates by a symmetric-delete index, exact distances, ranking and learned fixes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import text as T
from wordloom.functions.distance import alignment_distance
from wordloom.operators import heavy

MOST_EDITS = 2
INDEX_EDITS = 1
SUGGESTIONS = 3


def deletion_index(vocabulary: DataFrame, depth: int = INDEX_EDITS) -> DataFrame:
    """(deletion, candidate) of vocabulary(word): each suggestable word under all its deletions."""
    words = vocabulary.select(F.lower("word").alias("candidate")).where(T.is_suggestable(F.col("candidate"))).distinct()
    return words.select(F.explode(T.deletions(F.col("candidate"), depth)).alias("deletion"), "candidate")


def known_deletions(word: str, depth: int, known: frozenset[str]) -> list[str]:
    """Those of a word's deletions, as `text.deletions` has them, that are known."""
    level, found = {word}, {word} & known
    for left in range(depth - 1, -1, -1):
        cut = (w[:i] + w[i + 1 :] for w in level for i in range(len(w)))
        level = set(cut) if left else cut  # the last level is only looked up
        found.update(level & known if left else known.intersection(level))
    return list(found)


def _known(word: Column, depth: int, deletions: list[str]) -> Column:
    known = frozenset(deletions)

    @F.pandas_udf("array<string>")
    def of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: known_deletions(w, depth, known))

    return of(word)


def candidates(queries: DataFrame, index: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """(query, candidate): distinct pairs that share a deletion string.

    A small index is broadcast; then neither deletions nor pairs are shuffled, as they stay where their query is.
    A query has some hundred deletions, of which an index has few: of a small one, each task holds the deletions, and only those are made rows.
    """
    held = [r[0] for r in index.select("deletion").limit(heavy.SMALL + 1).collect()]
    index = F.broadcast(index) if len(held) <= heavy.SMALL else index
    longest = index.agg(F.max(F.length("candidate"))).first()[0] or 0
    words = queries.select(F.lower("word").alias("query")).where(F.length("query").between(2, longest + most)).distinct()
    deletions = _known(F.col("query"), most, held) if len(held) <= heavy.SMALL else T.deletions(F.col("query"), most)
    deleted = words.select("query", F.explode(deletions).alias("deletion"))
    pairs = deleted.join(index, "deletion").where((F.col("query") != F.col("candidate")) & (F.abs(F.length("query") - F.length("candidate")) <= most))
    return pairs.select("query", "candidate").distinct()


def scored(pairs: DataFrame, valid: DataFrame | None = None, most: int = MOST_EDITS) -> DataFrame:
    """(query, candidate, distance) within `most` edits; candidates outside valid(word), if given, are dropped."""
    if valid is not None:
        pairs = pairs.join(heavy.small(valid.select(F.col("word").alias("candidate")).distinct()), "candidate", "left_semi")
    return pairs.withColumn("distance", alignment_distance(F.col("query"), F.col("candidate"), most)).where(F.col("distance") <= most)


def ranked(found: DataFrame, common: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """(query, rank, candidate, distance): nearest first, then common words, like lengths, and collation order."""
    marked = found.join(heavy.small(common.select(F.col("word").alias("candidate"), F.lit(1).alias("common"))), "candidate", "left")
    order = Window.partitionBy("query").orderBy("distance", F.coalesce("common", F.lit(0)).desc(), F.abs(F.length("candidate") - F.length("query")), F.collate("candidate", "UNICODE"))
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "candidate", "distance")


def suggestions(queries: DataFrame, vocabulary: DataFrame, common: DataFrame, valid: DataFrame | None = None, index_edits: int = INDEX_EDITS, most: int = MOST_EDITS, limit: int = SUGGESTIONS) -> DataFrame:
    """(query, suggestions, top_distance) for each lower-cased query of queries(word) that has any."""
    best = ranked(scored(candidates(queries, deletion_index(vocabulary, min(index_edits, most)), most), valid, most), common, limit)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "distance"))).alias("all"))
    return lists.select("query", F.transform("all", lambda s: s["candidate"]).alias("suggestions"), F.element_at("all", 1)["distance"].alias("top_distance"))


def with_learned(words: DataFrame, suggested: DataFrame, corrections: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """(word, suggestions, top_distance) for words(word): a learned fix comes first and counts as distance 1."""
    typed = corrections.select(F.col("typo").alias("query"), "fix")
    joined = words.select("word", F.lower("word").alias("query")).distinct().join(suggested, "query", "left").join(typed, "query", "left")
    others = F.coalesce("suggestions", F.array().cast("array<string>"))
    learned = F.col("fix").isNotNull() & (F.lower("fix") != F.col("query"))
    first = F.slice(F.concat(F.array("fix"), F.filter(others, lambda s: s != F.col("fix"))), 1, limit)
    return joined.select("word", F.when(learned, first).otherwise(others).alias("suggestions"), F.when(learned, 1).otherwise(F.col("top_distance")).alias("top_distance"))
