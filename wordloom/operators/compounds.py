"""Words made of several others, by rules over the flags of their parts.

A word is cut at every place; the pieces meet the parts in one equi-join, which
leaves the edges of a graph over the word's places. The rules are one automaton,
whose moves an edge makes by the part's flag. A fold over a word's edges in order
of their start keeps the states reached at each place, as a table of dynamic
programming would; places that are behind are forgotten, so that a very long word
needs no more memory than its longest part. Case is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.heavy import SMALL
from wordloom.storage import settle


def automaton(rules: list[list[tuple[str, str]]]) -> tuple[list[int], list[tuple[int, str, int]], list[int]]:
    """The start states, the moves (state, flag, state), and the final states of rules of (flag, quantifier), which is "", "*" or "?".

    The state after the i-th element of a rule stands for all that may follow it; what may be left out is passed over.
    """
    starts, moves, finals, first = [], [], [], 0
    for rule in rules:
        starts.append(first)
        for state in range(len(rule) + 1):
            if state and rule[state - 1][1] == "*":
                moves.append((first + state, rule[state - 1][0], first + state))
            following = state
            while following < len(rule):
                moves.append((first + state, rule[following][0], first + following + 1))
                if not rule[following][1]:
                    break
                following += 1
            else:
                finals.append(first + state)
        first += len(rule) + 1
    return starts, moves, finals


@dataclass
class Compounds:
    """parts(word, flag) in small letters; rules of flags with quantifiers; the fewest characters of a compound."""

    parts: DataFrame
    rules: list[list[tuple[str, str]]]
    least: int = 1

    def among(self, words: DataFrame) -> DataFrame:
        """Those of words(word) that are compounds, once."""
        spark = words.sparkSession
        starts, moves, finals = automaton(self.rules)
        longest = self.parts.agg(F.max(F.length("word"))).first()[0]
        if not longest or not moves:
            return words.select("word").limit(0)
        states = max(max(a, b) for a, _, b in moves) + 1
        given = words.select("word").where(F.length("word") >= max(1, self.least)).distinct()
        at = given.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
        cut = at.select("word", "at", F.explode(F.expr(f"sequence(1, least({longest}, length(word) - at))")).alias("size"))
        pieces = cut.select("word", "at", (F.col("at") + F.col("size")).alias("end"), F.lower(F.expr("substring(word, at + 1, size)")).alias("piece"))
        step = spark.createDataFrame(moves, "source int, flag string, target int")  # of a rule file
        known = settle(self.parts.select(F.col("word").alias("piece"), "flag").distinct())
        # a word has very many pieces: they are not shuffled where the parts are few
        known = F.broadcast(known) if known.count() <= SMALL else known
        edges = pieces.join(known, "piece").join(F.broadcast(step), "flag")
        place = lambda where, state: F.col(where).cast("long") * states + F.col(state)
        edges = edges.select("word", F.struct("at", place("at", "source").alias("source"), place("end", "target").alias("target")).alias("edge"))
        graphs = edges.groupBy("word").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
        begun = F.array(*(F.lit(s).cast("long") for s in starts))

        def walk(reached, edge):
            ahead = F.filter(reached, lambda s: s >= edge["at"].cast("long") * states)
            return F.when(F.array_contains(ahead, edge["source"]), F.array_union(ahead, F.array(edge["target"]))).otherwise(ahead)

        reached = F.aggregate("edges", begun, walk)
        ends = F.array(*(F.length("word").cast("long") * states + s for s in finals))
        return graphs.where(F.arrays_overlap(reached, ends)).select("word")
