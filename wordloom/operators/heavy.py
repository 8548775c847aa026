"""Equi-joins of many rows with few by a key that some values dominate.

The key's frequent values are counted first, with partial aggregation. Each has
at least one in SHARE of the rows, so that there are at most SHARE of them, and
what they meet on the other side is broadcast. All other values are joined by
their hash; none of them is more than one in SHARE of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import settle

#: The reciprocal of the share of rows from which a value counts as frequent, and so the most frequent values.
SHARE = 200
#: Rows below which no value is worth a second look.
LEAST_ROWS = 1 << 20
#: Rows up to which a settled side is broadcast.
SMALL = 100_000
#: Rows of the other side that one frequent value may meet and still be broadcast.
MOST_MET = 1 << 10


def frequent(counts: DataFrame, key: str, share: int = SHARE, least: int = LEAST_ROWS) -> list[str]:
    """The frequent values of counts(key, n): those of one row in `share` or more, if there are `least` rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total < least:
        return []
    return [r[0] for r in counts.where((F.col("n") * share >= total) & F.col(key).isNotNull()).select(key).collect()]


def joined(rows: DataFrame, few: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The inner join of rows and few by the key, of which the given values are frequent in rows."""
    if not values:
        return rows.join(few, key)
    heavy = F.col(key).isin(values)
    met = few.where(heavy)
    # a value that meets very many rows is not broadcast
    wide = [r[0] for r in met.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MOST_MET).select(key).collect()]
    heavy = F.col(key).isin([v for v in values if v not in wide]) if wide else heavy
    if len(wide) == len(values):
        return rows.join(few, key)
    rest = rows.where(~heavy).join(few.where(~heavy), key)
    return rest.unionByName(rows.where(heavy).join(F.broadcast(few.where(heavy)), key))


def small(few: DataFrame) -> DataFrame:
    """A side that is cheap to compute, marked for broadcast if it has SMALL rows at most."""
    return F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few


def met(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with few by the key, where few is expected to be small: it is settled and counted, and broadcast up to SMALL rows. Beyond that its keys are joined as `joined_by` does."""
    few = settle(few)
    return rows.join(F.broadcast(few), key) if few.count() <= SMALL else joined_by(rows, few, key)


def joined_by(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join of settled rows and few by the key, whose frequent values are looked for first."""
    return joined(rows, few, key, frequent(rows.groupBy(key).agg(F.count("*").alias("n")), key))
