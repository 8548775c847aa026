"""Joins by keys that some values dominate."""

from pyspark.sql import functions as F

from wordloom.operators import check as C
from wordloom.operators import heavy, preprocess
from wordloom.plans.check import Options, check


def test_frequent_values(spark, monkeypatch):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, "the").when(F.col("id") < 500, "teh").when(F.col("id") < 510, F.lit(None)).otherwise(F.col("id").cast("string")).alias("key"), "id")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert heavy.frequent(counts, "key") == []  # too few rows to mind
    assert sorted(heavy.frequent(counts, "key", least=1)) == ["teh", "the"]
    assert heavy.frequent(counts.limit(0), "key") == []


def test_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(heavy, "MOST_MET", 3)
    rows = spark.range(3000).select((F.col("id") % 7).cast("string").alias("key"), "id").union(spark.sql("select cast(null as string), 1L"))
    few = spark.range(40).select((F.col("id") % 9).cast("string").alias("key"), F.col("id").alias("other"))
    plain = sorted(tuple(r) for r in rows.join(few, "key").collect())
    for values in ([], ["1"], ["1", "2", "8", "none"], [str(i) for i in range(9)]):
        assert sorted(tuple(r) for r in heavy.joined(rows, few, "key", values).collect()) == plain


def test_no_task_of_the_check_is_much_larger_than_others(spark, monkeypatch):
    """One token is most of a corpus; what is shuffled by token holds none of it, nor of the frequent good word."""
    monkeypatch.setattr(heavy, "LEAST_ROWS", 1)
    monkeypatch.setattr(heavy.frequent, "__defaults__", (heavy.SHARE, 1))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("teh " * 20 + "the " * 20), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    tokens = preprocess.tokens(docs)
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    values = heavy.frequent(counts, "token")
    assert sorted(values) == ["teh", "the"]
    lexicon = spark.createDataFrame([("the",)], "word string")
    bad = C.invalid_parts(counts.select("token"), C.valid_words(lexicon))
    left = tokens.where(~F.col("token").isin(values)).groupBy("token").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(left) == (1, 300)
    got = sorted(tuple(r) for r in C.placed(tokens, bad, values).collect())
    assert got == sorted(tuple(r) for r in C.placed(tokens, bad).collect())
    assert len(got) == 300 * 21
    found = check(docs, Options(lexicon))
    assert found.misspelt.agg(F.sum("n")).first()[0] == 300 * 21
