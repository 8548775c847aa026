"""Word lists and learned corrections: one entry a line, # starts a comment."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.sources import commits


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line of the text files at a path; only line feeds end a line."""
    return spark.read.text(path, lineSep="\n")


def entries(lines: DataFrame) -> DataFrame:
    """lines(value, ...) without comments, white space around, and blanks."""
    return lines.withColumn("value", T.trim(F.regexp_replace("value", r"#[^\n\r\x{2028}\x{2029}]*\z", ""))).where("value <> ''")


def wordlist(lines: DataFrame) -> DataFrame:
    """(word) of lines(value)."""
    return entries(lines).select(F.col("value").alias("word"))


def corrections(lines: DataFrame) -> DataFrame:
    """(typo, fix) of lines(line_no, value): typo=fix, split at the first sign; a later line wins."""
    at = F.instr("value", "=")
    kept = entries(lines).where((at > 1) & (at < F.length("value")))
    pairs = kept.select("line_no", F.lower(T.trim(F.expr("substring(value, 1, instr(value, '=') - 1)"))).alias("typo"), T.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("fix"))
    return pairs.where("typo <> '' and fix <> ''").groupBy("typo").agg(F.max_by("fix", "line_no").alias("fix"))


def new_words(words: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of words(word) that existing(word) lacks, whatever the case; repeats among the new ones stay."""
    known = existing.select(F.lower("word").alias("key")).distinct()
    return words.withColumn("key", F.lower("word")).join(known, "key", "left_anti").drop("key")


def new_corrections(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of pairs(typo, fix) that existing(typo, fix) does not already map to the same fix."""
    known = existing.select(F.col("typo").alias("key"), "fix").distinct()
    return pairs.withColumn("key", F.lower("typo")).join(known, ["key", "fix"], "left_anti").select("typo", "fix")


def append_words(words: DataFrame, existing: DataFrame, path: str, key: str | None = None) -> int:
    """Append the words that neither existing(word) nor the word list at a path holds in any case; their number.

    The key names the batch: one that is tried again, by a writer that does not know how far it came, appends nothing twice.
    """
    known = lambda lines: wordlist(lines).union(existing.select("word"))
    return commits.append(words.sparkSession, path, key or uuid4().hex, lambda lines: new_words(words, known(lines)).select(F.col("word").alias("value")))


def add_word(spark: SparkSession, word: str, existing: DataFrame, path: str, key: str | None = None) -> int:
    """Append one word, unless it is there in any case; how many were appended."""
    return append_words(spark.createDataFrame([(word,)], "word string"), existing, path, key)


def append_corrections(pairs: DataFrame, existing: DataFrame, path: str, key: str | None = None) -> int:
    """Append the pairs that neither existing(typo, fix) nor the corrections at a path hold, as typo=fix lines; their number. The key is that of `append_words`."""

    def fresh(lines: DataFrame) -> DataFrame:
        known = read_corrections(lines).union(existing.select("typo", "fix"))
        return new_corrections(pairs, known).select(F.concat_ws("=", "typo", "fix").alias("value"))

    return commits.append(pairs.sparkSession, path, key or uuid4().hex, fresh)


def read_corrections(lines: DataFrame) -> DataFrame:
    """(typo, fix) of the lines of `commits.read_batches`: that of the latest batch wins."""
    return corrections(lines.withColumn("line_no", F.struct("batch", "value")))
