"""Which tokens hold misspelt words, and their roll-up per document and word."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import judging
from wordloom.functions import text as T
from wordloom.lists import TECH_WORDS, words_table
from wordloom.operators import heavy
from wordloom.operators.compounds import Compounds
from wordloom.sources.dictionary import accepted

#: Valid words up to which each task holds them as a set.
LISTED = 20_000


def valid_words(lexicon: DataFrame | None, extra: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """(key): lower-cased words that are never flagged, whatever their case: lexicon, technical words, extra and ignored words.

    A dictionary that minds the case is none of them: it goes to `invalid_parts` itself.
    """
    given = [w for w in (lexicon, extra, ignored) if w is not None]
    spark = given[0].sparkSession if given else SparkSession.active()
    known = words_table(spark, TECH_WORDS).select("word")
    for more in given:
        known = known.union(more.select("word"))
    return known.select(F.lower("word").alias("key")).distinct()


def listed(valid: DataFrame, most: int = LISTED) -> list[str] | None:
    """The keys of valid(key), unless there are more than `most`."""
    keys = [r[0] for r in valid.where(F.col("key").isNotNull()).select("key").limit(most + 1).collect()]
    return sorted(keys) if len(keys) <= most else None


def _among(value: str, words: list[str]) -> str:
    """A test whether a value is one of the words, which Spark keeps as a hash set."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"{value} IN ({quoted})" if words else "false"


#: A token whose one part that cleaning leaves is its first: small letters after at most one capital, with no separator before them.
ALONE = r"""\A["(\[]*[A-Z]?[a-z']*[^\w']*\z"""


def _flagged(rows: DataFrame, words: list[str], min_length: int) -> DataFrame:
    """rows(token, more) with each (part_pos, word) to flag, as `invalid_parts` defines it, by looks into a set: rows neither meet nor move.

    What most tokens are is told first: a valid word as it stands, then a valid word when cleaned, then one part,
    which is not looked up again. Only the others are cut into parts.
    """
    token, columns = F.col("token"), [c for c in rows.columns if c not in ("part_pos", "word")]
    known = [w for w in words if len(w) >= min_length]
    # a word in ASCII may be the small letters of other characters, which have more bytes and which cleaning drops
    plain = [w for w in known if re.fullmatch(r"[A-Za-z0-9_']+", w)]
    asked = rows.where(f"NOT (octet_length(lower(token)) = octet_length(token) AND {_among('lower(token)', plain)})")
    # a cleaned word is in ASCII, so that its small letters are as many
    asked = asked.withColumn("clean", T.clean_word(token)).where("NOT " + _among("lower(clean)", ["", *known]))
    own = f"length(clean) >= {min_length} AND NOT substring(clean, 1, 1) BETWEEN '0' AND '9'"
    pure = token.rlike(r"\A[\w'\-/.]*\z")  # its parts are clean
    parts = F.when(pure, T.split_identifiers(token)).otherwise(F.transform(T.split_identifiers(token), T.clean_word))
    parts = F.transform(parts, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    # the cheap tests come first
    flagged = f"p -> p.word <> '' AND length(p.word) >= {min_length} AND NOT substring(p.word, 1, 1) BETWEEN '0' AND '9' AND NOT {_among('lower(p.word)', words)}"
    asked = asked.withColumn("alone", token.rlike(ALONE)).withColumn("parts", F.when(~F.col("alone"), parts))
    asked = asked.withColumn("bad", F.expr(f"CASE WHEN NOT alone THEN filter(parts, {flagged}) WHEN {own} THEN array(named_struct('pos', 0, 'word', clean)) END"))
    # a token that is alone has no dot, or an empty segment behind it
    asked = asked.withColumn("segments", F.when(~F.col("alone") & (F.size("bad") > 0) & token.contains("."), F.transform(F.split(token, r"\."), lambda s: F.lower(T.clean_word(s)))))
    passes = F.expr(f"coalesce(forall(segments, s -> s <> '' AND {_among('s', words)}), false)")
    found = asked.select(*columns, F.explode_outer(F.when(~passes, F.col("bad"))).alias("b")).where(F.col("b").isNotNull())
    return found.select(*columns, F.col("b.pos").alias("part_pos"), "b.word")


def invalid_parts(distinct_tokens: DataFrame, valid: DataFrame, min_length: int = 1, dictionary: DataFrame | None = None, compounds: Compounds | None = None) -> DataFrame:
    """(token, part_pos, word): the sub-words to flag of each distinct token.

    A token with dots passes if all its segments are valid; any token passes if
    its cleaned whole is valid and long enough; else its identifier parts are
    tested one by one. One join tests all of a token's words, whatever their case.
    With a dictionary(word, keep_case), a word is also valid where the dictionary
    or its compounds accept it in its case; segments are tested in small letters.
    Up to LISTED valid words are a set that each task holds, and nothing is joined.
    """
    if dictionary is None and (words := listed(valid)) is not None:
        return judging.invalid_parts(distinct_tokens, words, min_length)
    token = F.col("token")
    whole = T.clean_word(token)
    candidate = lambda kind, pos, word: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), word.alias("word"))
    segments = F.when(token.contains("."), F.transform(F.split(token, r"\."), lambda s, i: candidate("segment", i, T.clean_word(s)))).otherwise(F.array().cast("array<struct<kind:string,pos:int,word:string>>"))
    parts = F.transform(T.split_identifiers(token), lambda p, i: candidate("part", i, T.clean_word(p)))
    tested = distinct_tokens.where(whole != "").select("token", F.explode(F.concat(F.array(candidate("whole", F.lit(0), whole)), segments, parts)).alias("w")).select("token", "w.*")
    tested = tested.withColumn("key", F.lower("word")).join(valid.withColumn("blind", F.lit(True)), "key", "left").withColumn("valid", F.coalesce("blind", F.lit(False)))
    if dictionary is not None:
        tested = tested.withColumn("form", F.when(F.col("kind") == "segment", F.col("key")).otherwise(F.col("word")))
        cased = accepted(tested.where(~F.col("valid") & (F.col("form") != "")).select(F.col("form").alias("word")), dictionary, compounds)
        cased = cased.where("valid").select(F.col("word").alias("form"), F.lit(True).alias("cased"))
        tested = tested.join(cased, "form", "left").withColumn("valid", F.col("valid") | F.coalesce("cased", F.lit(False)))
    flagged = (F.col("kind") == "part") & ~F.col("valid") & (F.length("word") >= min_length) & (F.col("word") != "") & ~F.col("word").rlike("^[0-9]")
    judged = tested.groupBy("token").agg(
        F.bool_or((F.col("kind") == "whole") & F.col("valid") & (F.length("word") >= min_length)).alias("whole_valid"),
        F.coalesce(F.bool_and(F.when(F.col("kind") == "segment", F.col("valid") & (F.col("word") != ""))), F.lit(False)).alias("dotted_valid"),
        F.array_sort(F.collect_list(F.when(flagged, F.struct(F.col("pos").alias("part_pos"), "word")))).alias("bad"),
    )
    return judged.where(~F.col("whole_valid") & ~F.col("dotted_valid")).select("token", F.explode("bad").alias("b")).select("token", "b.part_pos", "b.word")


def occurrences(tokens: DataFrame, valid: DataFrame, min_length: int = 1) -> DataFrame:
    """(doc_id, line, pos, part_pos, word): every misspelt word of tokens(doc_id, line, pos, token).

    Validity depends on the token alone. Few valid words are looked up at each token,
    where it stands; of many, it is decided once per distinct token.
    """
    if (words := listed(valid)) is not None:
        return _flagged(tokens.select("doc_id", "line", "pos", "token"), words, min_length).drop("token")
    return placed(tokens, invalid_parts(tokens.select("token").distinct(), valid, min_length))


def placed(tokens: DataFrame, bad: DataFrame, frequent: list[str] | None = None) -> DataFrame:
    """(doc_id, line, pos, part_pos, word): the places of bad(token, part_pos, word). Frequent tokens, if known, are met apart from the others."""
    return heavy.joined(tokens, bad, "token", frequent or []).select("doc_id", "line", "pos", "part_pos", "word")


def misspellings(found: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, word, n, lines, first, kept columns): occurrences rolled up by case-sensitive word, lines distinct and ascending. Kept columns depend on the word."""
    kept = [F.first(c).alias(c) for c in keep]
    return found.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("lines"), F.min(F.struct("line", "pos", "part_pos")).alias("first"), *kept)
