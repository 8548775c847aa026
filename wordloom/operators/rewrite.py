"""Fixes: lines rewritten with top suggestions, diffs, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import rewriting
from wordloom.functions import text as T
from wordloom.operators import heavy

_INK, _BEFORE = "[A-Za-z0-9_]", "(?<=[A-Za-z0-9_])"
#: Where a word character of ASCII meets another character, or the line's end.
EDGE = f"(?:{_BEFORE}(?!{_INK})|{T.BEFORE}(?={_INK}))"


def whole_word(word: Column) -> Column:
    """A pattern for a word between edges, in any ASCII case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?i){EDGE}"), quoted, F.lit(EDGE))


def replaced(line: Column, word: Column, replacement: Column) -> Column:
    """A line with each match of a whole word replaced, in the match's case: the pieces between matches, and what comes for each match, in turn."""
    pattern = whole_word(word)
    new = F.transform(F.regexp_extract_all(line, pattern, F.lit(0)), lambda m: T.match_case(replacement, m))
    return F.array_join(F.zip_with(F.split(line, pattern, -1), new, lambda piece, n: F.concat(piece, F.coalesce(n, F.lit("")))), "")


def rewritten(line: Column, fixes: Column) -> Column:
    """A line after an array of (word, replacement), each in turn; a later word may match what an earlier one put in."""
    return F.aggregate(fixes, line, lambda now, f: replaced(now, f["word"], f["replacement"]))


def independent(words: Column, replacements: Column) -> Column:
    """Whether the order of fixes is of no account: all are runs of word characters, and no replacement is a word itself. Then each run of a line is replaced at most once."""
    run = r"\A\w+\z"  # of ASCII, in Java
    small = F.transform(words, F.lower)
    return F.forall(words, lambda w: w.rlike(run)) & F.forall(replacements, lambda r: r.rlike(run)) & ~F.arrays_overlap(small, F.transform(replacements, F.lower)) & (F.size(F.array_distinct(small)) == F.size(words))


def rewritten_once(line: Column, words: Column, replacements: Column) -> Column:
    """A line after independent fixes of words in small letters, which should be columns of their own: it is cut once, into runs of word characters and what lies between."""
    pieces = F.transform(F.regexp_extract_all(line, F.lit(r"\w+|\W+"), F.lit(0)), lambda p: F.struct(p.alias("piece"), F.array_position(words, F.lower(p)).cast("int").alias("at")))
    return F.array_join(F.transform(pieces, lambda p: F.when(p["at"] > 0, T.match_case(F.element_at(replacements, p["at"]), p["piece"])).otherwise(p["piece"])), "")


def fixes(docs: DataFrame, found: DataFrame, suggested: DataFrame) -> DataFrame:
    """(doc_id, line, old_line, new_line): changed lines of docs, by occurrences and (word, suggestions).

    A document meets all its fixes at once, and its lines are rewritten where its text is.
    """
    top = suggested.where(F.size("suggestions") > 0).select("word", F.element_at("suggestions", 1).alias("replacement"))
    each = heavy.met(found.select("doc_id", "line", "pos", "part_pos", "word"), top, "word")
    fix = F.struct("line", "pos", "part_pos", F.lower("word").cast("binary").alias("word"), "replacement")
    own = each.groupBy("doc_id").agg(F.collect_list(fix).alias("fixes"))
    return rewriting.rewritten(docs.select("doc_id", "text").join(own, "doc_id"))


def fixed_documents(docs: DataFrame, fixed: DataFrame) -> DataFrame:
    """(doc_id, text): documents with their changed lines in place; the input is never overwritten."""
    changes = fixed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "new_line"))).alias("new"))
    text = F.array_join(F.transform(F.split("text", "\n", -1), lambda v, i: F.coalesce(F.element_at("new", i + 1), v)), "\n")
    return docs.join(changes, "doc_id", "left").select("doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(text).alias("text"))


def write_documents(fixed: DataFrame, path: str) -> None:
    """Write fixed documents to a new Parquet table; one that is there already is an error."""
    fixed.write.mode("error").parquet(path)


def diff(fixed: DataFrame) -> DataFrame:
    """(doc_id, line, hunk): one hunk per changed line."""
    return fixed.select("doc_id", "line", F.concat(F.lit("@@ line "), F.col("line").cast("string"), F.lit("\n-"), "old_line", F.lit("\n+"), "new_line").alias("hunk"))


def learned_pairs(found: DataFrame, suggested: DataFrame) -> DataFrame:
    """(typo, fix): the top suggestion of each lower-cased fixable word, of its last occurrence. Occurrences are reduced to each word's last one before they meet the suggestions."""
    top = suggested.where(F.size("suggestions") > 0).select("word", F.element_at("suggestions", 1).alias("fix"))
    last = found.groupBy("word").agg(F.max(F.struct("doc_id", "line", "pos", "part_pos")).alias("last"))
    return last.join(top, "word").groupBy(F.lower("word").alias("typo")).agg(F.max_by("fix", "last").alias("fix"))


def learned_fixes(suggested: DataFrame) -> DataFrame:
    """(typo, fix): `learned_pairs` of (word, suggestions) that depend on the lower-cased word alone, as those of `suggest.with_learned` do: no occurrence is asked."""
    top = suggested.where(F.size("suggestions") > 0).select(F.lower("word").alias("typo"), F.element_at("suggestions", 1).alias("fix"))
    return top.groupBy("typo").agg(F.max("fix").alias("fix"))


def unfixable(found: DataFrame, suggested: DataFrame) -> DataFrame:
    """(doc_id, place, word): distinct words without any suggestion, as first seen."""
    from pyspark.sql.window import Window

    none = suggested.where(F.size("suggestions") == 0).select("word")
    first = heavy.joined_by(found, none, "word").groupBy("doc_id", "word").agg(F.min(F.struct("line", "pos", "part_pos")).alias("first"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("place"), "word")
