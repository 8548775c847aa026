"""From documents to tokens: lines, inline directives, noise, white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import counting
from wordloom.functions import text as T
from wordloom.operators.markdown import blank_markdown

#: Bytes of a core's share below which a table is dealt anew.
DEALT_BYTES = 32 << 20


def lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, line, value): split at line feeds, numbered from 1, trailing empty lines kept."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n", -1)).alias("at", "value")).select("doc_id", *keep, (F.col("at") + 1).alias("line"), "value")


def active_lines(split: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines that no inline directive turns off.

    A block is off from `off` to `on`. `disable-next-line` arms one skip, which the
    next line outside a block uses up. A directive's own line never counts.
    """
    marked = split.withColumn("kind", F.lower(F.regexp_extract("value", T.DIRECTIVE, 1)))
    so_far = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(F.col("kind").isin("off", "on"), F.col("kind")), ignorenulls=True).over(so_far)
    armed = F.sum((F.col("kind") == "disable-next-line").cast("int")).over(so_far)
    counted = marked.withColumn("armed", armed).withColumn("state", state).where((F.col("kind") == "") & (F.coalesce("state", F.lit("on")) == "on"))
    used = F.lag("armed", 1, 0).over(Window.partitionBy("doc_id").orderBy("line"))
    return counted.withColumn("used", used).where(F.col("armed") == F.col("used")).select("doc_id", *keep, "line", "value")


def _has_directive() -> Column:
    """Texts without the word, which a plain search tells, skip the pattern."""
    return F.coalesce(F.lower("text").contains("spellcheck:") & F.col("text").rlike(T.DIRECTIVE), F.lit(False))


def checked_lines(docs: DataFrame, markdown: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, line, value): the lines to check. Only documents with a directive are sorted for its window."""
    source = blank_markdown(docs) if markdown else docs
    has = _has_directive()
    return lines(source.where(~has), keep).unionByName(active_lines(lines(source.where(has), keep), keep))


def dealt(docs: DataFrame) -> DataFrame:
    """docs over as many tasks as there are cores, if they are too small a table to fill them: one row group is one task. Larger tables are not shuffled."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * DEALT_BYTES else docs


def token_lines(docs: DataFrame, markdown: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, line, found): the tokens of each line of docs(doc_id, text) as an array."""
    kept = checked_lines(dealt(docs.select("doc_id", "text", *keep)), markdown, keep)
    # a step at a time, as each looks at its value more than once
    kept = kept.withColumn("value", T.strip_noise(F.col("value")))
    return kept.select("doc_id", *keep, "line", T.tokens(F.col("value")).alias("found"))


def tokens(docs: DataFrame, markdown: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, line, pos, token) of docs(doc_id, text)."""
    # the outer form, as the inner one is planned with a filter on the array's size, which finds all tokens once more
    return token_lines(docs, markdown, keep).select("doc_id", *keep, "line", F.posexplode_outer("found").alias("pos", "token")).where(F.col("token").isNotNull())


def document_texts(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """(doc_id, text): each row's text of docs(doc_id, text) without the lines that are turned off. No noise or token reaches over a line's end, so texts without a directive are not cut into lines."""
    own = dealt(docs.select("doc_id", "text"))
    own = blank_markdown(own) if markdown else own
    has = _has_directive()
    kept = active_lines(lines(own.where(has))).groupBy("doc_id").agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    return own.where(~has).select("doc_id", "text").unionByName(kept)


def whole_and_cut(docs: DataFrame, markdown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc_id, line, text) of docs(doc_id, text): whole texts, whose first line is 1, and, of texts with a directive, the lines that are not turned off."""
    own = dealt(docs.select("doc_id", "text"))
    own = blank_markdown(own) if markdown else own
    has = _has_directive()
    return own.where(~has).select("doc_id", F.lit(1).alias("line"), "text"), active_lines(lines(own.where(has))).select("doc_id", "line", F.col("value").alias("text"))


def numbered_texts(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """Both tables of `whole_and_cut` as one."""
    whole, cut = whole_and_cut(docs, markdown)
    return whole.unionByName(cut)


def distinct_tokens(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """(token, n): the tokens of docs(doc_id, text), those of `tokens`, once each, and in how many texts they are. They are made distinct where the texts are read."""
    return counting.counted(document_texts(docs, markdown), counting.tokens).withColumnRenamed("word", "token")
