"""Reports: text lines, JSON, and a prioritised task list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMAND = "wordloom"
CLEAN = "No errors, everything is good"


def command(consistency: bool = False, markdown: bool = False, corrections: str | None = None) -> str:
    """The command that repeats a check's options."""
    return " ".join([COMMAND, *["--consistency"] * consistency, *["--markdown"] * markdown, *(["--corrections", corrections] if corrections else [])])


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")


def _quoted(forms: Column) -> Column:
    return F.array_join(F.transform(forms, lambda f: F.concat(F.lit("'"), f["form"], F.lit("'"))), " vs ")


def text_report(misspelt: DataFrame, found: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, place, report_line) of (doc_id, word, lines, first, suggestions) and findings; a line for each clean document of docs, if given."""
    label = F.col("doc_id").cast("string")
    hints = F.when(F.size("suggestions") > 0, F.concat(F.lit(" Suggestions: "), F.array_join("suggestions", ", "))).otherwise("")
    first = Window.partitionBy("doc_id").orderBy("first")
    words = misspelt.select("doc_id", F.lit(0).alias("section"), F.row_number().over(first).alias("place"), F.concat(label, F.lit(": '"), "word", F.lit("' misspelled on line(s): "), _joined(F.col("lines")), F.lit("."), hints).alias("report_line"))
    terms = found.select("doc_id", F.lit(1).alias("section"), "place", F.concat(label, F.lit(": terminology: "), _quoted(F.col("forms")), F.lit(" — prefer '"), "recommendation", F.lit("' (line(s): "), _joined(F.col("lines")), F.lit(")")).alias("report_line"))
    both = words.unionByName(terms)
    if docs is None:
        return both
    issues = misspelt.select("doc_id").union(found.select("doc_id")).distinct()
    clean = docs.select("doc_id").join(issues, "doc_id", "left_anti")
    return both.unionByName(clean.select("doc_id", F.lit(2).alias("section"), F.lit(1).alias("place"), F.lit(CLEAN).alias("report_line")))


def json_report(docs: DataFrame, misspelt: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON object per document, also of those without any issue."""
    word = F.struct("first", F.struct("word", "lines", "suggestions", F.col("top_distance").alias("topDistance")).alias("entry"))
    words = misspelt.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["entry"]).alias("misspellings"))
    terms = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("kind", "recommendation", "forms", "lines").alias("entry")))), lambda x: x["entry"]).alias("consistency"))
    joined = docs.select("doc_id").join(words, "doc_id", "left").join(terms, "doc_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType))
    body = F.struct(F.col("doc_id").cast("string").alias("file"), F.size(empty("misspellings")).alias("count"), empty("misspellings").alias("misspellings"), empty("consistency").alias("consistency"))
    return joined.select("doc_id", F.to_json(body).alias("report"))


def tasks(misspelt: DataFrame, found: DataFrame, command: str = COMMAND) -> DataFrame:
    """(doc_id, n, confidence, line, text): 0 high, 1 medium, 2 review.

    Words without suggestions or on several lines are for review, as are all
    terminology findings; a nearest suggestion at distance 1 is high confidence.
    """
    each = misspelt.select("doc_id", "word", "first", "suggestions", "top_distance", F.size("lines").alias("times"), F.explode("lines").alias("line"))
    same = Window.partitionBy("doc_id", F.lower("word"), "line").orderBy("first")
    each = each.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    none, repeated = F.size("suggestions") == 0, F.col("times") >= 2
    confidence = F.when(none | repeated, 2).when(F.col("top_distance") == 1, 0).otherwise(1)
    head, bless = F.concat(F.lit(" line "), F.col("line").cast("string"), F.lit(": ")), F.concat(F.lit(f"{command} --add-word "), "word")
    word, top = F.concat(F.lit("'"), "word", F.lit("'")), F.concat(F.lit("'"), F.element_at("suggestions", 1), F.lit("'"))
    others = F.when(F.size("suggestions") > 1, F.concat(F.lit(" (alternatives: "), F.array_join(F.slice("suggestions", F.lit(2), F.greatest(F.size("suggestions"), F.lit(1))), ", "), F.lit(")"))).otherwise("")
    text = (
        F.when(none, F.concat(F.lit("[review]"), head, word, F.lit(" has no suggestion — rewrite or bless: "), bless))
        .when(repeated, F.concat(F.lit("[review]"), head, word, F.lit(" appears on "), F.col("times").cast("string"), F.lit(" lines — if intentional, bless: "), bless, F.lit("; suggested fix: "), top))
        .otherwise(F.concat(F.lit("[fix:"), F.when(F.col("top_distance") == 1, "high").otherwise("medium"), F.lit("]"), head, F.lit("replace "), word, F.lit(" with "), top, others))
    )
    words = each.select("doc_id", confidence.alias("confidence"), "line", text.alias("text"), F.lit(0).alias("source"), F.col("first.line").alias("k1"), F.col("first.pos").alias("k2"), F.col("first.part_pos").alias("k3"))
    line = F.array_min("lines")
    should = F.concat(F.lit("'"), F.element_at("forms", 1)["form"], F.lit("' should be '"), "recommendation", F.lit("'"))
    prefer = F.concat(_quoted(F.col("forms")), F.lit(" — prefer '"), "recommendation", F.lit("'"))
    terms = found.select("doc_id", F.lit(2).alias("confidence"), line.alias("line"), F.concat(F.lit("[review] consistency line "), line.cast("string"), F.lit(": "), F.when(F.col("kind") == "casing", should).otherwise(prefer)).alias("text"), F.lit(1).alias("source"), F.col("place").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"))
    order = Window.partitionBy("doc_id").orderBy("confidence", "line", "source", "k1", "k2", "k3")
    return words.unionByName(terms).select("doc_id", F.row_number().over(order).alias("n"), "confidence", "line", "text")


def task_lists(docs: DataFrame, listed: DataFrame, command: str = COMMAND) -> DataFrame:
    """(doc_id, text): each document's tasks under a header, also where there are none."""
    line = F.concat(F.col("n").cast("string"), F.lit(". "), "text")
    each = listed.groupBy("doc_id").agg(F.count("*").alias("issues"), F.count_if(F.col("confidence") != 2).alias("fixable"), F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    label, number = F.col("doc_id").cast("string"), lambda c: c.cast("string")
    counts = F.concat(F.lit("# issues: "), number(F.col("issues")), F.lit(" ("), number(F.col("fixable")), F.lit(" fixable, "), number(F.col("issues") - F.col("fixable")), F.lit(" review)"))
    head = [F.lit("# SPELLCHECK TASK LIST"), F.concat(F.lit("# file: "), label)]
    full = F.array_join(F.concat(F.array(*head, counts, F.concat(F.lit(f"# self-service: {command} --fix "), label)), "lines"), "\n")
    none = F.array_join(F.array(*head, F.lit("# NO ISSUES")), "\n")
    return docs.select("doc_id").join(each, "doc_id", "left").select("doc_id", F.when(F.col("issues").isNull(), none).otherwise(full).alias("text"))


def exit_status(misspelt: DataFrame, found: DataFrame) -> int:
    """0 if nothing is wrong, else 1."""
    return 0 if misspelt.isEmpty() and found.isEmpty() else 1


def harvest_report(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(line): one line on a project's vocabulary."""
    text = lambda c: F.col(c).cast("string")
    number = words.count()
    return stats.select(F.concat(F.lit(f"repo vocab: +{number} words ("), text("manifest_words"), F.lit(" manifest, "), text("counted_words"), F.lit(" from code) from "), text("files_scanned"), F.lit(" files")).alias("line"))


def issue_counts(misspelt: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, words, findings, issues) of documents with any issue; a document is clean if it has no row."""
    both = misspelt.select("doc_id", F.lit(1).alias("w"), F.lit(0).alias("f")).union(found.select("doc_id", F.lit(0), F.lit(1)))
    return both.groupBy("doc_id").agg(F.sum("w").alias("words"), F.sum("f").alias("findings"), F.count("*").alias("issues"))
