"""Blanking of the parts of Markdown that are not prose; the number of lines and their columns stay.

Only few lines can open or close a block: those are a document's events, each a
map from the state before it to the state after it. A scan over the events gives
every event's state: it folds groups of GROUP events to learn the state at the
start of each group, then goes through each group from there, so that its work
grows with the number of events, however many they are. Lines between events
have the state of the event before. All of it is column expressions.

States are whole numbers: text, a comment, front matter, or a fence by its
character and the length of its mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions.text import SPACE, SPACES

TEXT, COMMENT, MATTER, FENCE = 0, 1, 2, 4
#: Events that are gone through from one known state.
GROUP = 256

#: What is blanked within a line, and what a line without it lacks, as a plain search tells much faster.
_BLANKS = {"<!--.*?-->": "-->", "`[^`]*`": "`"}
_MARKS = ("```", "~~~", "<!--", "-->", "---")


def strip_inline(line: Column) -> Column:
    """Comments and code spans within a line give way to a space."""
    for pattern in _BLANKS:
        line = F.regexp_replace(line, pattern, " ")
    return line


def blank_inline(line: Column) -> Column:
    """Comments and code spans within a line give way to as many spaces, so that columns stay."""
    for pattern, sign in _BLANKS.items():
        spaces = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
        filled = F.zip_with(F.split(line, pattern, -1), spaces, lambda piece, gap: F.concat(piece, F.coalesce(gap, F.lit(""))))
        line = F.when(line.contains(sign), F.array_join(filled, "")).otherwise(line)
    return line


def _event(line: Column, number: Column) -> Column:
    """What a line can do to a state, or null if nothing: the fence that it marks, as a state, and whether it opens or closes others."""
    mark = F.regexp_extract(line, rf"^{SPACE}*(`{{3,}}|~{{3,}})", 1)
    fence = F.when(mark == "", TEXT).otherwise(FENCE + 2 * F.length(mark) + mark.startswith("~").cast("int"))
    closes = line.contains("-->")
    rule = line.startswith("---")
    event = F.struct(
        number.alias("line"), fence.alias("fence"), closes.alias("closes"),
        (~closes & line.rlike(rf"^{SPACE}*<!--")).alias("opens"),
        (rule & line.rlike(rf"^---{SPACE}*\z")).alias("ends"),
        ((number == 0) & (T.trim(line) == "---")).alias("begins"),
    )
    return F.when(reduce(Column.__or__, [line.contains(m) for m in _MARKS]), event)


def _after(state: Column, event: Column) -> Column:
    """The state after an event."""
    fence = event["fence"]
    same_kind = (fence > TEXT) & (F.pmod(fence, F.lit(2)) == F.pmod(state, F.lit(2))) & (fence >= state)
    opened = F.when(event["begins"], MATTER).when(fence > TEXT, fence).when(event["opens"], COMMENT).otherwise(TEXT)
    return (
        F.when(state == TEXT, opened)
        .when(state == COMMENT, F.when(event["closes"], TEXT).otherwise(COMMENT))
        .when(state == MATTER, F.when(event["ends"], TEXT).otherwise(MATTER))
        .otherwise(F.when(same_kind, TEXT).otherwise(state))
    )


def _through(events: Column, start: Column) -> Column:
    """The state after some events."""
    return F.aggregate(events, start.cast("int"), lambda state, e: _after(state, e).cast("int"))


def _states(group: Column, start: Column) -> Column:
    """The states after each event of a group."""
    return F.aggregate(group, F.array().cast("array<int>"), lambda found, e: F.concat(found, F.array(_after(F.coalesce(F.try_element_at(found, F.lit(-1)), start), e).cast("int"))))


def _with_hidden(docs: DataFrame) -> DataFrame:
    """docs with __hidden: for each of __lines whether it is blanked, by the __events among them, in order; null where there are none.

    No function of an array's elements asks for another array, which would be made anew for each of them.
    """
    some = F.size("__events") > 0
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("__events") - 1) / GROUP).cast("int")), lambda g: F.slice("__events", g * GROUP + 1, F.lit(GROUP)))
    docs = docs.withColumn("__groups", F.when(some, groups))
    # the state before each group, and after the last one
    starts = F.aggregate("__groups", F.array(F.lit(TEXT)), lambda found, g: F.concat(found, F.array(_through(g, F.element_at(found, -1)))))
    docs = docs.withColumn("__starts", F.when(some, starts))
    docs = docs.withColumn("__after", F.when(some, F.flatten(F.zip_with("__groups", F.slice("__starts", F.lit(1), F.size("__groups")), _states))))
    line = F.transform("__events", lambda e: e["line"])
    following = F.concat(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), F.array(F.size("__lines")))
    steps = F.arrays_zip(line.alias("line"), F.concat(F.array(F.lit(TEXT)), "__after").alias("before"), F.col("__after").alias("after"), following.alias("following"))
    docs = docs.withColumn("__steps", F.when(some, F.slice(steps, F.lit(1), F.size("__events"))))
    # from each event to the line before the next
    stretch = F.transform("__steps", lambda s: F.concat(F.array((s["before"] != TEXT) | (s["after"] != TEXT)), F.array_repeat(s["after"] != TEXT, s["following"] - s["line"] - 1)))
    return docs.withColumn("__hidden", F.when(some, F.concat(F.array_repeat(F.lit(False), F.element_at("__steps", 1)["line"]), F.flatten(stretch))))


def blank_markdown(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the column's text blanked: front matter, fences and comments as empty lines, inline comments and code as spaces.

    A null text stays null. Texts without any mark skip the scan, and those without an inline one skip that.
    """
    own = docs.columns
    text = F.col(f"`{column}`")
    block = reduce(Column.__or__, [text.contains(m) for m in ("```", "~~~", "<!--")]) | text.rlike(rf"\A[{SPACES}]*---")
    found = docs.withColumn("__lines", F.when(block, F.split(text, "\n", -1)))
    found = found.withColumn("__events", F.filter(F.transform("__lines", _event), lambda e: e.isNotNull()))
    found = _with_hidden(found)
    kept = F.zip_with("__lines", "__hidden", lambda v, hidden: F.when(hidden, "").otherwise(blank_inline(v)))
    # a code span may run over line breaks, as a dot may not: go line by line
    plain = F.when(text.contains("`"), F.array_join(F.transform(F.split(text, "\n", -1), blank_inline), "\n")).otherwise(text)
    blanked = F.when(F.col("__hidden").isNull(), plain).otherwise(F.array_join(kept, "\n"))
    return found.withColumn(column, blanked).select(*(F.col(f"`{c}`") for c in own))
