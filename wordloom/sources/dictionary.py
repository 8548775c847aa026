"""Dictionaries of stems and affix rules (.dic and .aff text files) as word tables.

Stems meet the rules of their flags in an equi-join; a rule's condition and what
it strips and adds are column expressions. A rule that continues with further
flags hands its words to their rules, level by level, until no rule continues. A
prefix and a suffix that may be combined meet in a further join, and continue
likewise. Rules are read on the driver, as a rule file is some thousand lines;
stems are not. Words made of several by compound rules are not listed: they are
told by `operators.compounds`, to which `components` gives the stems.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.compounds import Compounds
from wordloom.sources.wordlists import read_lines
from wordloom.storage import settle

_RULE = "flag string, suffix boolean, combines boolean, strip string, add string, condition string, continues array<string>"


@dataclass
class Affixes:
    """The rules of an affix file.

    rules: (flag, suffix or prefix, combines, strip, add, condition, flags that go on from there); special: the flags
    with a meaning of their own, by name; compounds: rules of flags with their quantifiers; compound_least: the fewest
    characters of a compound, without which there are none.
    """

    flags: str = "char"
    rules: list[tuple[str, bool, bool, str, str, str, list[str]]] = field(default_factory=list)
    special: dict[str, str] = field(default_factory=dict)
    compounds: list[list[tuple[str, str]]] = field(default_factory=list)
    compound_least: int | None = None

    def depth(self) -> int:
        """The most rules in a chain of continuations. Rules that come back to themselves would give words without end, and are an error."""
        after: dict[str, set[str]] = {}
        for flag, *_, continues in self.rules:
            after.setdefault(flag, set()).update(continues)
        on_way: set[str] = set()

        @cache
        def longest(flag: str) -> int:
            if flag in on_way:
                raise ValueError(f"affix rules go on without end from flag {flag}")
            on_way.add(flag)
            try:
                return 1 + max((longest(f) for f in after[flag] if f in after), default=0)
            finally:
                on_way.discard(flag)

        return max(map(longest, after), default=0)


def _split_flags(value: str, kind: str) -> list[str]:
    if kind == "num":
        return value.split(",")
    return re.findall(".." if kind == "long" else ".", value)


def _compound_rule(value: str, kind: str) -> list[tuple[str, str]]:
    return re.findall(r"([^()*?])([*?]?)" if kind == "char" else r"\(([^)]*)\)([*?]?)", value)


def affixes(lines: Iterable[str]) -> Affixes:
    """The rules of an affix file."""
    out = Affixes()
    combines: dict[tuple[str, str], bool] = {}
    counted = False
    for line in lines:
        part = line.split("#")[0].split()
        if len(part) < 2:
            continue
        kind = part[0]
        if kind == "FLAG":
            out.flags = {"long": "long", "num": "num"}.get(part[1], "char")
        elif kind in ("KEEPCASE", "NEEDAFFIX", "ONLYINCOMPOUND", "NOSUGGEST", "FORBIDDENWORD"):
            out.special[kind] = part[1]
        elif kind == "COMPOUNDMIN":
            out.compound_least = int(part[1])
        elif kind == "COMPOUNDRULE":
            if counted:  # the first such line has their number
                out.compounds.append(_compound_rule(part[1], out.flags))
            counted = True
        elif kind in ("PFX", "SFX"):
            if (kind, part[1]) not in combines:  # the header: flag, whether it combines, number of rules
                combines[kind, part[1]] = len(part) > 2 and part[2] == "Y"
            elif len(part) >= 4:
                strip, (add, _, continues) = part[2].split("/")[0], part[3].partition("/")
                strip, add = ("" if x == "0" else x for x in (strip, add))
                condition = part[4] if len(part) > 4 and part[4] != "." else ""
                out.rules.append((part[1], kind == "SFX", combines[kind, part[1]], strip, add, condition, _split_flags(continues, out.flags) if continues else []))
    return out


def _flags(value: Column, kind: str) -> Column:
    if kind == "num":
        return F.split(value, ",")
    return F.regexp_extract_all(value, F.lit(".." if kind == "long" else "(?s)."), F.lit(0))


def stems(lines: DataFrame, flags: str = "char") -> DataFrame:
    """(word, flags) of lines(value) of a dictionary file: a count alone on a line is none, what follows white space is left out."""
    entry = F.regexp_extract("value", rf"^{T.SPACE}*([^{T.SPACES}]+)", 1)
    kept = lines.select(entry.alias("entry")).where("entry <> '' and not entry rlike '^[0-9]+$'")
    at = F.instr("entry", "/")
    word = F.when(at > 1, F.expr("substring(entry, 1, instr(entry, '/') - 1)")).otherwise(F.col("entry"))
    marks = F.when(at > 1, _flags(F.expr("substring(entry, instr(entry, '/') + 1)"), flags)).otherwise(F.array().cast("array<string>"))
    return kept.select(word.alias("word"), marks.alias("flags"))


def _applied(word: Column, suffix: bool) -> tuple[Column, Column]:
    """Whether the joined rule's condition holds for a word, and the word with the affix."""
    strip, size = F.col("strip"), F.length("strip")
    pattern = F.concat(F.col("condition"), F.lit(r"\z")) if suffix else F.concat(F.lit(r"\A"), F.col("condition"))
    rest = word.substr(F.lit(1), F.length(word) - size) if suffix else word.substr(size + 1, F.length(word))
    ends = word.endswith(strip) if suffix else word.startswith(strip)
    made = F.concat(rest, "add") if suffix else F.concat(F.col("add"), rest)
    return (F.length(word) > size) & ends & ((F.col("condition") == "") | F.regexp(word, pattern)), made


def _grown(words: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """Words that rules make of words(word, keep_case, flags, flag), by each one's flag and then by what continues, with the first rule's `suffix` and `combines`."""
    level, out = words.withColumns({"first_suffix": F.lit(None).cast("boolean"), "first_combines": F.lit(None).cast("boolean")}), None
    for _ in range(depth):
        joined = level.join(F.broadcast(rules), "flag")  # a rule file's lines
        (tail, ended), (front, begun) = _applied(F.col("word"), True), _applied(F.col("word"), False)
        made = joined.where(F.when(F.col("suffix"), tail).otherwise(front)).select(
            F.when(F.col("suffix"), ended).otherwise(begun).alias("word"), "keep_case", "flags", "continues",
            F.coalesce("first_suffix", "suffix").alias("first_suffix"), F.coalesce("first_combines", "combines").alias("first_combines"),
        )
        out = made if out is None else out.union(made)
        level = made.select("word", "keep_case", "flags", "first_suffix", "first_combines", F.explode("continues").alias("flag")).distinct()
    return out.select("word", "keep_case", "flags", F.col("first_suffix").alias("suffix"), F.col("first_combines").alias("combines"))


def dictionary(lines: DataFrame, rules: Affixes) -> DataFrame:
    """(word, keep_case): all words that the stems and their affixes give, chains of affixes included.

    A suffix and a prefix of one stem that both combine are both put on, with all that the rules of either go on to.
    """
    spark = lines.sparkSession
    own = settle(stems(lines, rules.flags))  # parsed once, however many rules ask for its flags
    has = lambda name: F.array_contains("flags", rules.special[name]) if name in rules.special else F.lit(False)
    own = own.where(~has("FORBIDDENWORD") & ~has("ONLYINCOMPOUND")).withColumn("keep_case", has("KEEPCASE")).withColumn("bare", ~has("NEEDAFFIX"))
    out, depth = own.where("bare").select("word", "keep_case"), rules.depth()
    if depth:
        table = spark.createDataFrame(rules.rules, _RULE)
        once = _grown(own.select("word", "keep_case", "flags", F.explode("flags").alias("flag")), table, depth)
        # a stem's prefixes go before what its suffixes gave; the flags of such a row are the combining prefixes only
        prefixes = sorted({flag for flag, suffix, combines, *_ in rules.rules if combines and not suffix})
        suffixed = once.where("suffix and combines").select("word", "keep_case", "flags", F.explode("flags").alias("flag")).where(F.col("flag").isin(prefixes))
        out = out.union(once.select("word", "keep_case")).union(_grown(suffixed, table, depth).select("word", "keep_case"))
    return out.groupBy("word").agg(F.bool_and("keep_case").alias("keep_case"))


def components(lines: DataFrame, rules: Affixes) -> Compounds | None:
    """The compounds of a dictionary: its stems under the flags of the compound rules. None if it has none."""
    if rules.compound_least is None or not rules.compounds:
        return None
    named = sorted({flag for rule in rules.compounds for flag, _ in rule})
    words = stems(lines, rules.flags).select(F.lower("word").alias("word"), F.explode("flags").alias("flag")).where(F.col("flag").isin(named)).distinct()
    return Compounds(words, rules.compounds, rules.compound_least)


def read_dictionary(spark: SparkSession, dic: str, aff: str | None = None) -> DataFrame:
    """(word, keep_case) of a dictionary file and its affix file."""
    rules = Affixes() if aff is None else affixes(r["value"] for r in read_lines(spark, aff).collect())
    return dictionary(read_lines(spark, dic), rules)


def case_forms(word: Column) -> Column:
    """The forms under which a word may stand in a dictionary: as it is; in capitals also capitalised or in small letters; capitalised also with a small first letter."""
    first, rest = F.substring(word, 1, 1), F.expr("substring(word, 2)")
    capitals = (word == F.upper(word)) & (word != F.lower(word))
    entry = lambda form, changed: F.struct(form.alias("form"), F.lit(changed).alias("changed"))
    return F.array(
        entry(word, False),
        entry(F.when(capitals, F.concat(first, F.lower(rest))), True),
        entry(F.when(capitals, F.lower(word)), True),
        entry(F.when(first != F.lower(first), F.concat(F.lower(first), rest)), True),
    )


def accepted(words: DataFrame, known: DataFrame, compounds: Compounds | None = None) -> DataFrame:
    """(word, valid) for words(word), by known(word, keep_case) and case; a form that is not known may be a compound.

    A word that keeps its case is not accepted in capitals or capitalised.
    """
    each = words.select("word").distinct().select("word", F.explode(case_forms(F.col("word"))).alias("f")).select("word", "f.*").where("form is not null")
    looked = each.join(known.select(F.col("word").alias("form"), "keep_case"), "form", "left")
    fits = F.col("keep_case").isNotNull() & ~(F.col("changed") & F.col("keep_case"))
    if compounds is not None:
        unknown = looked.where("keep_case is null").select(F.lower("form").alias("word")).distinct()
        whole = compounds.among(unknown).select(F.col("word").alias("small"), F.lit(True).alias("compound"))
        looked = looked.withColumn("small", F.lower("form")).join(whole, "small", "left")
        fits = fits | (F.col("keep_case").isNull() & F.col("compound").isNotNull())
    return looked.groupBy("word").agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("valid"))
