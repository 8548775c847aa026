"""Dictionaries: chains of affixes, compounds, and validity by case in the check."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wordloom import fixtures
from wordloom.operators import check as C
from wordloom.operators import preprocess
from wordloom.operators.compounds import Compounds, automaton
from wordloom.plans.check import Options, check
from wordloom.sources import dictionary as D


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "word string")


CHAIN = """
SFX A Y 1
SFX A 0 s/BC .
SFX B Y 1
SFX B s z/D s
SFX C N 1
SFX C 0 y .
SFX D N 1
SFX D 0 q .
PFX P Y 1
PFX P 0 un/R .
PFX R N 1
PFX R 0 re .
""".splitlines()


def test_chains_of_affixes(spark):
    made = {r["word"] for r in D.dictionary(lines(spark, "do/AP", "go/A"), D.affixes(CHAIN)).collect()}
    suffixed = {"", "s", "z", "zq", "sy"}
    assert made == {f"{p}do{s}" for p in ("", "un", "reun") for s in suffixed} | {f"go{s}" for s in suffixed}
    assert D.affixes(CHAIN).depth() == 3


def test_chains_by_long_and_numbered_flags(spark):
    long = D.affixes("FLAG long\nSFX Aa Y 1\nSFX Aa 0 s/BbCc .\nSFX Bb N 1\nSFX Bb 0 t .\nSFX Cc N 1\nSFX Cc 0 u .".splitlines())
    assert {r["word"] for r in D.dictionary(lines(spark, "x/Aa"), long).collect()} == {"x", "xs", "xst", "xsu"}
    numbered = D.affixes("FLAG num\nSFX 1 Y 1\nSFX 1 0 s/22,3 .\nSFX 22 N 1\nSFX 22 0 t .\nSFX 3 N 1\nSFX 3 0 u .\nCOMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE (1)*(22)?".splitlines())
    assert {r["word"] for r in D.dictionary(lines(spark, "x/1"), numbered).collect()} == {"x", "xs", "xst", "xsu"}
    assert numbered.compounds == [[("1", "*"), ("22", "?")]]


def test_rules_without_end():
    rules = D.affixes("SFX A Y 1\nSFX A 0 s/B .\nSFX B Y 1\nSFX B 0 t/A .".splitlines())
    with pytest.raises(ValueError, match="without end"):
        rules.depth()


def test_no_rules(spark):
    assert {r["word"] for r in D.dictionary(lines(spark, "a/XY", "", "12", "b"), D.Affixes()).collect()} == {"a", "b"}
    assert D.dictionary(lines(spark), D.affixes(CHAIN)).collect() == []
    assert D.components(lines(spark, "a/X"), D.Affixes()) is None


PARTS = [("a", "X"), ("ab", "X"), ("b", "Y"), ("ba", "Y"), ("ab", "Z"), ("c", "Z"), ("bc", "Z"), ("aa", "Y")]


def plain(word, rules, parts=PARTS):
    """Whether a word is a compound, by trying every way to cut it."""
    patterns = [re.compile("".join(f"(?:{f}){q}" for f, q in rule)) for rule in rules]

    def ways(rest):
        if not rest:
            yield ""
        for part, flag in parts:
            if rest.startswith(part):
                yield from (flag + more for more in ways(rest[len(part) :]))

    return any(p.fullmatch(flags) for flags in ways(word) for p in patterns)


def test_automaton():
    starts, moves, finals = automaton([[("n", "*"), ("1", ""), ("t", "?")]])
    assert starts == [0]
    assert set(moves) == {(0, "n", 1), (1, "n", 1), (0, "1", 2), (1, "1", 2), (2, "t", 3)}
    assert finals == [2, 3]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("XYZ"), st.sampled_from(["", "*", "?"])), min_size=1, max_size=4), min_size=1, max_size=3), st.lists(st.text("abc", min_size=1, max_size=7), min_size=30, max_size=60))
def test_compounds(spark, rules, tried):
    parts = spark.createDataFrame(PARTS, "word string, flag string")
    got = {r["word"] for r in Compounds(parts, rules).among(words(spark, *tried)).collect()}
    assert got == {w for w in tried if plain(w, rules)}


def test_very_long_compound(spark):
    parts = spark.createDataFrame([("a", "X"), ("aa", "X"), ("b", "Y")], "word string, flag string")
    rules = [[("X", "*"), ("Y", "")]]
    long = "a" * 3000
    got = {r["word"] for r in Compounds(parts, rules, 4).among(words(spark, long + "b", long, long + "bb", "ab", "aab", "aaab")).collect()}
    assert got == {long + "b", "aaab"}


def test_numerals_as_compounds(spark):
    """The usual rule for ordinal numbers, whose last part stands in compounds only."""
    rules = D.affixes("COMPOUNDMIN 1\nONLYINCOMPOUND c\nCOMPOUNDRULE 2\nCOMPOUNDRULE n*1t\nCOMPOUNDRULE n*mp".splitlines())
    dic = lines(spark, *(f"{i}/{'nm1' if i == 1 else 'nm'}" for i in range(10)), "0th/pt", "1st/p", "1th/tc", "2nd/p", "2th/tc", "3rd/p", *(f"{i}th/pt" for i in range(4, 10)))
    made, compounds = D.dictionary(dic, rules), D.components(dic, rules)
    tried = words(spark, "11th", "21st", "21th", "12th", "112th", "22nd", "31ST", "1th", "3rd")
    assert {r["word"] for r in D.accepted(tried, made, compounds).where("valid").collect()} == {"11th", "21st", "12th", "112th", "22nd", "31ST", "3rd"}


def flagged(spark, text, dic, aff="", **options):
    rules = D.affixes(aff.splitlines())
    entries = lines(spark, *dic)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = check(docs, Options(D.dictionary(entries, rules), by_case=True, compounds=D.components(entries, rules), **options))
    return {r["word"]: list(r["suggestions"]) for r in found.misspelt.collect()}


def test_check_by_case(spark):
    dic = ["paris", "Berlin", "iPad/K", "NASA", "road", "map"]
    text = "Paris paris PARIS berlin Berlin BERLIN ipad IPAD iPad nasa NASA Nasa Road ROAD rOad"
    # rOad is cut where its case changes, as an identifier is
    assert set(flagged(spark, text, dic, "KEEPCASE K")) == {"berlin", "ipad", "IPAD", "nasa", "Nasa", "r", "Oad"}


def test_check_by_case_with_extra_words_and_segments(spark):
    dic = ["Berlin", "town"]
    # extra and ignored words are good in any case; segments are asked in small letters, so that a name in one fails
    assert set(flagged(spark, "berlin BERLIN Town.berlin Town.town", dic, extra=words(spark, "berlin"))) == set()
    assert set(flagged(spark, "Town.town", dic)) == set()
    assert "Berlin" not in flagged(spark, "Berlin.town", dic)


def test_check_accepts_compounds(spark):
    dic, aff = ["rail/X", "road/Y", "way/Y"], "COMPOUNDMIN 3\nCOMPOUNDRULE 1\nCOMPOUNDRULE XY"
    assert set(flagged(spark, "railroad Railway RAILROAD roadrail railroadway", dic, aff)) == {"roadrail", "railroadway"}


def test_suggestions_by_case(spark):
    """A name in small letters is no word, so it is not suggested."""
    assert flagged(spark, "tonw berlni", ["Berlin", "town"])["tonw"] == ["town"]
    assert flagged(spark, "tonw berlni", ["Berlin", "town"])["berlni"] == []


def test_default_stays_blind_to_case(spark):
    docs = spark.createDataFrame([(1, "bErLiN berlin")], "doc_id long, text string")
    tokens = preprocess.tokens(docs)
    assert C.invalid_parts(tokens.select("token").distinct(), C.valid_words(words(spark, "Berlin"))).collect() == []


def test_rules_of_the_fixtures():
    assert D.affixes(fixtures.AFFIXES).depth() == 3
