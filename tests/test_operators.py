"""The operators on the small fixtures, with a lexicon of ordinary words."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.lists import BRANDS, COMMON_WORDS, TECH_WORDS
from wordloom.operators import check as C
from wordloom.operators import lint, preprocess, report, rewrite, vocab
from wordloom.operators import suggest as S
from wordloom.plans.check import Options, check
from wordloom.sources import files, wordlists

LEXICON = "everything is fine receive ok don't hello my getting get name the word cat world prose before after one two not a and here wrong node".split()


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def flagged(spark, text, **options):
    markdown = options.pop("markdown", False)
    found = C.occurrences(preprocess.tokens(docs(spark, text), markdown), C.valid_words(words(spark, *LEXICON), *(options.pop(k, None) for k in ("extra", "ignored"))), **options)
    return {r["word"]: list(r["lines"]) for r in C.misspellings(found).collect()}


def test_list_sizes():
    assert (len(set(COMMON_WORDS)), len(set(TECH_WORDS)), len(BRANDS)) == (160, 173, 80)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("everything is fine", {}),
        ("everything is gooattty", {"gooattty": [1]}),
        ("recieve\nok\nrecieve", {"recieve": [1, 3]}),
        ("teh teh\nrecieve", {"teh": [1], "recieve": [2]}),
        ("dont\ndon't", {"dont": [1]}),
        ("123 456 hello 789", {}),
        ("https://teh.x a@teh.b 0xfeed\n0123456789abcdef\nhello teh", {"teh": [3]}),
        ("getSubcribeName fine", {"Subcribe": [1]}),
        ("my_varible = 1", {"varible": [1]}),
        ("teh.js is wrong\nNode.js is fine", {"teh": [1]}),
        ("teh\nspellcheck:off\nteh\nspellcheck:on\nok\nteh spellcheck:disable-line\nspellcheck:disable-next-line\nteh\nteh", {"teh": [1, 9]}),
        ("spellcheck:disable-next-line\nspellcheck:off\nteh\nspellcheck:on\nteh\nteh", {"teh": [6]}),
        ("", {}),
        (None, {}),
    ],
)
def test_flagged(spark, text, expected):
    assert flagged(spark, text) == expected


def test_options(spark):
    assert flagged(spark, "xy hello teh", min_length=3) == {"teh": [1]}
    assert flagged(spark, "Teh wrod", extra=words(spark, "TEH"), ignored=words(spark, "wrod")) == {}
    assert flagged(spark, "prose teh\n```\nteh\n```\nteh", markdown=True) == {"teh": [1, 5]}
    assert flagged(spark, "<!-- spellcheck:off -->\nteh", markdown=True) == {"teh": [2]}


def test_suggestions(spark):
    vocabulary = words(spark, "the", "tea", "tee", "tel")
    best = lambda common: S.suggestions(words(spark, "teh", "t"), vocabulary, common).collect()
    assert [(r["query"], list(r["suggestions"])[0], r["top_distance"]) for r in best(words(spark, "the"))] == [("teh", "the", 1)]
    assert list(best(words(spark))[0]["suggestions"]) == ["tea", "tee", "tel"]
    assert S.suggestions(words(spark, "teh"), vocabulary, words(spark), words(spark)).count() == 0


def test_index_is_one_sided(spark):
    """A candidate two letters longer is out of reach; one that is shorter is found."""
    got = S.suggestions(words(spark, "abcd"), words(spark, "abcdef", "ab"), words(spark)).collect()
    assert [list(r["suggestions"]) for r in got] == [["ab"]]


def test_learned(spark):
    suggested = S.suggestions(words(spark, "wrod", "xyzzyq"), words(spark, "word", "rod"), words(spark))
    pairs = spark.createDataFrame([("wrod", "world"), ("xyzzyq", "XYZZYQ")], "typo string, fix string")
    got = {r["word"]: (list(r["suggestions"]), r["top_distance"]) for r in S.with_learned(words(spark, "wrod", "xyzzyq"), suggested, pairs).collect()}
    assert got == {"wrod": (["world", "word", "rod"], 1), "xyzzyq": ([], None)}


def test_casing(spark):
    texts = docs(spark, "We use Github and Javascript daily.", "GITHUB ACTIONS GUIDE\nuse GitHub", "GitHub's APIs and JSONs work.", "Githubs and Api docs.", "git-hub rest")
    got = {(r["doc_id"], r["form"], r["recommendation"]) for r in lint.casing_findings(preprocess.tokens(texts)).collect()}
    assert got == {(0, "Github", "GitHub"), (0, "Javascript", "JavaScript"), (3, "Github", "GitHub"), (3, "Api", "API"), (4, "github", "GitHub"), (4, "rest", "REST")}


def test_variants(spark):
    texts = docs(spark, "backend\nbackend\nback-end", "use x86_64 here\nand x86-64 there", "Web tools.\nthe web tools.", "its it's")
    got = {r["doc_id"]: (r["recommendation"], list(r["lines"])) for r in lint.findings(preprocess.tokens(texts)).where("kind = 'variants'").collect()}
    assert got == {0: ("backend", [1, 2, 3]), 1: ("x86_64", [1, 2]), 3: ("its", [1])}


def test_fix_and_learn(spark, tmp_path):
    own = docs(spark, "teh wrod\nTeh Cat", "clean")
    found = check(own, Options(words(spark, *LEXICON, "clean")))
    fixed = rewrite.fixes(own, found.occurrences, found.suggested)
    whole = rewrite.fixed_documents(own, fixed)
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {0: "the word\nThe Cat", 1: "clean"}
    rewrite.write_documents(whole, str(tmp_path / "fixed"))
    assert spark.read.parquet(str(tmp_path / "fixed")).count() == 2
    assert {tuple(r) for r in rewrite.learned_pairs(found.occurrences, found.suggested).collect()} == {("teh", "the"), ("wrod", "word")}


def test_tasks_and_reports(spark):
    own = docs(spark, "teh wrod\nxyzzyq", "recieve\nrecieve", "hello")
    found = check(own, Options(words(spark, *LEXICON)))
    rows = report.tasks(found.misspelt, found.findings).orderBy("doc_id", "n").collect()
    assert [(r["doc_id"], r["confidence"]) for r in rows] == [(0, 0), (0, 0), (0, 2), (1, 2), (1, 2)]
    assert rows[0]["text"].startswith("[fix:high] line 1: replace 'teh' with 'the'")
    lines = {r["report_line"] for r in report.text_report(found.misspelt, found.findings).where("doc_id = 1").collect()}
    assert lines == {"1: 'recieve' misspelled on line(s): 1, 2. Suggestions: receive"}
    bodies = {r["doc_id"]: r["report"] for r in report.json_report(own, found.misspelt, found.findings).collect()}
    assert bodies[2] == '{"file":"2","count":0,"misspellings":[],"consistency":[]}'
    assert '{"word":"xyzzyq","lines":[2],"suggestions":[]}' in bodies[0]
    assert {tuple(r) for r in report.issue_counts(found.misspelt, found.findings).collect()} == {(0, 3, 0, 3), (1, 1, 0, 1)}


def test_reports_of_clean_documents_and_whole_lists(spark):
    own = docs(spark, "teh wrod", "hello")
    found = check(own, Options(words(spark, *LEXICON)))
    assert {r["report_line"] for r in report.text_report(found.misspelt, found.findings, own).where("doc_id = 1").collect()} == {report.CLEAN}
    command = report.command(consistency=True, corrections="learned.txt")
    assert command == "wordloom --consistency --corrections learned.txt"
    lists = {r["doc_id"]: r["text"].split("\n") for r in report.task_lists(own, report.tasks(found.misspelt, found.findings, command), command).collect()}
    assert lists[1] == ["# SPELLCHECK TASK LIST", "# file: 1", "# NO ISSUES"]
    assert lists[0][2:4] == ["# issues: 2 (2 fixable, 0 review)", f"# self-service: {command} --fix 0"]
    assert lists[0][4].startswith("1. [fix:high] line 1: replace 'teh'")
    assert report.exit_status(found.misspelt, found.findings) == 1
    clean = check(docs(spark, "hello"), Options(words(spark, *LEXICON)))
    assert report.exit_status(clean.misspelt, clean.findings) == 0


AFF = """
SET UTF-8
KEEPCASE K
NEEDAFFIX N
PFX R Y 1
PFX R 0 re .
SFX D Y 3
SFX D 0 d e
SFX D y ied [^aeiou]y
SFX D 0 ed [^ey]
SFX S N 1
SFX S 0 s .
""".splitlines()
DIC = ["7", "make/RS", "create/RD", "try/DS", "play/D", "iPad/K", "part/N\tpo:x", "Paris"]


def test_dictionary(spark):
    from wordloom.sources import dictionary as D

    made = D.dictionary(spark.createDataFrame([(v,) for v in DIC], "value string"), D.affixes(AFF))
    got = {r["word"]: r["keep_case"] for r in made.collect()}
    assert set(got) == {"make", "makes", "remake", "create", "created", "recreate", "recreated", "try", "tried", "trys", "play", "iPad", "Paris"}
    assert [w for w, keep in got.items() if keep] == ["iPad"]
    tried = words(spark, "make", "Make", "MAKE", "mAKE", "paris", "PARIS", "Paris", "iPad", "IPAD", "IPad", "x", "")
    assert {r["word"] for r in D.accepted(tried, made).where("valid").collect()} == {"make", "Make", "MAKE", "PARIS", "Paris", "iPad"}


def test_dictionary_files(spark, tmp_path):
    from wordloom.sources import dictionary as D

    (tmp_path / "x.dic").write_text("2\ngo/1,23\nsee/23\n")
    (tmp_path / "x.aff").write_text("FLAG num\nSFX 23 Y 1\nSFX 23 0 n .\nPFX 1 N 1\nPFX 1 0 for/7 .\n")
    assert {r["word"] for r in D.read_dictionary(spark, str(tmp_path / "x.dic"), str(tmp_path / "x.aff")).collect()} == {"go", "gon", "forgo", "see", "seen"}
    assert {r["word"] for r in D.read_dictionary(spark, str(tmp_path / "x.dic")).collect()} == {"go", "see"}
    long = D.stems(spark.createDataFrame([("ab/XxYy",), ("/",)], "value string"), "long").collect()
    assert [(r["word"], list(r["flags"])) for r in long] == [("ab", ["Xx", "Yy"]), ("/", [])]


def test_noise_is_what_the_plain_pattern_finds(spark):
    """Guards and anchors change nothing: every line comes out as under the bare patterns, token by token."""
    import random

    rng = random.Random(9)
    pieces = ["a@b", "@", "@@x", "x@", "http://u/@", "https://", "www.a", "www.", "0x1F", "0X", "deadbeef1", "0xdeadbeef99@q", "\u00a0", "\u3000", " ", "\t", "é", "abc", "-", "cafe0000", "_deadbeef00"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    frame = spark.createDataFrame([(r,) for r in rows], "v string")
    ink = T.INK
    bare = F.regexp_replace(F.regexp_replace("v", rf"https?://{ink}+|www\.{ink}+|{ink}+@{ink}+|0[xX][0-9a-fA-F]+", " "), T.HEX_RUN, " ")
    split = F.filter(F.split("v", f"{T.SPACE}+"), lambda t: t != "")
    got = frame.select("v", T.strip_noise(F.col("v")).alias("a"), bare.alias("b"), T.tokens(F.col("v")).alias("c"), split.alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)


def test_harvest(spark, tmp_path):
    def put(path, content):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)

    put("package.json", '{"name": "kubernets-kit", "keywords": ["typo", 5], "dependencies": {"@scope/leftpad": "1"}}')
    put("src/index.ts", "kubernetsOne kubernetsTwo kubernets_x zorpish")
    put("node_modules/x/package.json", '{"name": "hidden"}')
    put("yarn.lock", "locked")
    put("_private.py", "privately privately privately")
    put("big.py", "huge " * 200_000)
    for i in range(3):
        put(f"lib/zorp-{i}.ts", "")
    found, stats = vocab.harvest(files.read_repository(spark, str(tmp_path)))
    got = {r["word"] for r in found.collect()}
    assert {"kubernets", "kit", "typo", "scope", "leftpad", "zorp", "privately"} <= got
    assert not {"zorpish", "hidden", "locked", "huge"} & got
    assert stats.first()["files_scanned"] == 7
    assert vocab.harvest(files.read_repository(spark, str(tmp_path)), max_files=3)[1].first()["files_scanned"] == 3
    line = report.harvest_report(found, stats).first()["line"]
    assert line.startswith(f"repo vocab: +{len(got)} words (") and line.endswith("from 7 files")
    from wordloom.plans.check import extra_words

    extra = {r["word"] for r in extra_words([words(spark, "Own")], files.read_repository(spark, str(tmp_path))).collect()}
    assert extra == got | {"Own"}


def test_wordlists(spark, tmp_path):
    (tmp_path / "words").write_text("# c\nalpha\n\nbeta # x\n  Gamma\t\n")
    assert [r["word"] for r in wordlists.wordlist(wordlists.read_lines(spark, str(tmp_path / "words"))).collect()] == ["alpha", "beta", "Gamma"]
    assert wordlists.append_words(words(spark, "ALPHA", "delta", "alpha"), words(spark, "Alpha"), str(tmp_path / "out")) == 1
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["delta"]
    assert [wordlists.add_word(spark, w, words(spark, "Alpha"), str(tmp_path / "own")) for w in ("alpha", "new")] == [0, 1]
    rows = spark.createDataFrame(list(enumerate(["teh=the", "Wrod = word # n", "broken", "=nofix", "nofix=", "teh=The", "a=b=c"])), "line_no int, value string")
    assert {tuple(r) for r in wordlists.corrections(rows).collect()} == {("teh", "The"), ("wrod", "word"), ("a", "b=c")}
    old = spark.createDataFrame([("teh", "the")], "typo string, fix string")
    new = spark.createDataFrame([("TEH", "the"), ("wrod", "word")], "typo string, fix string")
    assert wordlists.append_corrections(new, old, str(tmp_path / "pairs")) == 1


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\n\n")
    (tmp_path / "b.txt").write_text("y")
    got = {(r["path"].rsplit("/", 1)[1], r["text"], r["markdown"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "x\n\n", True), ("b.txt", "y", False)}
    assert files.text_document(spark, "z").first()["path"] == "<stdin>"
    with pytest.raises(FileNotFoundError):
        files.discover_wordlists(str(tmp_path), [str(tmp_path / "none")])


def test_stream(spark, tmp_path):
    from wordloom.streaming.check import check_stream

    docs(spark, "teh word", "fine").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = check_stream(stream, Options(words(spark, *LEXICON)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {(r["doc_id"], r["word"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, "teh")}


def test_plan_prunes_columns(spark, tmp_path):
    docs(spark, "teh").withColumn("wide", F.lit("x" * 100)).write.parquet(str(tmp_path / "d"))
    plan = preprocess.tokens(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan
    assert "Python" not in plan
