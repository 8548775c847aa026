"""Small inputs for what the tables lack; used by the registered queries and by tests."""

from __future__ import annotations

MARKDOWN = [
    (1, "---\ntitle: teh\n---\nprose teh\n```js\ncode teh\n```\nafter `inline teh` end"),
    (2, "~~~~\nteh\n~~~\nstill code\n~~~~ \ntext"),
    (3, "before\n<!-- open teh\nstill\nclose --> gone\nafter <!-- one --> two"),
    (4, "---\nnever closed\nteh"),
    (5, "  ```\ncode\n``````\nprose\n\n```\nopen to the end"),
    (6, "a <!-- x --> b <!-- y -->\n<!-- z --> tail\n`a` ``b`` ` c"),
    (7, "<!-- spellcheck:off -->\nteh"),
]

WORD_PAIRS = [("teh", "the"), ("wrod", "word"), ("cat", "cut"), ("abc", "abc"), ("abc", "xyz"), ("kitten", "sitting"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("a", "abcd")]

TERMS = [
    (-1, "We use Github and Javascript daily."),
    (-2, "GITHUB ACTIONS GUIDE\nuse GitHub"),
    (-3, "GitHub's APIs and JSONs work."),
    (-4, "Githubs and Api docs."),
    (-5, "backend here\nthe backend there\na back-end too"),
    (-6, "use x86_64 here\nand x86-64 there"),
    (-7, "Web tools.\nthe web tools."),
    (-8, "cooperate\nco-operate"),
    (-9, "its fine\nit's late\ngit-hub and _init or init"),
]

FILES = [
    ("app/package.json", '{"name": "kubernets-kit", "keywords": ["spellcheck", "typo"], "dependencies": {"@scope/leftpad": "1"}, "devDependencies": {"vitest": "2"}}'),
    ("bad/package.json", "{not json"),
    ("svc/go.mod", "module example.com/wrodcount\n\nrequire (\n\tgithub.com/acme/kubernetctl v1.0.0\n\t// note\n)\nrequire golang.org/x/tools v0.1.0\n"),
    ("crate/Cargo.toml", '[package]\nname = "zorpcrate"\n[dependencies]\nserde = "1"\n[target.dev-dependencies]\nquickcheck_macros = "1"\n[profile]\nlto = true\n'),
    ("py/pyproject.toml", '[project]\nname = "snakekit"\ndependencies = [\n  "requestz>=2.0",\n  "numpyish",\n]\n[tool.poetry.dependencies]\nflaskish = "^1"\n'),
    ("py/requirements.txt", "# comment\n-r other.txt\ndjangoo==4.2\n\nuvicornz[standard]>=0.1 ; python_version\n"),
    ("src/zorp-one.ts", "const zorpValue = getZorpValue(zorp_value);"),
    ("src/clock.py", "skipped because of its name"),
    ("src/_private.py", "kept_name = 1"),
]

WORDLIST = ["# words", "Alpha", "", "  beta  # greek", "blush", "#"]
CORRECTIONS = ["# learned", "teh=the", "Wrod = word # note", "broken", "=nofix", "nofix=", "teh=The", "japan=Japan"]
NEW_PAIRS = [("TEH", "The"), ("teh", "the"), ("wrod", "word"), ("WROD", "world")]

LEXICON = "the word cat receive was here and everything is fine world but not".split()
FIXABLE = [(1, "teh wrod"), (2, "Teh Cat"), (3, "TEH `teh` x-teh\nfine"), (4, "xyzzyq"), (5, "recieve\nok recieve")]

#: Rules that continue with others, up to three deep, and compounds.
AFFIXES = """
KEEPCASE K
NEEDAFFIX N
ONLYINCOMPOUND O
COMPOUNDMIN 4
COMPOUNDRULE 2
COMPOUNDRULE VW*T
COMPOUNDRULE OT?
PFX P Y 2
PFX P 0 re/Q .
PFX P 0 un [aeiou]
PFX Q N 1
PFX Q 0 pre .
SFX A Y 3
SFX A 0 s/C [^sy]
SFX A y ies/C [^aeiou]y
SFX A e ing/D e
SFX B Y 1
SFX B 0 er/A .
SFX C N 1
SFX C 0 like .
SFX D N 1
SFX D 0 ly .
""".strip().split("\n")
#: The flags of a stem: each if its number divides the stem's, or by the stem's length.
STEM_FLAGS = {"A": 2, "B": 3, "P": 5, "K": 7, "N": 11, "O": 13}
PART_FLAGS = {"V": (1, 3), "W": (4, 4), "T": (3, 6)}
#: Stems whose number leaves 1 after division by this are names.
NAMES = 6
