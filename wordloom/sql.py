"""The registered queries in SQL, for comparison with another engine."""

from __future__ import annotations

from wordloom import fixtures
from wordloom.lists import BRANDS, COMMON_WORDS, MANIFESTS, SKIP_DIRS, SOURCE_EXTENSIONS, TECH_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows) + ")"


def _words(words: list[str]) -> str:
    return _values([(w,) for w in sorted(set(words))]) + " AS w(word)"


SP = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INK = SP.replace("[", "[^", 1)
NOISE = rf"https?://{INK}+|www\.{INK}+|{INK}+@{INK}+|0[xX][0-9a-fA-F]+"
HEX = r"\b[0-9a-fA-F]{8,}\b"


def _strip(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '{NOISE}', ' ', 'g'), '{HEX}', ' ', 'g')"


def _tokens(value: str) -> str:
    return f"list_filter(regexp_split_to_array({value}, '{SP}+'), lambda t: t <> '')"


def _lines(source: str) -> str:
    return f"(SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM {source}))"


def _tok(source: str) -> str:
    """(doc_id, line, pos, token)"""
    return f"(SELECT doc_id, line, unnest(range(0, len(a))) AS pos, unnest(a) AS token FROM (SELECT doc_id, line, {_tokens(_strip('value'))} AS a FROM {_lines(source)}))"


def _trim(value: str) -> str:
    return rf"regexp_replace({value}, '^{SP}+|{SP}+$', '', 'g')"


CLEAN = "regexp_replace({}, '[^A-Za-z0-9_'']', '', 'g')"
SUGGESTABLE = "regexp_matches(word, '^[a-z][a-z'']+$')"
PARTS = r"list_filter(flatten(list_transform(regexp_split_to_array({}, '[_\-/.]+'), lambda p: string_split(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '))), lambda p: p <> '')"

TOK = f"tok AS MATERIALIZED {_tok('documents')}"
LEX = f"""lex AS MATERIALIZED (
  SELECT word FROM (SELECT doc_id, lower({CLEAN.format("token")}) AS word FROM {{tok}}) WHERE {SUGGESTABLE}
  GROUP BY word HAVING count(DISTINCT doc_id) >= greatest(2, (SELECT count(*) // 100 FROM documents))
  UNION SELECT word FROM {_words(TECH_WORDS)} UNION SELECT word FROM {_words(COMMON_WORDS)}
)"""


def _bad(source: str, valid: str, least: int = 1) -> str:
    """CTEs ending in bad(token, part_pos, word): what to flag in distinct tokens of source(token)."""
    clean = CLEAN.format
    return f"""valid AS MATERIALIZED ({valid}),
dtok AS MATERIALIZED (SELECT DISTINCT token FROM {source} WHERE {clean("token")} <> ''),
whole_ok AS (SELECT token FROM dtok JOIN valid ON key = lower({clean("token")}) WHERE length({clean("token")}) >= {least}),
seg AS (SELECT token, lower({clean("s")}) AS key FROM (SELECT token, unnest(string_split(token, '.')) AS s FROM dtok WHERE contains(token, '.'))),
dot_ok AS (SELECT token FROM seg LEFT JOIN (SELECT key, true AS ok FROM valid) USING (key) GROUP BY token HAVING bool_and(coalesce(ok, false) AND key <> '')),
parts AS (SELECT token, unnest(range(0, len(a))) AS part_pos, {clean("unnest(a)")} AS word FROM (
  SELECT token, {PARTS.format("token")} AS a FROM dtok WHERE token NOT IN (SELECT token FROM whole_ok) AND token NOT IN (SELECT token FROM dot_ok))),
bad AS MATERIALIZED (SELECT token, part_pos, word FROM parts WHERE word <> '' AND length(word) >= {least} AND NOT regexp_matches(word, '^[0-9]') AND lower(word) NOT IN (SELECT key FROM valid))"""


VALID = f"SELECT lower(word) AS key FROM lex UNION SELECT word FROM {_words(TECH_WORDS)}"
OCC = "occ AS MATERIALIZED (SELECT doc_id, line, pos, part_pos, word FROM tok JOIN bad USING (token))"
CHECK = f"{TOK}, {LEX.format(tok='tok')}, {_bad('tok', VALID)}, {OCC}"

TYPO = "substr({0}, 1, 1) || substr({0}, 3, 1) || substr({0}, 2, 1) || substr({0}, 4)"
TYPOS = f"typos AS MATERIALIZED (SELECT DISTINCT {TYPO.format('word')} AS word FROM lex WHERE length(word) >= 4 AND {SUGGESTABLE} AND {TYPO.format('word')} NOT IN (SELECT word FROM lex))"
ONE = "list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1))"
TWO = f"list_distinct(list_concat([q], {ONE.format('q')}, flatten(list_transform({ONE.format('q')}, lambda d: {ONE.format('d').replace('lambda i', 'lambda k').replace('i - 1', 'k - 1').replace('i + 1', 'k + 1')}))))"


def _osa(pairs: str) -> str:
    """CTEs ending in osa(a, b, distance): alignment distance, 3 for more than 2. Rows of the table one by one."""
    cost = "CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END"
    step = f"list_transform(range(1, length(b) + 1), lambda j: least(p[j + 1] + 1, p[j] + {cost}, CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN pp[j - 1] + 1 ELSE 999 END))"
    return f"""osa_rows AS (
  SELECT a, b, 0 AS i, range(0, length(b) + 1) AS p, range(0, length(b) + 1) AS pp FROM (SELECT DISTINCT a, b FROM {pairs} WHERE abs(length(a) - length(b)) <= 2)
  UNION ALL
  SELECT a, b, i, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: t[k + 1] - k))) AS p, pp
  FROM (SELECT a, b, i, list_concat([CAST(i AS BIGINT)], {step}) AS t, p AS pp FROM (SELECT a, b, i + 1 AS i, p, pp FROM osa_rows WHERE i < length(a)))
),
osa AS MATERIALIZED (SELECT a, b, CAST(least(3, p[length(b) + 1]) AS BIGINT) AS distance FROM osa_rows WHERE i = length(a))"""


def _suggest(queries: str) -> str:
    """CTEs ending in best(query, suggestions, top_distance)."""
    return f"""qry AS (SELECT DISTINCT lower(word) AS q FROM {queries} WHERE length(word) >= 2),
idx AS (SELECT unnest(list_distinct(list_concat([word], {ONE.format("word")}))) AS deletion, word AS candidate FROM lex WHERE {SUGGESTABLE}),
pairs AS MATERIALIZED (SELECT DISTINCT q AS a, candidate AS b FROM (SELECT q, unnest({TWO}) AS deletion FROM qry) JOIN idx USING (deletion) WHERE q <> candidate),
{_osa("pairs")},
scored AS MATERIALIZED (SELECT a AS query, b AS candidate, distance FROM osa WHERE distance <= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, candidate IN (SELECT word FROM {_words(COMMON_WORDS)}) DESC, abs(length(candidate) - length(query)), candidate) AS rank FROM scored),
best AS MATERIALIZED (SELECT query, list(candidate ORDER BY rank) AS suggestions, min(distance) AS top_distance FROM ranked WHERE rank <= 3 GROUP BY query)"""


#: words(word, suggestions, top_distance) without learned fixes
SUGGESTED = "sug AS MATERIALIZED (SELECT word, coalesce(suggestions, []) AS suggestions, top_distance FROM (SELECT DISTINCT word FROM occ) LEFT JOIN best ON query = lower(word))"
MIS = """mis AS MATERIALIZED (SELECT doc_id, word, list_sort(list(DISTINCT line)) AS lines, min(struct_pack(line, pos, part_pos)) AS first, any_value(suggestions) AS suggestions, any_value(top_distance) AS top_distance
  FROM occ JOIN sug USING (word) GROUP BY doc_id, word)"""
FULL = f"WITH RECURSIVE {CHECK}, {_suggest('occ')}, {SUGGESTED}, {MIS}"

BRAND_ROWS = [(("".join(c for c in b if c.isalnum())).lower(), b, "".join(c for c in b if c.isalnum())) for b in BRANDS]


#: A form of a finding in JSON; forms hold letters, digits, hyphens, underscores and apostrophes only.
ENTRY = """'{{"form":"' || form || '","lines":[' || array_to_string({lines}, ',') || '],"count":' || {n} || '}}'"""


def _lint(source: str) -> str:
    """CTEs casing and variants of source(doc_id, line, pos, token), and findings(doc_id, place, kind, recommendation, forms, lines)."""
    form = "regexp_replace(regexp_replace(token, '[^A-Za-z0-9''_-]', '', 'g'), '^[-'']+|[-'']+$', '', 'g')"
    return f"""form AS MATERIALIZED (SELECT * FROM (SELECT doc_id, line, pos, {form} AS form FROM {source}) WHERE length(form) >= 2),
brand AS (SELECT * FROM {_values(BRAND_ROWS)} AS b(key, display, alpha)),
raw AS (SELECT doc_id, line, pos, regexp_replace(form, '[^A-Za-z0-9]', '', 'g') AS raw FROM form),
named AS (SELECT doc_id, line, pos, coalesce(x.display, y.display) AS recommendation, coalesce(x.alpha, y.alpha) AS alpha, CASE WHEN x.key IS NULL THEN left(raw, length(raw) - 1) ELSE raw END AS form
  FROM raw LEFT JOIN brand x ON x.key = lower(raw) LEFT JOIN brand y ON y.key = left(lower(raw), length(raw) - 1) AND lower(raw) LIKE '%s' WHERE x.key IS NOT NULL OR y.key IS NOT NULL),
casing AS MATERIALIZED (SELECT doc_id, form, recommendation, count(DISTINCT line) AS n, list_sort(list(DISTINCT line)) AS lines, min(struct_pack(line, pos)) AS first,
  {ENTRY.format(lines="list_sort(list(DISTINCT line))", n="count(DISTINCT line)")} AS detail
  FROM named WHERE form <> alpha AND NOT (form = upper(form) AND regexp_matches(form, '[A-Z]')) GROUP BY doc_id, form, recommendation),
variant AS (SELECT doc_id, group_key, lower(form) AS v, count(*) AS n, arg_min(form, struct_pack(line, pos)) AS form, list_sort(list(DISTINCT line)) AS lines, min(struct_pack(line, pos)) AS first
  FROM (SELECT *, translate(lower(form), '-_''', '') AS group_key FROM form) WHERE length(group_key) >= 3 AND regexp_matches(form, '[A-Za-z]') GROUP BY ALL),
variants AS MATERIALIZED (SELECT doc_id, group_key, form, n, lines, first, row_number() OVER (PARTITION BY doc_id, group_key ORDER BY n DESC, length(form), replace(replace(form, '_', chr(1)), '-', chr(2))) AS place
  FROM variant QUALIFY count(*) OVER (PARTITION BY doc_id, group_key) > 1),
found AS (SELECT doc_id, 'casing' AS kind, recommendation, [form] AS forms, lines, first, detail FROM casing
  UNION ALL SELECT doc_id, 'variants', arg_min(form, place), list(form ORDER BY place), list_sort(list_distinct(flatten(list(lines)))), min(first), string_agg({ENTRY.format(lines="lines", n="n")}, ',' ORDER BY place) FROM variants GROUP BY doc_id, group_key),
findings AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_min(lines), kind, first) AS place, kind, recommendation, forms, lines, detail FROM found)"""


TERMS = f"terms AS MATERIALIZED {_tok('(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM ' + _values(fixtures.TERMS) + ' AS t(doc_id, text))')}"
QUOTED = "array_to_string(list_transform(forms, lambda f: '''' || f || ''''), ' vs ')"

COMPOUNDS = f"""{TOK}, w AS (SELECT doc_id, line, pos, {CLEAN.format('token')} AS w FROM tok WHERE {CLEAN.format('token')} <> ''),
pairs2 AS (SELECT DISTINCT a.w, b.w AS v FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.line = b.line AND a.pos + 1 = b.pos),
compound AS MATERIALIZED (SELECT DISTINCT unnest([w || upper(left(v, 1)) || substr(v, 2), w || '_' || v, w || '-' || v, w || '.' || v, upper(w) || upper(left(v, 1)) || substr(v, 2)]) AS token FROM pairs2)"""

IDENTIFIERS = "regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*')"
VOCAB = "regexp_matches(word, '^[a-z]{2,24}$')"
PATHS = f"""paths AS (
  SELECT (['src', 'lib/node_modules', '.cache', 'docs', 'Build'])[doc_id % 5 + 1] || '/' || replace(array_to_string(({_tokens(_trim('text'))})[1:3], '-'), '/', '_') || (['.ts', '.py', '.jsx', '.min.js', '.md', '.bin', ''])[doc_id % 7 + 1] AS path,
         length(text) AS length, text AS content FROM documents
  UNION ALL SELECT path, length(content), content FROM {_values(fixtures.FILES)} AS f(path, content)
), split AS (SELECT *, string_split(path, '/') AS s FROM paths),
wanted AS (SELECT path, length, content, s[-1] AS name, lower(s[-1]) AS low FROM split
  WHERE len(list_filter(s[1:-2], lambda d: starts_with(d, '.') OR list_contains([{', '.join(map(_text, SKIP_DIRS))}], lower(d)))) = 0
    AND NOT starts_with(s[-1], '.') AND NOT contains(lower(s[-1]), 'lock') AND NOT (ends_with(lower(s[-1]), '.map') OR ends_with(lower(s[-1]), '.min.js') OR ends_with(lower(s[-1]), '.min.css'))),
classified AS MATERIALIZED (SELECT *, CASE WHEN low IN ({', '.join(map(_text, MANIFESTS))}) THEN 'manifest' WHEN extension IN ({', '.join(map(_text, SOURCE_EXTENSIONS))}) THEN 'source' ELSE 'other' END AS role,
  left(name, length(name) - length(extension)) AS stem FROM (SELECT *, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) AS extension FROM wanted))"""
COUNTED = f"""ident AS (SELECT lower(unnest({PARTS.format('name')})) AS word FROM (SELECT unnest({IDENTIFIERS}) AS name FROM {{source}})),
stem_words AS (SELECT lower(unnest(regexp_split_to_array(stem, '[^a-zA-Z]+'))) AS word FROM classified WHERE role = 'source')"""

#: What the manifests of the fixtures say, word by word.
MANIFEST_WORDS = sorted(
    "kubernets kit spellcheck typo scope leftpad vitest github com acme kubernetctl golang org tools example wrodcount serde quickcheck macros zorpcrate snakekit requestz numpyish flaskish djangoo uvicornz".split()
)
JSON_PHRASES = ["kubernets-kit", "spellcheck", "typo", "@scope/leftpad", "vitest"]

DIRECTIVES = "string_split(text, chr(10)) AS a"

TASKS = f"""{FULL}, {_lint('tok')},
each AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word), line ORDER BY first) AS nth FROM (SELECT doc_id, word, first, suggestions, top_distance, len(lines) AS times, unnest(lines) AS line FROM mis)),
task AS (
  SELECT doc_id, CASE WHEN len(suggestions) = 0 OR times >= 2 THEN 2 WHEN top_distance = 1 THEN 0 ELSE 1 END AS confidence, line,
    CASE WHEN len(suggestions) = 0 THEN '[review] line ' || line || ': ''' || word || ''' has no suggestion — rewrite or bless: wordloom --add-word ' || word
         WHEN times >= 2 THEN '[review] line ' || line || ': ''' || word || ''' appears on ' || times || ' lines — if intentional, bless: wordloom --add-word ' || word || '; suggested fix: ''' || suggestions[1] || ''''
         ELSE '[fix:' || CASE WHEN top_distance = 1 THEN 'high' ELSE 'medium' END || '] line ' || line || ': replace ''' || word || ''' with ''' || suggestions[1] || '''' || CASE WHEN len(suggestions) > 1 THEN ' (alternatives: ' || array_to_string(suggestions[2:], ', ') || ')' ELSE '' END END AS text,
    0 AS source, first.line AS k1, first.pos AS k2, first.part_pos AS k3
  FROM each WHERE nth = 1
  UNION ALL
  SELECT doc_id, 2, list_min(lines), '[review] consistency line ' || list_min(lines) || ': ' || CASE WHEN kind = 'casing' THEN '''' || forms[1] || ''' should be ''' || recommendation || '''' ELSE {QUOTED} || ' — prefer ''' || recommendation || '''' END, 1, place, 0, 0 FROM findings)"""

CASED = "CASE WHEN length(v) > 1 AND v = upper(v) THEN upper({r}) WHEN left(v, 1) = upper(left(v, 1)) THEN upper(left({r}, 1)) || substr({r}, 2) ELSE {r} END"
TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"


def _fixed(source: str) -> str:
    """CTEs ending in fixed(doc_id, line, old, value) of source(doc_id, text): the words of a line replaced one after the other, each in the case in which it is found."""
    return rf"""WITH RECURSIVE typed AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '(?m)^([^ \n]+ [^ \n]+ [A-Za-z])([a-z])([a-z])([a-z]+ )', '\1\3\2\4', 'g') AS text FROM {source}),
clean AS MATERIALIZED {_tok('documents')}, tok AS MATERIALIZED {_tok('typed')}, {LEX.format(tok='clean')}, {_bad('tok', VALID)}, {OCC}, {_suggest('occ')}, {SUGGESTED},
each AS (SELECT doc_id, line, lower(word) AS word, arg_min(suggestions[1], struct_pack(pos, part_pos)) AS replacement, min(struct_pack(pos, part_pos)) AS first
  FROM occ JOIN sug USING (word) WHERE len(suggestions) > 0 GROUP BY doc_id, line, lower(word)),
fixes AS (SELECT doc_id, line, list(struct_pack(word, replacement) ORDER BY first, word) AS fixes FROM each GROUP BY doc_id, line),
step AS (
  SELECT doc_id, line, 1 AS k, value AS old, value, fixes FROM {_lines('typed')} JOIN fixes USING (doc_id, line)
  UNION ALL
  SELECT doc_id, line, k + 1, old, list_reduce(list_concat([value], list_distinct(regexp_extract_all(value, '(?i)\b' || fixes[k].word || '\b'))),
    lambda acc, v: regexp_replace(acc, '\b' || v || '\b', {CASED.format(r="fixes[k].replacement")}, 'g')), fixes FROM step WHERE k <= len(fixes)
),
fixed AS (SELECT doc_id, line, old, value FROM step WHERE k > len(fixes) AND value <> old)"""


#: The affix rules of the fixtures, written out: flag, suffix, combines, strip, added, condition, flags that follow.
RULES = """(VALUES ('P', false, true, '', 're', '', 'Q'), ('P', false, true, '', 'un', '[aeiou]', ''), ('Q', false, false, '', 'pre', '', ''),
  ('A', true, true, '', 's', '[^sy]', 'C'), ('A', true, true, 'y', 'ies', '[^aeiou]y', 'C'), ('A', true, true, 'e', 'ing', 'e', 'D'),
  ('B', true, true, '', 'er', '', 'A'), ('C', true, false, '', 'like', '', ''), ('D', true, false, '', 'ly', '', '')) AS r(flag, suffix, combines, strip, added, cond, following)"""
_HOLDS = "length(word) > length(strip) AND CASE WHEN suffix THEN ends_with(word, strip) AND regexp_matches(word, cond || '$') ELSE starts_with(word, strip) AND regexp_matches(word, '^' || cond) END"
_MADE = "CASE WHEN suffix THEN left(word, length(word) - length(strip)) || added ELSE added || substr(word, length(strip) + 1) END"
_FLAG = "CASE WHEN {} THEN '{}' ELSE '' END"
_MARKS = " || ".join([*(_FLAG.format(f"h % {by} = 0", flag) for flag, by in fixtures.STEM_FLAGS.items()), *(_FLAG.format(f"length(word) BETWEEN {low} AND {high}", flag) for flag, (low, high) in fixtures.PART_FLAGS.items())])
#: CTEs from lex(word) to stem(word, flags) and dict(word, keep_case).
DICT = f"""rule AS (SELECT * FROM {RULES}),
stem AS MATERIALIZED (SELECT CASE WHEN h % {fixtures.NAMES} = 1 THEN upper(left(word, 1)) || substr(word, 2) ELSE word END AS word, {_MARKS} AS flags FROM (SELECT word, length(word) * 7 + ascii(word) * 3 + ascii(right(word, 1)) AS h FROM lex)),
alone AS (SELECT word, flags, contains(flags, 'K') AS keep FROM stem WHERE NOT contains(flags, 'O')),
grown AS (
  SELECT {_MADE} AS word, flags, keep, following, suffix AND combines AS prefixable FROM alone JOIN rule ON contains(flags, flag) WHERE {_HOLDS}
  UNION SELECT {_MADE}, flags, keep, r.following, prefixable FROM grown g JOIN rule r ON contains(g.following, r.flag) WHERE {_HOLDS}),
prefixed AS (
  SELECT {_MADE} AS word, flags, keep, r.following FROM grown g JOIN rule r ON contains(flags, flag) AND prefixable AND combines AND NOT suffix WHERE {_HOLDS}
  UNION SELECT {_MADE}, flags, keep, r.following FROM prefixed g JOIN rule r ON contains(g.following, r.flag) WHERE {_HOLDS}),
dict AS MATERIALIZED (SELECT word, bool_and(keep) AS keep_case FROM (
  SELECT word, keep FROM alone WHERE NOT contains(flags, 'N') UNION ALL SELECT word, keep FROM grown UNION ALL SELECT word, keep FROM prefixed) GROUP BY word)"""


def _accepted(words: str) -> str:
    """CTEs from dict and stem to fits(word): which of words(word) are accepted by case or as compounds, VW*T or OT?, of four letters and more."""
    return f"""forms AS MATERIALIZED (SELECT word, unnest([word, CASE WHEN word = upper(word) AND word <> lower(word) THEN left(word, 1) || lower(substr(word, 2)) END, CASE WHEN word = upper(word) AND word <> lower(word) THEN lower(word) END,
  CASE WHEN left(word, 1) <> lower(left(word, 1)) THEN lower(left(word, 1)) || substr(word, 2) END]) AS form, unnest([false, true, true, true]) AS changed FROM (SELECT DISTINCT word FROM {words} WHERE word <> '')),
looked AS MATERIALIZED (SELECT f.word, form, changed, keep_case FROM forms f LEFT JOIN dict d ON d.word = form WHERE form IS NOT NULL),
piece AS MATERIALIZED (SELECT DISTINCT lower(word) AS piece, unnest(list_filter(string_split(flags, ''), lambda f: f IN ('V', 'W', 'T', 'O'))) AS flag FROM stem),
lengths AS (SELECT unnest(range(1, (SELECT max(length(piece)) FROM piece) + 1)) AS size),
cuts AS (SELECT DISTINCT lower(form) AS small, 0 AS pos, '' AS path FROM looked WHERE keep_case IS NULL AND length(form) >= 4
  UNION SELECT small, pos + size, path || flag FROM cuts JOIN lengths ON pos + size <= length(small) JOIN piece ON piece = substr(small, pos + 1, size) WHERE regexp_matches(path || flag, '^(VW*|VW*T|O|OT)$')),
compound AS MATERIALIZED (SELECT DISTINCT small FROM cuts WHERE pos = length(small) AND regexp_matches(path, '^(VW*T|OT?)$')),
fits AS MATERIALIZED (SELECT DISTINCT word FROM looked WHERE (keep_case IS NOT NULL AND NOT (changed AND keep_case)) OR (keep_case IS NULL AND lower(form) IN (SELECT small FROM compound)))"""


_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIXED = f"mixed AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN translate(text, '{_LOW}', '{_HIGH}') WHEN 3 THEN translate(text, '{_HIGH}', '{_LOW}') ELSE text END AS text FROM documents)"


def _bad_by_case(source: str, blind: str) -> str:
    """CTEs from dict and stem to bad(token, part_pos, word), where the words of `blind` are valid in any case."""
    clean = CLEAN.format
    fine = lambda x: f"(lower({x}) IN (SELECT key FROM blind) OR {x} IN (SELECT word FROM fits))"
    return f"""blind AS MATERIALIZED ({blind}),
dtok AS MATERIALIZED (SELECT token, {clean("token")} AS whole FROM (SELECT DISTINCT token FROM {source}) WHERE {clean("token")} <> ''),
seg AS MATERIALIZED (SELECT token, lower({clean("s")}) AS word FROM (SELECT token, unnest(string_split(token, '.')) AS s FROM dtok WHERE contains(token, '.'))),
part AS MATERIALIZED (SELECT token, unnest(range(0, len(a))) AS part_pos, {clean("unnest(a)")} AS word FROM (SELECT token, {PARTS.format("token")} AS a FROM dtok)),
asked AS (SELECT whole AS word FROM dtok UNION SELECT word FROM seg UNION SELECT word FROM part),
{_accepted("asked")},
dotted AS (SELECT token FROM seg GROUP BY token HAVING bool_and(word <> '' AND {fine("word")})),
bad AS MATERIALIZED (SELECT token, part_pos, word FROM part JOIN dtok USING (token) WHERE NOT {fine("whole")} AND token NOT IN (SELECT token FROM dotted) AND word <> '' AND NOT regexp_matches(word, '^[0-9]') AND NOT {fine("word")})"""


_MARKED = """CASE doc_id % 4
  WHEN 1 THEN CASE (i - 1) % 5 WHEN 1 THEN '```js' || chr(10) || v WHEN 3 THEN v || chr(10) || '```' ELSE v END
  WHEN 2 THEN CASE (i - 1) % 5 WHEN 1 THEN '<!-- open' || chr(10) || v WHEN 3 THEN v || chr(10) || 'close --> gone' ELSE v END
  WHEN 3 THEN v || ' `code` <!-- note --> end' ELSE v END"""


def _markdown(source: str) -> str:
    """A walk over the lines of all of source(doc_id, text) and of the fixtures at once: `state` is what ends the open block, as text, or empty."""
    return rf"""WITH RECURSIVE marked AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END
    || array_to_string(list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), lambda v, i: {_MARKED}), chr(10)) AS text FROM {source}
  UNION ALL SELECT doc_id, text FROM {_values([(-i, t) for i, t in fixtures.MARKDOWN])} AS t(doc_id, text)),
md AS MATERIALIZED (SELECT doc_id, line, value, {_trim('value')} AS bare, regexp_extract(value, '^{SP}*(`{{3,}}|~{{3,}})', 1) AS mark, contains(value, '-->') AS closes FROM {_lines('marked')}),
walk AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS line, '' AS state, false AS hidden FROM md
  UNION ALL
  SELECT doc_id, line, following, state <> '' OR following <> '' FROM (
    SELECT m.doc_id, m.line, state, CASE
      WHEN state = '' THEN CASE WHEN m.line = 1 AND bare = '---' THEN '---' WHEN mark <> '' THEN mark WHEN starts_with(bare, '<!--') AND NOT closes THEN '-->' ELSE '' END
      WHEN state = '---' THEN CASE WHEN regexp_matches(value, '^---{SP}*$') THEN '' ELSE state END
      WHEN state = '-->' THEN CASE WHEN closes THEN '' ELSE state END
      WHEN mark <> '' AND starts_with(bare, state) THEN '' ELSE state END AS following
    FROM walk w JOIN md m ON m.doc_id = w.doc_id AND m.line = w.line + 1))
SELECT doc_id, line, CASE WHEN hidden THEN '' ELSE regexp_replace({_trim("regexp_replace(regexp_replace(value, '<!--.*?-->', ' ', 'g'), '`[^`]*`', ' ', 'g')")}, ' +', ' ', 'g') END AS kept FROM walk JOIN md USING (doc_id, line)"""


SQL = {
    "q01_misspelled_words": f"WITH {CHECK} SELECT doc_id, word, count(*) AS n, count(DISTINCT line) AS n_lines, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM occ GROUP BY doc_id, word",
    "q02_token_stats_by_lang": f"WITH {TOK} SELECT lang, count(*) AS n_tokens, CAST(sum(length({CLEAN.format('token')})) AS BIGINT) AS clean_chars, count(DISTINCT {CLEAN.format('token')}) AS distinct_clean, CAST(sum(line) AS BIGINT) AS line_sum FROM tok JOIN documents USING (doc_id) GROUP BY lang",
    "q03_noise_strip": f"""WITH v AS (SELECT 'url' AS kind, page_id AS id, 1 AS line, url AS value FROM pages UNION ALL SELECT 'text', doc_id, line, value FROM {_lines('documents')}),
s AS (SELECT kind, id, CAST(line AS INTEGER) AS line, array_to_string({_tokens(_strip('value'))}, ',') AS kept, array_to_string({_tokens('value')}, ',') AS plain FROM v)
SELECT kind, id, line, kept FROM s WHERE kept <> plain""",
    "q04_directive_lines": f"""WITH k AS (SELECT doc_id, line, CASE WHEN line % 4 = 2 THEN (['off', 'disable-next-line', 'on', 'disable-line'])[(line // 4) % 4 + 1] END AS kind, value FROM {_lines('documents')}),
s AS (SELECT *, last_value(CASE WHEN kind IN ('off', 'on') THEN kind END IGNORE NULLS) OVER w AS state, sum(CASE WHEN kind = 'disable-next-line' THEN 1 ELSE 0 END) OVER w AS armed FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT doc_id, line, value, armed, lag(armed, 1, 0) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM s WHERE kind IS NULL AND coalesce(state, 'on') = 'on')
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(value) AS BIGINT) AS chars FROM c WHERE armed = used""",
    "q05_markdown_blank": _markdown(TURNS),
    "q06_html_comment_blank": "SELECT page_id, CAST(line AS BIGINT) AS line, md5(regexp_replace(regexp_replace(value, '<!--.*?-->', ' ', 'g'), '`[^`]*`', ' ', 'g')) AS kept_md5 FROM (SELECT page_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS value FROM (SELECT page_id, string_split(html, chr(10)) AS a FROM pages))",
    "q07_identifier_split": f"WITH {COMPOUNDS} SELECT token, array_to_string({PARTS.format('token')}, ' ') AS parts FROM compound",
    "q08_dotted_tokens": f"WITH {COMPOUNDS}, {LEX.format(tok='tok')}, {_bad('compound', VALID)} SELECT token, CAST(part_pos AS BIGINT) AS part_pos, word FROM bad",
    "q09_ignore_extra_minlen": f"WITH {TOK}, {_bad('tok', f'SELECT lower(word) AS key FROM {_words(COMMON_WORDS)} UNION SELECT word FROM {_words(TECH_WORDS)} UNION SELECT lower(word) FROM {_words(["Thing", "heed", "queaux", "sich", "EINE", "ment"])}', 5)}, {OCC} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM occ GROUP BY word",
    "q10_deletions": f"WITH {TOK}, {LEX.format(tok='tok')}, idx AS (SELECT unnest(list_distinct(list_concat([word], {ONE.format('word')}))) AS deletion, word FROM lex WHERE {SUGGESTABLE}) SELECT deletion, count(*) AS n, min(word) AS first_candidate FROM idx GROUP BY deletion",
    "q11_osa_distance": f"WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, p AS MATERIALIZED (SELECT a, b FROM {_values(fixtures.WORD_PAIRS)} AS t(a, b) UNION SELECT {TYPO.format('word')}, word FROM lex WHERE length(word) >= 4), {_osa('p')} SELECT a, b, coalesce(distance, 3) AS distance FROM p LEFT JOIN osa USING (a, b)",
    "q12_candidates": f"WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, {TYPOS}, {_suggest('typos')} SELECT query, candidate, distance FROM scored",
    "q13_suggest_top3": f"WITH RECURSIVE {CHECK}, {_suggest('occ')} SELECT query, array_to_string(suggestions, ',') AS suggestions, top_distance FROM best",
    "q14_learned_first": f"""WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, {TYPOS}, {_suggest('typos')}
SELECT word, array_to_string(CASE WHEN length(word) % 2 = 0 THEN list_concat(['Fixed-' || word], coalesce(suggestions, []))[1:3] ELSE coalesce(suggestions, []) END, ',') AS suggestions,
       CAST(CASE WHEN length(word) % 2 = 0 THEN 1 ELSE top_distance END AS BIGINT) AS top_distance FROM typos LEFT JOIN best ON query = word""",
    "q15_brand_casing": f"WITH {TERMS}, {_lint('terms')} SELECT CAST(doc_id AS BIGINT) AS doc_id, form, recommendation, n, array_to_string(lines, ',') AS lines FROM casing",
    "q16_separator_variants": f"WITH {TERMS}, {_lint('terms')} SELECT CAST(doc_id AS BIGINT) AS doc_id, group_key, form, n, array_to_string(lines, ',') AS lines, place FROM variants",
    "q17_findings_union": f"WITH {TERMS}, {_lint('terms')} SELECT CAST(doc_id AS BIGINT) AS doc_id, place, kind, recommendation, array_to_string(forms, ',') AS forms, array_to_string(lines, ',') AS lines FROM findings",
    "q18_identifier_vocab": f"SELECT word, count(*) AS n FROM (SELECT lower(unnest({PARTS.format('name')})) AS word FROM (SELECT unnest({IDENTIFIERS}) AS name FROM (SELECT text AS content FROM documents UNION ALL SELECT text FROM conversations))) WHERE {VOCAB} GROUP BY word HAVING count(*) >= 3",
    "q19_filename_vocab": f"WITH {PATHS}, {COUNTED.format(source='classified')} SELECT word, count(*) AS n FROM stem_words WHERE {VOCAB} GROUP BY word",
    "q20_json_keys": "SELECT json_key, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS event_id_sum FROM (SELECT event_id, unnest(json_keys(CAST(props AS JSON))) AS json_key FROM events) GROUP BY json_key UNION ALL SELECT 'app/package.json:' || phrase, 1, 0 FROM " + _values([(p,) for p in JSON_PHRASES]) + " AS t(phrase)",
    "q21_toml_gomod_reqs": f"""SELECT word FROM {_words(MANIFEST_WORDS)} UNION SELECT unnest([split_part(p_name, ' ', 1) || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij'), split_part(p_name, ' ', 2)]) FROM part""",
    "q22_vocab_union_stats": f"""WITH {PATHS}, {COUNTED.format(source="(SELECT content FROM classified WHERE role = 'source')")}, counted AS (SELECT word FROM (SELECT word FROM ident UNION ALL SELECT word FROM stem_words) WHERE {VOCAB} GROUP BY word HAVING count(*) >= 3),
every AS (SELECT word FROM counted UNION SELECT word FROM {_words(MANIFEST_WORDS)})
SELECT (SELECT count(*) FROM every) AS words, (SELECT CAST(sum(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT)) AS BIGINT) FROM every) AS words_digest, CAST({len(MANIFEST_WORDS)} AS BIGINT) AS manifest_words, (SELECT count(*) FROM counted) AS counted_words, (SELECT count(*) FROM classified) AS files_scanned""",
    "q23_wordlist_load_append": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT unnest(['ALPHA', 'beta', 'alpha'])) WHERE lower(word) NOT IN ('alpha', 'beta', 'blush') GROUP BY word",
    "q24_corrections_append": f"SELECT typo, fix FROM (SELECT lower(n_name) AS typo, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS fix FROM nation UNION ALL SELECT * FROM {_values(fixtures.NEW_PAIRS)} AS t(typo, fix)) WHERE (lower(typo), fix) NOT IN (('teh', 'The'), ('wrod', 'word'), ('japan', 'Japan'))",
    "q25_fix_lines": f"{_fixed("documents")} SELECT doc_id, CAST(line AS BIGINT) AS line, md5(old) AS old_md5, md5(value) AS new_md5 FROM fixed",
    "q26_diff": f"{_fixed(TURNS)} SELECT doc_id, CAST(line AS BIGINT) AS line, '@@ line ' || line || chr(10) || '-' || old || chr(10) || '+' || value AS hunk FROM fixed",
    "q27_learned_pairs": f"{FULL} SELECT lower(word) AS typo, arg_max(suggestions[1], struct_pack(doc_id, line, pos, part_pos)) AS fix FROM occ JOIN sug USING (word) WHERE len(suggestions) > 0 GROUP BY 1",
    "q28_unfixable": f"{FULL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place, word FROM mis WHERE len(suggestions) = 0",
    "q29_agent_tasks": f"""{TASKS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, line, source, k1, k2, k3) AS n, CAST(confidence AS BIGINT) AS confidence, CAST(line AS BIGINT) AS line, text FROM task""",
    "q30_text_json_report": f"""{FULL}, {_lint('tok')}
SELECT doc_id, CAST(0 AS BIGINT) AS section, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place, doc_id || ': ''' || word || ''' misspelled on line(s): ' || array_to_string(lines, ', ') || '.' || CASE WHEN len(suggestions) > 0 THEN ' Suggestions: ' || array_to_string(suggestions, ', ') ELSE '' END AS report_line FROM mis
UNION ALL SELECT doc_id, 1, place, doc_id || ': terminology: ' || {QUOTED} || ' — prefer ''' || recommendation || ''' (line(s): ' || array_to_string(lines, ', ') || ')' FROM findings
UNION ALL SELECT doc_id, 2, 1, 'No errors, everything is good' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mis UNION SELECT doc_id FROM findings)""",
    "q31_generate_dict": f"WITH {CHECK} SELECT DISTINCT word FROM occ WHERE lower(word) NOT IN ('alpha', 'beta', 'blush')",
    "q32_path_filters": rf"WITH {PATHS} SELECT path, extension, role, regexp_matches(path, '(?i)\.(md|markdown|mdx)$') AS markdown FROM classified",
    "q33_diff_documents": f"{_fixed("documents")} SELECT doc_id, CAST(line AS BIGINT) AS line, '@@ line ' || line || chr(10) || '-' || old || chr(10) || '+' || value AS hunk FROM fixed",
    "q34_markdown_documents": _markdown("documents"),
    "q35_json_report": f"""{FULL}, {_lint('tok')},
m AS (SELECT doc_id, count(*) AS n, string_agg('{{"word":"' || word || '","lines":[' || array_to_string(lines, ',') || '],"suggestions":[' || array_to_string(list_transform(suggestions, lambda s: '"' || s || '"'), ',') || ']' || coalesce(',"topDistance":' || top_distance, '') || '}}', ',' ORDER BY first) AS words FROM mis GROUP BY doc_id),
c AS (SELECT doc_id, string_agg('{{"kind":"' || kind || '","recommendation":"' || recommendation || '","forms":[' || detail || '],"lines":[' || array_to_string(lines, ',') || ']}}', ',' ORDER BY place) AS terms FROM findings GROUP BY doc_id)
SELECT doc_id, '{{"file":"' || doc_id || '","count":' || coalesce(n, 0) || ',"misspellings":[' || coalesce(words, '') || '],"consistency":[' || coalesce(terms, '') || ']}}' AS report
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "q36_task_lists": f"""{TASKS},
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, line, source, k1, k2, k3) AS n, confidence, text FROM task),
listed AS (SELECT doc_id, count(*) AS issues, count(*) FILTER (confidence <> 2) AS fixable, string_agg(n || '. ' || text, chr(10) ORDER BY n) AS lines FROM numbered GROUP BY doc_id)
SELECT doc_id, '# SPELLCHECK TASK LIST' || chr(10) || '# file: ' || doc_id || chr(10) || CASE WHEN issues IS NULL THEN '# NO ISSUES'
  ELSE '# issues: ' || issues || ' (' || fixable || ' fixable, ' || (issues - fixable) || ' review)' || chr(10) || '# self-service: wordloom --fix ' || doc_id || chr(10) || lines END AS text
FROM documents LEFT JOIN listed USING (doc_id)""",
    "q40_json_manifests": """WITH made AS (SELECT '{"name": ' || (['"kit-' || event_type || '"', '7', '{"inner": "nope"}', 'null', '["listed"]'])[event_id % 5 + 1]
  || ', "keywords": ' || (['["' || event_type || '", {"hidden": "object"}, true, null, 3.5, ["' || event_type || '"], "word-' || event_id || '"]', '{"key": "value"}', '"' || event_type || '"'])[event_id % 3 + 1]
  || ', "dependencies": ' || (['{"dep-' || event_type || '": 1, "@scope/' || event_type || '": null, "deep": {"inside": "no"}}', '["listed"]', '"text"', 'null'])[event_id % 4 + 1]
  || ', "props": ' || props || CASE WHEN event_id % 7 = 6 THEN '' ELSE '}' END AS content FROM events),
parsed AS MATERIALIZED (SELECT CAST(content AS JSON) AS j FROM made WHERE json_valid(content)),
phrases AS (SELECT j->>'$.name' AS phrase FROM parsed WHERE json_type(j, '$.name') = 'VARCHAR'
  UNION ALL SELECT k->>'$' FROM (SELECT unnest(json_extract(j, '$.keywords[*]')) AS k FROM parsed WHERE json_type(j, '$.keywords') = 'ARRAY') WHERE json_type(k) = 'VARCHAR'
  UNION ALL SELECT unnest(json_keys(j, '$.dependencies')) FROM parsed WHERE json_type(j, '$.dependencies') = 'OBJECT')
SELECT phrase, count(*) AS n FROM phrases GROUP BY phrase""",
    "q37_dictionary_words": f"WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, {DICT} SELECT word, keep_case FROM dict",
    "q38_accepted_words": f"""WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, {DICT}, own AS (SELECT DISTINCT {CLEAN.format("token")} AS word FROM tok), {_accepted("own")}
SELECT word, word IN (SELECT word FROM fits) AS valid FROM own WHERE word <> ''""",
    "q39_misspelled_by_case": f"""WITH RECURSIVE {TOK}, {LEX.format(tok='tok')}, {DICT}, {MIXED}, mtok AS MATERIALIZED {_tok("mixed")},
{_bad_by_case("mtok", f"SELECT word AS key FROM {_words(TECH_WORDS)} UNION SELECT word FROM {_words(COMMON_WORDS)}")}
SELECT doc_id, word, count(*) AS n, count(DISTINCT line) AS n_lines FROM mtok JOIN bad USING (token) GROUP BY doc_id, word""",
}
