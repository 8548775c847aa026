r"""Secret scans: base detectors, and weak parts of credentials that count only where complementary parts are near.

Method: multipart credential linking, by DataFrame functions only.

1. Each kind of part is one pattern. The places of its matches come from two
   arrays, the matches and the pieces between them, of which the lengths are
   summed by a window; a piece also tells how many blank lines it holds, so that
   every part knows its scope, the block of lines without a blank one between.
   No match runs over a line feed. Only texts with a match leave the scan with
   more than their id, and equal rows once.
2. Base parts stand as they are: `assign` and `hex` are secrets, `access` is an
   identifier. Weak parts that meet a base part are dropped.
3. Weak identifiers (`login`, `keyid`), weak secrets (`value`, `phrase`) and
   endpoints are interval-joined within scopes: identifiers need a secret, secrets
   an identifier, and endpoints a base or linked secret, at most NEAR characters
   apart and not overlapping. The join is a semi-join by text, scope and stretch of
   NEAR characters, in which at most so many parts begin or end: no pair is made,
   and a text with very many parts is many keys.

Spans are kind:start:end of whole matches in code points from 0, end exclusive.

Defined results: a null or empty text has no part; its digest is that of the
empty string. Rows that are equal have equal results. A null doc_id stays null.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.storage import settle

#: Most characters between parts that are linked.
NEAR = 200

_SETS = r"""["']?\x20*[:=]\x20*["']?"""
_BLANK_LINE = r"\n[\x20\t\r]*(?=\n)"


@dataclass(frozen=True)
class Kind:
    """A kind of part: pattern for the scan, in SQL plain (without look-around), the group of its value, and what a match needs."""

    name: str
    role: str
    base: bool
    pattern: str
    plain: str
    group: int = 0
    least: int = 1
    needs: str = ""


def _any_case(words: str) -> str:
    """A pattern of letters in either ASCII case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_SETS}([A-Za-z0-9+/_.=-]+)"
_LOGIN = f"({_any_case('user_?name|user|login|account|client_?id|access_?key_?id')}){_SETS}([A-Za-z0-9@+._-]+)"
_PHRASE = f"({_any_case('pwd|pass|auth|credential|private_?key')}){_SETS}([^\\x20\\x09-\\x0D\"',;]+)"
_ENDPOINT = f"((https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://|({_any_case('host|server|endpoint')}){_SETS})[A-Za-z0-9._:@/-]+"
_RUN = "[A-Za-z0-9+/_-]{16,}={0,2}"

#: In the order in which kinds are listed.
KINDS = [
    Kind("assign", "secret", True, _ASSIGN, _ASSIGN, 2, 6),
    Kind("access", "identifier", True, "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", "secret", True, "[0-9a-f]{24,}", "[0-9a-f]+", 0, 24),
    Kind("login", "identifier", False, _LOGIN, _LOGIN, 2, 3),
    Kind("keyid", "identifier", False, "A(KIA|SIA|ROA|IDA)[A-Z0-9]{8,}", "A(KIA|SIA|ROA|IDA)[A-Z0-9]{8,}"),
    # only a run with a digit can pass, and a run is looked at once
    Kind("value", "secret", False, f"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]){_RUN}", _RUN, 0, 16, "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"),
    Kind("phrase", "secret", False, _PHRASE, _PHRASE, 2, 4),
    Kind("endpoint", "endpoint", False, _ENDPOINT, _ENDPOINT),
]
ROLES = {k.name: k.role for k in KINDS}
_PLACE = ["key", "kind", "scope", "start", "end"]


def _matches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the matches of each kind as an array; those of weak kinds only where parts of two roles may meet."""
    base, weak = [k for k in KINDS if k.base], [k for k in KINDS if not k.base]
    found = lambda k: F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
    out = docs.select("doc_id", "text", *(found(k).alias(k.name) for k in base))
    # without a secret no weak part can count, nor without an identifier or an endpoint beside it
    has = lambda role: reduce(Column.__or__, [F.size(k.name) > 0 if k.base else F.col("text").rlike(k.pattern) for k in KINDS if k.role == role])
    secrets, others = has("secret"), has("identifier") | has("endpoint")
    out = out.withColumn("linkable", secrets).withColumn("linkable", F.when(F.col("linkable"), others).otherwise(False))
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text", *(k.name for k in base), *(F.when(F.col("linkable"), found(k)).otherwise(none).alias(k.name) for k in weak))


def _measured(k: Kind) -> Column:
    """For each match of a kind: characters and blank lines between it and the one before, its length, and whether it passes."""
    pieces = F.slice(F.split("text", k.pattern, -1), 1, F.size(k.name))
    value = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)) if k.group else F.col(k.name)
    passes = lambda v: (F.length(v) >= k.least) & (v.rlike(k.needs) if k.needs else F.lit(True))
    gaps = F.transform(pieces, lambda p: F.struct(F.length(p).cast("long").alias("gap"), F.regexp_count(p, F.lit(_BLANK_LINE)).cast("long").alias("blank")))
    sizes = F.zip_with(F.col(k.name), value, lambda m, v: F.struct(F.length(m).cast("long").alias("size"), passes(v).alias("passes")))
    each = F.zip_with(gaps, sizes, lambda g, s: F.struct(g["gap"].alias("gap"), g["blank"].alias("blank"), s["size"].alias("size"), s["passes"].alias("passes")))
    return F.when(F.size(k.name) > 0, each)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found) for each row of docs(doc_id, text): key tells rows with a match apart, found has an array for each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    matched = _matches(docs.select("doc_id", text.alias("text")))
    some = reduce(Column.__or__, [F.size(k.name) > 0 for k in KINDS])
    key = F.when(some, F.unhex(F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text").cast("binary"), 256)))
    return matched.select("doc_id", key.alias("key"), F.when(some, F.struct(*(_measured(k).alias(k.name) for k in KINDS))).alias("found"))


def parts(found: DataFrame) -> DataFrame:
    """(key, kind, scope, start, end): the parts of found(key, found), placed."""
    each = [found.select("key", F.lit(k.name).alias("kind"), F.posexplode(f"found.{k.name}").alias("at", "m")) for k in KINDS]
    each = reduce(DataFrame.unionByName, each).select("key", "kind", "at", "m.*")
    so_far = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = each.withColumn("end", end).withColumn("scope", F.sum("blank").over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    return placed.where("passes").select(*_PLACE)


def near(some: DataFrame, others: DataFrame, most: int = NEAR) -> DataFrame:
    """The rows of some parts that have one of the other parts in their scope, at most `most` characters away and not overlapping."""
    stretch = lambda at: F.floor(at / most)
    reach = lambda low, high: F.sequence(stretch(low), stretch(high))
    # another part after this one is met where it starts, one before it where it ends
    points = lambda side, at: others.select("key", "scope", F.lit(side).alias("side"), F.col(at).alias("at"), stretch(F.col(at)).alias("stretch"))
    edges = points("after", "start").union(points("before", "end")).distinct()
    after = some.select(*_PLACE, F.lit("after").alias("side"), F.col("end").alias("low"), (F.col("end") + most).alias("high"))
    before = some.select(*_PLACE, F.lit("before").alias("side"), F.greatest(F.lit(0), F.col("start") - most).alias("low"), F.col("start").alias("high"))
    asked = after.union(before).select("*", F.explode(reach(F.col("low"), F.col("high"))).alias("stretch"))
    same = [asked[c] == edges[c] for c in ("key", "scope", "side", "stretch")]
    met = asked.join(edges, [*same, edges["at"] >= asked["low"], edges["at"] <= asked["high"]], "left_semi")
    return met.select(*_PLACE).distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """Base parts, and the weak parts that overlap none of them."""
    base = F.col("kind").isin([k.name for k in KINDS if k.base])
    marked = placed.withColumn("base", base)
    whole = Window.partitionBy("key")
    onward = whole.orderBy(F.col("start"), F.col("base").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = whole.orderBy(F.col("start").desc(), F.col("base").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(onward) > F.col("start"), F.lit(False))
    met = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(backward) < F.col("end"), F.lit(False))
    return marked.withColumn("covered", covered).withColumn("met", met).where("base or not (covered or met)").select(*_PLACE)


def linked(placed: DataFrame) -> DataFrame:
    """Of parts, the base ones and the weak ones that complementary parts confirm."""
    own = settle(_apart(placed))
    of = lambda role, *base: own.where(F.col("kind").isin([k.name for k in KINDS if k.role == role and k.base in base]))
    secrets = settle(near(of("secret", False), of("identifier", False, True)))
    identifiers = near(of("identifier", False), of("secret", False, True))
    endpoints = near(of("endpoint", False), of("secret", True).union(secrets))
    return own.where(F.col("kind").isin([k.name for k in KINDS if k.base])).union(secrets).union(identifiers).union(endpoints)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs(doc_id, text)."""
    seen = settle(scanned(docs))
    some = settle(seen.where("key is not null").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("found").alias("found"), F.count("*").alias("rows")))
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i))), F.col("kind"))
    each = linked(parts(some)).select("key", F.struct("start", rank.alias("rank"), "end", "kind").alias("s"))
    spans = each.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("all"))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["rank"] < sum(k.base for k in KINDS))
    counted = lambda name: F.size(F.filter("all", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    names = [k.name for k in KINDS if k.base]
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    told = some.select("key", "doc_id", "rows").join(spans, "key", "left").withColumn("all", F.coalesce("all", none))
    told = told.select("doc_id", *map(counted, names), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("col")
    clean = seen.where("key is null").select("doc_id", *(F.lit(0).cast("long").alias(f"n_{n}") for n in names), F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return told.unionByName(clean)


def _sql() -> str:
    """Line by line, with plain joins of parts."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    kinds = []
    for i, k in enumerate(KINDS):
        ok = f"length(v[i]) >= {k.least}" + (f" AND regexp_matches(v[i], {quoted(k.needs)})" if k.needs else "")
        kinds.append(f"""SELECT doc_id, {quoted(k.name)} AS kind, {i} AS rank, {quoted(k.role)} AS role, {str(k.base).lower()} AS base, scope, start, start + length(m[i]) AS stop FROM (
  SELECT *, began + list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (
  SELECT *, unnest(range(1, len(m) + 1)) AS i, string_split_regex(line, {quoted(k.plain)}) AS p, regexp_extract_all(line, {quoted(k.plain)}, {k.group}) AS v
  FROM (SELECT *, regexp_extract_all(line, {quoted(k.plain)}) AS m FROM lines) WHERE len(m) > 0)) WHERE {ok}""")
    return rf"""
WITH split AS (
  SELECT doc_id, unnest(range(0, len(a))) AS place, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), lines AS MATERIALIZED (
  SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER prior, 0) AS began, coalesce(sum(CASE WHEN regexp_matches(line, '^[ \t\r]*$') THEN 1 ELSE 0 END) OVER prior, 0) AS scope
  FROM split WINDOW prior AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), every AS MATERIALIZED (
  {" UNION ALL ".join(kinds)}
), part AS MATERIALIZED (
  SELECT * FROM every w WHERE base OR NOT EXISTS (SELECT 1 FROM every b WHERE b.doc_id = w.doc_id AND b.base AND b.start < w.stop AND w.start < b.stop)
), pair AS MATERIALIZED (
  SELECT a.doc_id, a.kind, a.start, a.role, b.role AS other_role, b.base AS other_base, b.kind AS other_kind, b.start AS other_start FROM part a JOIN part b USING (doc_id, scope)
  WHERE NOT a.base AND (b.start - a.stop BETWEEN 0 AND {NEAR} OR a.start - b.stop BETWEEN 0 AND {NEAR})
), secret AS MATERIALIZED (SELECT DISTINCT doc_id, kind, start FROM pair WHERE role = 'secret' AND other_role = 'identifier'
), confirmed AS MATERIALIZED (
  SELECT * FROM secret UNION SELECT doc_id, kind, start FROM pair WHERE role = 'identifier' AND other_role = 'secret'
  UNION SELECT p.doc_id, p.kind, p.start FROM pair p WHERE role = 'endpoint' AND other_role = 'secret' AND (other_base OR EXISTS (SELECT 1 FROM secret s WHERE s.doc_id = p.doc_id AND s.kind = p.other_kind AND s.start = p.other_start))
), shown AS MATERIALIZED (
  SELECT doc_id, kind, rank, base, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM part WHERE base OR EXISTS (SELECT 1 FROM confirmed c WHERE c.doc_id = part.doc_id AND c.kind = part.kind AND c.start = part.start)
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM documents d LEFT JOIN shown s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
