"""A project's own vocabulary: manifest words, and identifier and file-name words that are frequent enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom import lists
from wordloom.functions import text as T
from wordloom.storage import settle

MIN_COUNT = 3
DEPENDENCY_KINDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def _phrase_words(phrases: DataFrame) -> DataFrame:
    """(path, word) of phrases(path, phrase): letter runs that are vocabulary words."""
    return phrases.select("path", F.explode(F.split("phrase", "[^a-zA-Z]+")).alias("word")).select("path", F.lower("word").alias("word")).where(T.is_vocabulary_word(F.col("word")))


def wanted_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files of files(path, ...) outside skipped and hidden places, no lock or minified files; the first by path up to a cap."""
    name, folders = T.file_name(F.col("path")), F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda d: d.startswith(".") | F.lower(d).isin(lists.SKIP_DIRS)) | name.startswith(".")
    low = F.lower(name)
    locked = low.contains("lock") | low.endswith(".map") | low.endswith(".min.js") | low.endswith(".min.css")
    kept = files.where(~hidden & ~locked)
    return kept if max_files is None else kept.orderBy("path").limit(max_files)


def classified(files: DataFrame) -> DataFrame:
    """files with name, stem, extension, and role: manifest, source or other."""
    name = T.file_name(F.col("path"))
    out = files.withColumn("name", name).withColumn("extension", T.extension(F.col("name")))
    role = F.when(F.lower("name").isin(lists.MANIFESTS), "manifest").when(F.col("extension").isin(lists.SOURCE_EXTENSIONS), "source").otherwise("other")
    return out.withColumn("stem", F.expr("substring(name, 1, length(name) - length(extension))")).withColumn("role", role)


def identifier_words(texts: DataFrame) -> DataFrame:
    """(word, n): the vocabulary sub-words of the identifiers in texts(content), a row for each distinct identifier that has them."""
    names = texts.select(F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("name"))
    names = names.groupBy("name").agg(F.count("*").alias("n"))
    return names.select(F.explode(T.split_identifiers(F.col("name"))).alias("part"), "n").select(F.lower("part").alias("word"), "n").where(T.is_vocabulary_word(F.col("word")))


def file_name_words(sources: DataFrame) -> DataFrame:
    """(word) for each letter run of each file's stem."""
    return _phrase_words(sources.select("path", F.col("stem").alias("phrase"))).select("word")


def counted_words(sources: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): identifier and file-name words of source files, counted together, at least min_count times."""
    both = identifier_words(sources).union(file_name_words(sources).withColumn("n", F.lit(1).cast("long")))
    return both.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, min_count))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw")).select("path", "at", T.trim(F.col("raw")).alias("line"))


def _string(value: Column) -> Column:
    """The text of a variant that is a JSON string; null for any other."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def package_json_phrases(files: DataFrame) -> DataFrame:
    """(path, phrase): name, keywords and dependency names. Text that is no JSON object gives nothing, nor does what has another type than it should.

    A name or keyword counts only as a JSON string, keywords only in an array, dependencies only as the keys of an object, whatever their values.
    """
    read = files.select("path", F.try_parse_json("content").alias("j"))
    part = lambda name, kind: F.try_variant_get("j", f"$.{name}", kind)
    read = read.select("path", part("name", "variant").alias("name"), part("keywords", "array<variant>").alias("keywords"), *(F.map_keys(part(k, "map<string,variant>")).alias(k) for k in DEPENDENCY_KINDS))
    empty = F.array().cast("array<string>")
    named = [F.array(_string(F.col("name"))), F.coalesce(F.transform("keywords", _string), empty), *(F.coalesce(k, empty) for k in DEPENDENCY_KINDS)]
    return read.select("path", F.explode(F.concat(*named)).alias("phrase")).where("phrase is not null")


def toml_section_keys(files: DataFrame, sections: list[str]) -> DataFrame:
    """(path, phrase): bare keys in sections whose last dotted name is one of those given."""
    header = F.regexp_extract("line", r"\A\[([^\]]+)\]\z", 1)
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = _lines(files).withColumn("header", header)
    last = F.lower(T.trim(F.element_at(F.split("header", r"\."), -1)))
    marked = marked.withColumn("section", F.last(F.when(F.col("header") != "", last), ignorenulls=True).over(so_far))
    key = F.regexp_extract("line", r"^([A-Za-z0-9_-]+)\s*=", 1)
    return marked.where((F.col("header") == "") & F.col("section").isin(sections)).select("path", key.alias("phrase")).where("phrase <> ''")


def _own_name(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("content", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1).alias("phrase")).where("phrase <> ''")


def cargo_phrases(files: DataFrame) -> DataFrame:
    return toml_section_keys(files, ["dependencies", "dev-dependencies", "build-dependencies"]).unionByName(_own_name(files))


def pyproject_phrases(files: DataFrame) -> DataFrame:
    arrays = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"dependencies\s*=\s*\[([^\]]*)\]"), F.lit(1))).alias("items"))
    quoted = arrays.select("path", F.explode(F.regexp_extract_all("items", F.lit('"([^"]+)"'), F.lit(1))).alias("phrase"))
    return _own_name(files).unionByName(quoted).unionByName(toml_section_keys(files, ["dependencies", "dev-dependencies"]))


def go_mod_phrases(files: DataFrame) -> DataFrame:
    """(path, phrase): required modules, in blocks or alone, and the module's own name."""
    line = F.col("line")
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = line.startswith("require (")
    marked = _lines(files).withColumn("event", F.when(opens, "open").when(line == ")", "close"))
    marked = marked.withColumn("state", F.last("event", ignorenulls=True).over(so_far))
    inside = (F.col("state") == "open") & ~opens
    first = F.element_at(F.split(line, rf"{T.SPACE}+"), 1)
    phrase = F.when(opens | (F.col("event") == "close"), None).when(inside, F.when((line != "") & ~line.startswith("//"), first)).when(line.startswith("require "), F.element_at(F.split(T.trim(F.substring(line, 9, 1 << 20)), rf"{T.SPACE}+"), 1)).when(line.startswith("module "), T.trim(F.substring(line, 8, 1 << 20)))
    return marked.select("path", phrase.alias("phrase")).where("phrase is not null")


def requirements_phrases(files: DataFrame) -> DataFrame:
    line = F.col("line")
    kept = _lines(files).where((line != "") & ~line.startswith("#") & ~line.startswith("-"))
    return kept.select("path", F.regexp_extract("line", rf"^[^{T.SPACES}<>=!~;\[()\],]*", 0).alias("phrase"))


HARVESTERS = {"package.json": package_json_phrases, "cargo.toml": cargo_phrases, "go.mod": go_mod_phrases, "pyproject.toml": pyproject_phrases, "requirements.txt": requirements_phrases}


def manifest_words(files: DataFrame) -> DataFrame:
    """(word): distinct words of the manifests among files(path, content)."""
    name = F.lower(T.file_name(F.col("path")))
    parts = [_phrase_words(harvest(files.where(name == kind))).select("word") for kind, harvest in HARVESTERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def harvest(files: DataFrame, max_files: int | None = lists.MAX_FILES, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """((word), one row of manifest_words, counted_words, files_scanned) of files(path, length, content).

    Larger files than MAX_FILE_BYTES count as scanned but are not read. Files are
    classified in one pass, which settles their names and the contents of those that are read.
    """
    seen = classified(wanted_files(files, max_files))
    content = F.when((F.col("length") <= lists.MAX_FILE_BYTES) & (F.col("role") != "other"), F.col("content"))
    seen = settle(seen.select("path", "stem", "role", "length", content.alias("content")))
    read = seen.where(F.col("length") <= lists.MAX_FILE_BYTES)
    manifests = settle(read.where("role = 'manifest'").select("path", "content"))
    trusted = settle(manifest_words(manifests))
    counted = settle(counted_words(read.where("role = 'source'"), min_count).select("word"))
    names = ("manifest_words", "counted_words", "files_scanned")
    parts = [rows.agg(*(F.count("*").alias(n) if n == own else F.lit(0).cast("long").alias(n) for n in names)) for own, rows in zip(names, (trusted, counted, seen), strict=True)]
    stats = parts[0].union(parts[1]).union(parts[2]).agg(*(F.sum(n).alias(n) for n in names))
    return trusted.union(counted).distinct(), stats



def json_keys(column: str) -> Column:
    """The keys of a JSON object column; null and broken JSON have none."""
    return F.coalesce(F.map_keys(F.from_json(column, "map<string,string>")), F.array().cast("array<string>"))
