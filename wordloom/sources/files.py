"""Documents and repositories from files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import lists
from wordloom.functions import text as T


#: Files that a task holds at once.
FILES_TOGETHER = 64


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, path, text, markdown): one document a file, its id a hash of the path; Markdown is told by the extension."""
    read = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return read.select(F.xxhash64("path").alias("doc_id"), "path", "text", T.is_markdown_path(F.col("path")).alias("markdown"))


def text_document(spark: SparkSession, text: str, doc_id: int = 0) -> DataFrame:
    """One document from a string, as from standard input."""
    return spark.createDataFrame([(doc_id, "<stdin>", text, False)], "doc_id long, path string, text string, markdown boolean")


def list_repository(root: str) -> list[str]:
    """Paths below a root, in order; hidden and skipped folders are not entered.

    Spark's own listing would also hide names that start with an underscore.
    """
    skip, found = set(lists.SKIP_DIRS), []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith(".") and n.lower() not in skip)
        found += [os.path.join(folder, f) for f in files if not f.startswith(".")]
    return sorted(found)


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content): a repository's files by relative path; large ones are listed but not read.

    Names are listed on the driver; files are read by the executors, which must see the root.
    """
    names = [os.path.relpath(path, root) for path in list_repository(root)]
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    parts = max(1, min(len(names) // FILES_TOGETHER, spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(parts).mapInArrow(_contents(root, lists.MAX_FILE_BYTES), "path string, length long, content string")


def _contents(root: str, most: int):
    def read(name: str) -> tuple[int, str | None]:
        path = os.path.join(root, name)
        try:
            size = os.path.getsize(path)
            if size > most:
                return size, None
            with open(path, encoding="utf-8", errors="replace", newline="") as file:
                return size, file.read()
        except OSError:
            return most + 1, None  # counts as one that is too large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_TOGETHER):
                names = batch.column("path").slice(start, FILES_TOGETHER)
                rows = [read(n) for n in names.to_pylist()]
                yield pa.RecordBatch.from_arrays([names, pa.array([s for s, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.string())], ["path", "length", "content"])

    return run


def discover_wordlists(folder: str, given: list[str], default: str = ".spelldict") -> list[str]:
    """The folder's default word list, if there, before those given; a given one that is missing is an error."""
    missing = [p for p in given if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    own = os.path.join(folder, default)
    return ([own] if os.path.exists(own) else []) + given
