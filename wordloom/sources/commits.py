"""Tables of text lines to which batches are appended once each, whoever tries again.

A table is a folder of numbered batches, `batch=1`, `batch=2` and so on. A batch
is written to a folder beside them that no reader sees, with an empty file named
after the batch's key, and becomes visible by one rename, which fails where the
number is taken. So

- a writer that dies before its rename leaves nothing that is read;
- one that dies after it, or is run again, finds its key and appends nothing;
- of two writers that come at once one is refused its number, looks at what the
  other has appended, and makes its rows anew.

A rename that fails where its target exists is atomic on the file systems of
clusters and on local ones; a store without it needs another committer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "_key-"
#: How often a writer makes its rows anew because others were first.
TRIES = 20


def _paths(spark: SparkSession, path: str):
    """The JVM's file API: the file system of a path, and a maker of paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, key) of a table's batches, in order."""
    files, place = _paths(spark, path)
    found = files.globStatus(place(f"{path}/batch=*/{_KEY}*")) or []
    names = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found]
    return sorted((int(batch.removeprefix("batch=")), key.removeprefix(_KEY)) for batch, key in names)


def read_batches(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """(value, batch) of all lines, or of those up to a batch; a table that is not there has none."""
    numbers = [n for n, _ in batches(spark, path) if last is None or n <= last]
    if not numbers:
        return spark.createDataFrame([], "value string, batch int")
    return spark.read.schema("value string, batch int").option("basePath", path).text([f"{path}/batch={n}" for n in numbers], lineSep="\n")


def _stage(rows: DataFrame, path: str, key: str) -> str:
    """Write a batch's lines where no reader looks; the folder."""
    spark = rows.sparkSession
    files, place = _paths(spark, path)
    folder = f"{path}/_staged/{uuid.uuid4().hex}"
    rows.write.text(folder, lineSep="\n")
    files.create(place(f"{folder}/{_KEY}{key}"), False).close()
    return folder


def _commit(spark: SparkSession, path: str, folder: str, number: int) -> bool:
    """Make a staged batch visible under a number; false if the number is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    source, target = (context.makeQualified(hadoop.Path(p)) for p in (folder, f"{path}/batch={number}"))
    try:
        context.rename(source, target, options)
    except Exception:
        if context.util().exists(target):
            return False
        raise
    return True


def append(spark: SparkSession, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Append the lines that make(lines so far) gives, as (value), under a key that no other batch has; how many lines were appended.

    A key that was appended already, by an earlier try, appends nothing. No line is appended by an empty batch.
    """
    files, place = _paths(spark, path)
    for _ in range(TRIES):
        known = batches(spark, path)
        if any(k == key for _, k in known):
            return 0
        last = known[-1][0] if known else 0
        folder = _stage(make(read_batches(spark, path, last)).select("value"), path, key)
        n = spark.read.schema("value string").text(folder, lineSep="\n").count()
        if n and not _commit(spark, path, folder, last + 1):
            files.delete(place(folder), True)
            continue
        if not n:
            files.delete(place(folder), True)
        return n
    raise RuntimeError(f"others append to {path} without end")


def sweep(spark: SparkSession, path: str) -> None:
    """Remove what dead writers have staged; for times when none is at work."""
    files, place = _paths(spark, path)
    files.delete(place(f"{path}/_staged"), True)
