"""Tables written once in the folder that all executors share, and read from there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The tables that are settled while it is entered, by this thread; they can be removed together."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._outer = _scope.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scope.reset(self._outer)

    def feeds(self, df: DataFrame) -> bool:
        """Whether a DataFrame that is still to be computed reads one of the tables."""
        read = df.inputFiles() if self.paths else []
        return any(path.rsplit("/", 1)[1] in file for path in self.paths for file in read)

    def remove(self, spark: SparkSession) -> None:
        """Delete the tables; no result that is still to be computed may need them."""
        for path in self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own that ends with
    the process, as in tests; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_dir()
    return folder.rstrip("/")


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="wordloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table goes when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
