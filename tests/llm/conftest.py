import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Tables by rows of (doc_id, text[, lang[, source]]), with columns of clashing names beside."""

    def documents(rows, clash=True):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        made = spark.createDataFrame(full, DOCUMENTS)
        extra = ("chunk", "size", "target", "rank", "taken", "score", "hash_range", "bucket", "key", "length", "component_id") if clash else ()
        return made.withColumns({c: F.lit("clash") for c in extra})

    return documents


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
