"""The pipeline stage by stage on awkward documents."""

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import awkward, words
from tests.llm.test_text_operators import expected_components, kept

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


CLASHES = "rejected held_out lang_pred cross_entropy n_words n_removed kept_sha256 position copy copies carried row c0 at tie place spans regions through before goal slope".split() + ["with.dot"]


def test_stages(spark, make, tmp_path):
    rows = [(i, t, "en", "abc"[i % 3]) for i, t in awkward(11)]
    docs = make(rows).withColumns({c: F.lit("clash") for c in CLASHES})
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.where(" or ".join(f"`{c}` is distinct from 'clash'" for c in CLASHES)).count() == 0
        seen[name] = before.collect(), docs.collect()
    before, after = seen["language ID"]
    lettered = {r["doc_id"] for r in before if r["text"] and any(map(str.isalpha, r["text"]))}
    assert {r["doc_id"] for r in after} <= lettered
    assert len(after) >= 0.95 * len(lettered)
    before, after = seen["n-gram Jaccard join"]
    groups = expected_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)
    before, after = seen["substring dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == {r[0]: r[4] for r in kept([(r["doc_id"], r["text"]) for r in before])}
    before, after = seen["mixing sources"]
    size = sum(len(words(r["text"])) for r in before)
    assert sum(len(words(r["text"])) for r in after) == pytest.approx(1.5 * size, rel=0.01)
    before, after = seen["packing"]
    assert sum(r["start"] == 0 for r in after) == len(before)


def test_repeated_rows_and_empty(spark, make, tmp_path):
    docs = make([(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (0, "a b c d e f", "en"), (None, "p q r", "en")], clash=True)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 0), (True, 0)]
    assert corpus_pipeline.near_duplicates(spark, make([], clash=True), "").count() == 0


def test_stages_on_empty_tables(spark, make):
    docs = make([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_unlike_texts_of_one_id_stay(spark, make):
    docs = make([(1, "a b c d e f", "en"), (1, "a b c d e f", "fr"), (1, "another text that is unlike it", "en"), (2, "q r s t u v", "en")])
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out.collect()) == [(1, "a b c d e f", "fr"), (1, "another text that is unlike it", "en"), (2, "q r s t u v", "en")]


def test_stages_remove_what_they_settled(spark, make, tmp_path):
    """Of stages whose results are written, only the last one's tables are left; an unwritten result keeps what it reads."""
    from pathlib import Path

    from wordloom.storage import shared_dir

    def held():
        return {p for p in Path(shared_dir(spark).removeprefix("file:")).glob("table-*") if any(p.iterdir())}

    docs = make([(i, f"a text of a few words number {i} and then some", "en") for i in range(9)], clash=False)
    first = held()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = held() - first
    corpus_pipeline.mixture(spark, docs, "").collect()
    assert not held() & last
    lazy = corpus_pipeline.near_duplicates(spark, docs, "")
    assert corpus_pipeline.repeated_passages(spark, lazy, "").count() == docs.select("doc_id", "text").distinct().count()
