"""Appends that happen once, whoever tries again."""

import threading

import pytest

from wordloom.sources import commits, wordlists


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def held(spark, path):
    return sorted(r["value"] for r in commits.read_batches(spark, path).collect())


def test_a_key_appends_once(spark, tmp_path):
    path, none = str(tmp_path / "list"), words(spark)
    assert wordlists.append_words(words(spark, "Alpha", "beta"), none, path, "monday") == 2
    assert wordlists.append_words(words(spark, "gamma"), none, path, "monday") == 0
    assert wordlists.append_words(words(spark, "ALPHA", "gamma"), none, path, "tuesday") == 1
    assert wordlists.append_words(words(spark, "ALPHA", "Gamma"), none, path, "wednesday") == 0
    assert held(spark, path) == ["Alpha", "beta", "gamma"]
    assert commits.batches(spark, path) == [(1, "monday"), (2, "tuesday")]
    assert commits.read_batches(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_at_the_commit(spark, tmp_path, monkeypatch, when):
    """A writer that dies between write and commit leaves nothing; one that dies after it has appended, and says so when run again."""
    path, real = str(tmp_path / "list"), commits._commit

    def dying(*where):
        if when == "after":
            real(*where)
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_commit", dying)
    with pytest.raises(KeyboardInterrupt):
        wordlists.append_words(words(spark, "alpha"), words(spark), path, "job 7")
    monkeypatch.setattr(commits, "_commit", real)
    assert held(spark, path) == ([] if when == "before" else ["alpha"])
    assert wordlists.append_words(words(spark, "alpha"), words(spark), path, "job 7") == (1 if when == "before" else 0)
    assert held(spark, path) == ["alpha"]
    commits.sweep(spark, path)
    assert held(spark, path) == ["alpha"]


def test_killed_while_writing(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "list"), commits._stage

    def dying(*args):
        real(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_stage", dying)
    with pytest.raises(KeyboardInterrupt):
        wordlists.append_words(words(spark, "alpha"), words(spark), path, "k")
    monkeypatch.setattr(commits, "_stage", real)
    assert wordlists.append_words(words(spark, "alpha"), words(spark), path, "k") == 1
    assert held(spark, path) == ["alpha"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second is refused its number, looks again, and appends only what is new."""
    path, real, told = str(tmp_path / "list"), commits._stage, []

    def overtaken(rows, at, key):
        folder = real(rows, at, key)
        if key == "slow" and not told:
            told.append(wordlists.append_words(words(spark, "alpha", "beta"), words(spark), path, "fast"))
        return folder

    monkeypatch.setattr(commits, "_stage", overtaken)
    assert wordlists.append_words(words(spark, "Alpha", "gamma"), words(spark), path, "slow") == 1
    assert told == [2]
    assert held(spark, path) == ["alpha", "beta", "gamma"]


def test_many_writers(spark, tmp_path):
    path, counts = str(tmp_path / "list"), []

    def write(i):
        counts.append(wordlists.append_words(words(spark, "shared", f"own{i}"), words(spark), path, f"writer {i}"))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(spark, path) == ["own0", "own1", "own2", "own3", "shared"]
    assert sorted(counts) == [1, 1, 1, 2]
    assert [n for n, _ in commits.batches(spark, path)] == [1, 2, 3, 4]


def test_corrections(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "typo string, fix string")
    none = spark.createDataFrame([], "typo string, fix string")
    assert wordlists.append_corrections(pairs(("teh", "the"), ("wrod", "word")), none, path, "a") == 2
    assert wordlists.append_corrections(pairs(("TEH", "the"), ("wrod", "world")), none, path, "b") == 1
    assert {tuple(r) for r in wordlists.read_corrections(commits.read_batches(spark, path)).collect()} == {("teh", "the"), ("wrod", "world")}
