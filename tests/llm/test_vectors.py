"""Top-k search and embedding near-duplicates against brute force."""

import numpy as np
import pytest

from tests.llm.conftest import sorted_rows
from tests.llm.corpus import components
from wordloom.llm import embedding_dedup, topk_search

BAD = [(900, None), (901, []), (902, [1.0, None, 0.0]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, tile string")


def some(n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    own = rng.normal(size=(n, d)).astype("f4")
    own[50:90] = own[0] + rng.normal(scale=0.2, size=(40, d)).astype("f4")
    own[90:110] = own[1]
    own[110:120] = own[2] * np.arange(1, 11, dtype="f4")[:, None]
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(n), own)]


def expected_top(rows, k):
    good = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("shard", "block", "group"), [(16_384, 8192, 8), (37, 3, 2)])
def test_top_k(spark, monkeypatch, shard, block, group):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk_search, "GROUP_SHARDS", group)
    rows = some() + BAD
    assert sorted_rows(topk_search.top_k(table(spark, rows))) == sorted(expected_top(rows, 20), key=repr)


def test_threshold_bounds_every_row():
    """No row within the limits and the length exceeds the threshold, and some row reaches it."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        d = int(rng.integers(1, 6))
        limits, weights, length = rng.normal(0.3, 0.6, d), rng.uniform(0.1, 2, d), float(rng.uniform(0.1, 2))
        bound = topk_search.threshold(limits, weights, length)
        v = np.minimum(rng.normal(0, 1, (20_000, d)), limits)
        norms = np.linalg.norm(v, axis=1)
        v = v[norms <= length]
        if bound == -np.inf:
            assert not len(v)
            continue
        assert not len(v) or (v @ weights).max() <= bound + 1e-9
        low, high = 0.0, 1e6  # the best row by bisection
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if np.linalg.norm(np.minimum(limits, middle * weights)) <= length else (low, middle)
        assert bound == pytest.approx(float(np.minimum(limits, low * weights) @ weights), abs=1e-6)


def test_top_k_edges(spark):
    assert topk_search.top_k(table(spark, [])).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (20, [0.0, 0.0])]
    got = sorted_rows(topk_search.top_k(table(spark, rows)))
    assert got == [(0, 1, 1, 4096), (0, 2, 3, 4096), (0, 3, 2, 0), (0, 4, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0), (20, 4, 3, 0)]


def test_threshold_stops_early():
    """Lists with one far better row: the search must not score every row."""
    rng = np.random.default_rng(0)
    rows = rng.integers(-3, 4, size=(5000, 4))
    rows[:30] = 40
    shard = topk_search.Shard(np.arange(5000), rows)
    at, best = shard.top(10_000, np.array([5, 5, 5, 5]), 20)
    assert set(at.tolist()) == set(range(20))
    assert shard.scored < 200


def test_length_stops_before_the_lists():
    """Rows of one length: what the lists alone allow is no row, so the search ends sooner than their values say."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(20_000, 4))
    rows = np.floor(64 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    shard = topk_search.Shard(np.arange(len(rows)), rows)
    at, best = shard.top(0, rows[0], 20)
    scores = rows @ rows[0]
    order = [i for i in np.lexsort((np.arange(len(rows)), -scores)) if i][:20]
    assert sorted(at.tolist()) == sorted(order)
    assert sorted(best.tolist()) == sorted(scores[order].tolist())
    assert shard.scored < len(rows) / 2


def test_searches_look_up_scores():
    """The scores of a few queries are one product, and a search that has them touches no row."""
    rows = np.random.default_rng(2).integers(-90, 90, size=(700, 6))
    rows[3], rows[5, 2] = 0, 0
    shard = topk_search.Shard(np.arange(700), rows)
    product = shard.scores(rows[:8])
    plain = [shard.top(q, rows[q], 20) for q in range(8)]
    shard.rows = shard.floats = None
    for q, (at, best) in enumerate(plain):
        found = shard.top(q, rows[q], 20, -np.inf, product[q])
        order = [i for i in np.lexsort((np.arange(700), -(rows @ rows[q]))) if i != q][:20]
        assert sorted(found[0].tolist()) == sorted(at.tolist()) == sorted(order)
        assert sorted(found[1].tolist()) == sorted(best.tolist()) == sorted((rows @ rows[q])[order].tolist())


def test_scores_that_floats_do_not_hold_are_sums_of_whole_numbers():
    rows = np.array([[1 << 30, 1], [1 << 30, 0], [-(1 << 30), 5]], np.int64)
    shard = topk_search.Shard(np.arange(3), rows)
    assert shard.scores(rows) is None
    at, best = shard.top(0, rows[0], 2)
    assert dict(zip(at.tolist(), best.tolist(), strict=True)) == {1: 1 << 60, 2: 5 - (1 << 60)}


@pytest.mark.parametrize("tile", [8192, 40])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "SQUARE", 3)
    rows = some(seed=2)
    own = np.array([v for _, v in rows], dtype="f4").astype("f8")
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    linked = own @ own.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [i for i, _ in rows]
    found = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    expected = [(i, int(n), found[i], found[i] == i) for i, n in zip(ids, linked.sum(axis=1))]
    expected += [(i, 0, i, i is not None) for i, _ in BAD if i is not None]
    rows = rows + BAD[:-1] + [(950, [0.0] * 8)]
    expected.append((950, 0, 950, True))
    assert sorted_rows(embedding_dedup.near_duplicates(table(spark, rows))) == sorted(expected, key=repr)


def test_components_of_any_size_have_norms(spark):
    rows = [(1, [1e300, 1e300]), (2, [3e300, 3e300]), (3, [1e-300, 1e-300]), (4, [1.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted_rows(embedding_dedup.near_duplicates(frame).select("vec_id", "component_id")) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicate_edges(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [2.0]), (4, [-0.0, 1.0]), (6, [0.0, 1.0]), (None, [1.0, 0.0]), (None, None)]
    assert sorted_rows(embedding_dedup.near_duplicates(table(spark, rows))) == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (4, 1, 4, True), (6, 1, 4, False), (None, 0, None, False), (None, 0, None, False)], key=repr)


@pytest.mark.parametrize(("value", "size"), [(0, 1), (127, 1), (-128, 1), (128, 2), (-129, 2), (1 << 15, 4), (-(1 << 31), 4), (1 << 31, 8), (-(1 << 62), 8)])
def test_rows_travel_in_the_narrowest_type(value, size):
    rows = np.array([[0, value], [1, -1]], np.int64)
    data = topk_search.narrow(rows)
    assert len(data) == 1 + 4 * size
    assert (topk_search.widened(data, 2) == rows).all()


def test_no_rows_travel():
    assert topk_search.widened(topk_search.narrow(np.zeros((0, 3), np.int64)), 3).shape == (0, 3)
