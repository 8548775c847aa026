"""Operators on documents against brute force, and their defined results for awkward rows."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import sorted_rows
from tests.llm.corpus import awkward, components, words
from wordloom.llm import bpe, exchange, mixing, packing, textblocks
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.substring_dedup import dedup_substrings

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    own = words(lower(text))
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def expected_components(rows):
    sets = {}
    for i, text in rows:
        sets[i] = sets.get(i, frozenset()) | shingles(text)
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(make, seed):
    rows = awkward(seed)
    expected = expected_components(rows)
    assert sorted_rows(jaccard_components(make(rows))) == sorted(((i, *expected[i]) for i, _ in rows), key=repr)


def test_jaccard_edges(make):
    assert jaccard_components(make([])).count() == 0
    assert sorted_rows(jaccard_components(make([(5, None), (4, "")]))) == [(4, 0, 4), (5, 0, 5)]
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    assert sorted_rows(jaccard_components(make(rows))) == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, None), (None, 0, None)], key=repr)


def test_jaccard_threshold_is_exact(make):
    """4 of 5 shingles links, 3 of 4 does not."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "p q r s t u v"), (4, "p q r s t u v w")]
    assert sorted_rows(jaccard_components(make(rows)).select("doc_id", "component_id")) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def kept(rows, k=20):
    seen, out = {}, []
    own = [(i, words(t)) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, w in own:
        for j in range(len(w) - k + 1):
            key, at = tuple(w[j : j + k]), (order(i), j)
            seen[key] = min(seen.get(key, at), at)
    for i, w in own:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] < (order(i), j):
                gone[j : j + k] = [True] * k
        text = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings(make, seed):
    rows = awkward(seed)
    got = sorted_rows(dedup_substrings(make(rows), carry=("source",)).select("doc_id", "n_words", "n_removed", "kept_sha256", "text"))
    assert got == sorted(kept(rows), key=repr)


def test_substring_edges(make):
    assert dedup_substrings(make([])).count() == 0
    long = " ".join(str(i) for i in range(30))
    rows = [(2, long), (2, long), (None, long), (7, None), (8, "")]
    assert sorted_rows(dedup_substrings(make(rows)).select("doc_id", "n_words", "n_removed")) == sorted([(2, 30, 0), (2, 30, 0), (None, 30, 30), (7, 0, 0), (8, 0, 0)], key=repr)
    negative = [(-5, long), (10**15, long)]
    assert sorted_rows(dedup_substrings(make(negative)).select("doc_id", "n_removed")) == [(-5, 0), (10**15, 30)]


def test_substrings_over_many_chunks(make, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1 << 9)
    rows = awkward(5)
    assert sorted_rows(dedup_substrings(make(rows)).select("doc_id", "n_words", "n_removed")) == sorted((r[:3] for r in kept(rows)), key=repr)
    expected = expected_components(rows)
    assert sorted_rows(jaccard_components(make(rows))) == sorted(((i, *expected[i]) for i, _ in rows), key=repr)


def thue_morse(n):
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def test_words_that_collide_under_polynomials(make):
    """Complementary Thue-Morse words agree under every polynomial modulo a power of two."""
    one, other = thue_morse(2048)
    rest = " p q r s"
    assert sorted_rows(jaccard_components(make([(1, one + rest), (2, other + rest)])).select("doc_id", "component_id")) == [(1, 1), (2, 2)]
    tail = " ".join(f"w{i}" for i in range(19))
    assert sorted_rows(dedup_substrings(make([(1, f"{one} {tail}"), (2, f"{other} {tail}")])).select("doc_id", "n_removed")) == [(1, 0), (2, 0)]
    own = bpe.Encoder(*PATHS, special_as_text=False)
    texts = [one, other]
    assert [list(ids) for ids in own.batch(pa.array(texts))] == [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def unsalted_collision(seed=1):
    """Two printable words of 16 bytes with one hash, were there no secret: of any two first halves, the second half of the other follows from the scrambling."""
    rng = np.random.default_rng(seed)
    start = textblocks.mix(np.array([16], np.uint64) * textblocks.LENGTH_BASE)
    while True:
        first, other = (rng.integers(97, 123, (200_000, 8), np.uint8).view(np.uint64).ravel() for _ in range(2))
        second = rng.integers(97, 123, (200_000, 8), np.uint8).view(np.uint64).ravel()
        needed = second ^ textblocks.mix(start ^ first) ^ textblocks.mix(start ^ other)
        shown = needed.view(np.uint8).reshape(-1, 8)
        for i in np.flatnonzero(((shown > 32) & (shown < 127)).all(axis=1)):
            a, b = (np.array(h, np.uint64).tobytes() for h in ((first[i], second[i]), (other[i], needed[i])))
            if b == b.lower():  # as op1 reads it
                return a.decode(), b.decode()


def test_words_made_to_collide(make):
    """No two words can be made alike, as each run has a secret of its own."""
    one, other = unsalted_collision()
    data = np.frombuffer((one + other).encode(), np.uint8)
    plain = textblocks.span_hashes(data, np.array([0, 16]), np.array([16, 32]))
    assert plain[0] == plain[1]
    salted = textblocks.span_hashes(data, np.array([0, 16]), np.array([16, 32]), textblocks.new_secret())
    assert salted[0] != salted[1]
    assert sorted_rows(jaccard_components(make([(1, one + " p q r s"), (2, other + " p q r s")])).select("doc_id", "component_id")) == [(1, 1), (2, 2)]
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{other} {tail}")]
    assert sorted_rows(dedup_substrings(make(rows)).select("doc_id", "n_removed")) == [(1, 0), (2, 0), (3, 20)]


def weak_hash(monkeypatch):
    monkeypatch.setattr(textblocks, "span_hashes", lambda data, starts, ends, secret=0: (data[starts] & 1).astype(np.uint64))


def test_equal_hashes_of_unequal_words(monkeypatch):
    """Where hashes collide, bytes decide: ids stay the tokenizer's, and paths that are not their source's are found."""
    from wordloom.llm import substring_dedup as S

    weak_hash(monkeypatch)
    own = bpe.Encoder(*PATHS, special_as_text=False)
    texts = ["some words of a text", "come swords or a test", "", "123 456"]
    assert [list(ids) for ids in own.batch(pa.array(texts))] == [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    asked = pa.table({"source": [1, 1], "unit": [0, 0], "digest": [b"x", b"y"], "text": ["a b c d", "a b c f"]})
    regions = pa.table({"source": [1], "unit": [0], "text": ["a b c d"]})
    bad = S._verified(3)((pa.scalar(1),), asked, regions)
    assert bad.column("digest").to_pylist() == [b"y"]
    assert np.frombuffer(bad.column("good")[0].as_py(), bool).tolist() == [True, False]


def test_documents_cut_anew(make, monkeypatch):
    """Edges that a comparison refutes go back into their documents."""
    from wordloom.llm import substring_dedup as S

    real = S._verified

    def refuting(k, *secret):
        run = real(k, *secret)

        def all_bad(key, asked, regions):
            run(key, asked, regions)
            n = [len(t.split()) - k + 1 for t in asked.column("text").to_pylist()]
            return pa.table({"source": pa.array([key[0].as_py()] * len(n), pa.int64()), "digest": asked.column("digest"), "good": pa.array([bytes(x) for x in n], pa.binary())})

        return all_bad

    monkeypatch.setattr(S, "_verified", refuting)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1 << 9)
    long = " ".join(str(i) for i in range(30))
    rows = [(i, long if i % 50 == 0 else f"{i} {i}") for i in range(200)]
    got = sorted_rows(dedup_substrings(make(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == sorted(((i, len(t.split()), 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)


def test_messages_in_levels(make, monkeypatch):
    """With fewer messages a chunk than chunks, they meet in several levels."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1 << 9)
    monkeypatch.setattr(exchange, "FAN_BITS", 3)
    assert len(exchange.levels(256)) == 3
    rows = awkward(15)
    assert sorted_rows(dedup_substrings(make(rows)).select("doc_id", "n_words", "n_removed")) == sorted((r[:3] for r in kept(rows)), key=repr)
    expected = expected_components(rows)
    assert sorted_rows(jaccard_components(make(rows))) == sorted(((i, *expected[i]) for i, _ in rows), key=repr)


def test_long_lists_in_parts(make, monkeypatch):
    """An index list over several units of work gives the same components."""
    from wordloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "LIST_ROWS", 3)
    monkeypatch.setattr(J, "BUCKET_ROWS", 64)
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(J, "UNIT_SHINGLES", 100)
    rows = awkward(16)
    expected = expected_components(rows)
    assert sorted_rows(jaccard_components(make(rows))) == sorted(((i, *expected[i]) for i, _ in rows), key=repr)


def test_nameless_documents_over_chunks(make, monkeypatch):
    """Null doc_ids are documents in an order of their own, so that no chunk holds them all: one copy of each text stays."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1 << 9)
    long = [" ".join(f"{j}.{i}" for i in range(30)) for j in range(40)]
    rows = [(None, t) for t in long] + [(None, t + " end") for t in long] + [(1, long[0])]
    got = [tuple(r) for r in dedup_substrings(make(rows)).select("doc_id", "n_words", "n_removed").collect()]
    assert (1, 30, 0) in got
    assert sum(r[2] for r in got) == 30 * 41


def test_mixing(make):
    rows = [(i, t, None, [None, "a", "B", "é", "z"][i % 5]) for i, t in awkward(6)]
    got = mixing.mix(make(rows)).toPandas()
    again = mixing.mix(make(list(reversed(rows)))).toPandas()
    columns = list(got.columns)
    assert got.sort_values(columns).reset_index(drop=True).equals(again.sort_values(columns).reset_index(drop=True))
    sizes = {i: len(words(t)) for i, t, *_ in rows}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 2 * got["size"]).all()
    by = got.merge(__import__("pandas").DataFrame([(r[0], r[3]) for r in rows], columns=["doc_id", "source"]), on="doc_id").groupby("source", dropna=False)
    for _, one in by:
        assert one.source_size.iloc[0] == one["size"].sum()
        assert one.taken.sum() == int(one.target.iloc[0])
        assert one.target.iloc[0] <= 2 * one["size"].sum()
    assert by.target.first().sum() == pytest.approx(1.5 * got["size"].sum())


def test_mixing_targets(spark):
    """Weights 3, 1, 2: the first source stops at twice its size, the rest is shared 1 to 2."""
    sizes = spark.createDataFrame([("a", 10), ("b", 500), (None, 490)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 20.0, "b": pytest.approx(1480 / 3), None: pytest.approx(2960 / 3) if 2960 / 3 < 980 else 980.0} or got == {"a": 20.0, "b": pytest.approx(500.0), None: 980.0}


def test_mixing_edges(make):
    assert mixing.mix(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix(make([(1, None), (None, "")])).collect()] == [0, 0]
    rows = [(1, "a b c d", None, "s"), (1, "a b c d", None, "s"), (None, "x", None, None)]
    assert mixing.mix(make(rows)).agg({"taken": "sum"}).first()[0] <= 14


def test_training_order(make):
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in awkward(8)]
    copies = mixing.training_order(make(rows, clash=False)).collect()
    taken = mixing.mix(make(rows)).agg({"taken": "sum"}).first()[0]
    assert sum(len(words(r["text"])) for r in copies) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in copies)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    return own


ALPHABET = [*"abZé×ßñ '\n\t.,-_12  　—́漢🙂\x1c\x85", "'s", "'ll", "<|endoftext|>", "\r\n", "  ", "\n "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=6))
def test_ids_equal_the_tokenizer(tokenizer, texts):
    got = [ids.tolist() for ids in bpe.encoder(*PATHS).batch(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(make, tokenizer):
    rows = awkward(9)
    got = packing.pack(make(rows), *PATHS).toPandas()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    assert got.length.sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, one in got.groupby("doc_id"):
        one = one.sort_values("start")
        assert (one.start == one.length.cumsum() - one.length).all()
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert (one.offset == one.length.cumsum() - one.length).all()
        assert one.length.sum() <= packing.SEQUENCE


def test_packing_leaves_little_padding():
    """Over a long-tailed histogram, what the sequences hold beyond the pieces is below 1 % of them."""
    rng = np.random.default_rng(1)
    for lengths in (np.minimum(rng.lognormal(5, 1.2, 20_000).astype(int) + 1, 2048), rng.integers(1, 2049, 20_000), np.full(5000, 683), rng.integers(1, 40, 50_000)):
        counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
        patterns = packing.pack_histogram(counts, 2048)
        assert sum(n * len(own) for n, own in patterns) == len(lengths)
        assert all(sum(own) <= 2048 for _, own in patterns)
        sequences = sum(n for n, _ in patterns)
        least = -(-int(lengths.sum()) // 2048) if len(counts) > 1 else -(-len(lengths) // (2048 // lengths[0]))
        assert sequences <= least * 1.01 + 1


@pytest.fixture(scope="module")
def unmodified():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATHS[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "<|endoftext", "|>"]), max_size=30).map("".join), max_size=6))
def test_ids_equal_the_unmodified_tokenizer(unmodified, texts):
    got = [ids.tolist() for ids in bpe.encoder(*PATHS, special_as_text=False).batch(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in unmodified.encode_batch(texts, add_special_tokens=False)]


def test_packing_special_strings(make, unmodified):
    """The string of a special token is that token; one that only two texts together have is none."""
    rows = [(1, "a<|endoftext|>b"), (2, "plain"), (3, "<|endoftext"), (4, "|>"), (5, None), (6, "<|endoftext|>" * 3), (7, "x <|endoftext|>\u00a0y")]
    ids = {i: np.array([*unmodified.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    assert ids[1].tolist() == [64, 50256, 65, 1]
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(make(rows), *PATHS).collect()}
    assert got == {i: (len(own), zlib.crc32(own.tobytes())) for i, own in ids.items()}


def test_packing_edges(make):
    assert packing.pack(make([]), *PATHS).count() == 0
    got = packing.pack(make([(1, None), (1, None), (None, "")]), *PATHS).collect()
    assert sorted((r["length"], r["offset"]) for r in got) == [(1, 0), (1, 1), (1, 2)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_histogram(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = {}
    for n, lengths in patterns:
        assert sum(lengths) <= 64
        for length in lengths:
            held[length] = held.get(length, 0) + n
    assert held == counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n\t\x0b漢 "), max_size=40), max_size=8))
def test_word_hashes(texts):
    for data in (texts, [t * 3 for t in texts]):
        found = []
        for first, last, hashes, counts in textblocks.text_words(pa.array(data, pa.string()), lower=False):
            found += [hashes[counts[i] : counts[i + 1]].tolist() for i in range(last - first)]
        assert [len(f) for f in found] == [len(words(t)) for t in data]
        flat = {(h, w) for f, t in zip(found, data) for h, w in zip(f, words(t))}
        assert len({h for h, _ in flat}) == len({w for _, w in flat}) == len(flat)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 100)] + [(200, i) for i in range(201, 240)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in exchange.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert exchange.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("chunks", "tasks"), [(16, 16), (256, 64), (1024, 256)])
def test_jaccard_tasks_grow_with_chunks(make, monkeypatch, chunks, tasks):
    """Documents are dealt evenly and once, over tasks that grow with the chunks, whatever the number of shuffle partitions."""
    from wordloom.llm import jaccard_join as J

    class Seen(Exception):
        pass

    def first(df):
        raise Seen(df.rdd.getNumPartitions(), df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(J, "settle", first)
    monkeypatch.setattr(J.X, "chunk_count", lambda size: chunks)
    with pytest.raises(Seen) as seen:
        jaccard_components(make([(i, f"w{i} a b c d e") for i in range(20)]))
    found, plan = seen.value.args
    assert found == tasks
    assert not [x for x in plan.splitlines() if "hashpartitioning(chunk" in x or "hashpartitioning(id" in x]  # nothing is dealt again


def test_one_outsider_of_a_long_list(make, monkeypatch, spark):
    """The rows of a list's units grow with its members and outsiders, not with their parts' product."""
    from wordloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "LIST_ROWS", 8)
    rows, real = [], J._meeting

    def counted(frame, left):
        out = real(frame, left)
        rows.append((left, out.count(), out.select("token").distinct().count()))
        return out

    monkeypatch.setattr(J, "_meeting", counted)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base), *(" ".join(f"v{i}" if j == i % 60 else w for j, w in enumerate(base)) for i in range(240))]  # all linked with the first
    outsider = " ".join("other" if j in (10, 40) else w for j, w in enumerate(base))  # two words from the first, which is too far
    texts = list(enumerate([*near, outsider]))
    expected = expected_components(texts)
    assert sorted_rows(jaccard_components(make(texts)).select("doc_id", "n_shingles", "component_id")) == sorted(((i, *expected[i]) for i, _ in texts), key=repr)
    (_, x_rows, x_tokens), (_, y_rows, y_tokens) = rows
    members, parts = len(texts), -(-len(texts) // 8)
    assert 0 < x_rows <= x_tokens * 4 * parts
    assert 0 < y_rows <= y_tokens * 4 * members  # and not members * parts
