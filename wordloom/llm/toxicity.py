"""Toxicity by a convolutional text classifier.

Method: hashed word embeddings, convolutions of several widths, max pooling.

1. A word's vector is the sum of the embeddings of three hashed features: the
   word in lower case without trailing punctuation, and its first 4 and 5 bytes.
2. Filters of widths 1, 2 and 3 run over the words; each filter's largest
   response in the text, rectified, goes into a logistic output. As embedding and
   convolution are linear, the response of every feature to every filter is one
   table, and scoring is lookups, sums and a maximum over the whole text.
3. Training starts in numpy on the driver, on a bounded part of the labelled rows
   outside the held-out fold: at most TRAIN_DOCS of each label, of at most
   TRAIN_CHARS characters. From there all of these rows are learned, whole: each
   task descends over its rows, and the tasks' parameters are averaged by rows, in
   PASSES passes. Gradients reach the largest responses only.
4. Thresholds are calibrated per language on the quarter of the rows, by a hash of
   the id, that training does not see, from counts of logits in bins of 1/BINS. The
   language is predicted from the text's words, by a naive Bayes model over the same
   hashes that all training rows are counted in. A score is the logistic of the
   logit above its language's threshold, so that 0.5 is the threshold everywhere.

Defined results: a null or empty text has no words and gets the score of no
response at all. Rows whose label is missing are never learned from; without
labels of both kinds every score is 0. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import textblocks as T
from wordloom.llm.exchange import small_batches
from wordloom.llm.language_id import held_out
from wordloom.storage import settle

BITS = 16
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Bounds of the start: documents of each label, and characters of one.
TRAIN_DOCS = 3000
TRAIN_CHARS = 20_000
EPOCHS = 6
LEAST_STEPS = 600
BATCH = 48
LANGUAGE_BITS = 14
SEED = 20
#: Passes over all rows after the start, and the first pass's rate; the share of rows that calibrate thresholds; bins of logits for one.
PASSES, RATE, CALIBRATION, BINS = 2, 0.3, 0.25, 256
BROADCAST_LABELS = 1_000_000
PIECE = 1 << 15
_PARTS = "name string, piece int, data binary"

_OFFSETS = np.concatenate(([0], np.cumsum([w * FILTERS for w in WIDTHS])))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 3): the hashed features of each word of lower-cased text bytes."""
    last = data[ends - 1] if len(ends) else data[:0]
    mark = ((last >= 33) & (last <= 47)) | ((last >= 58) & (last <= 64)) | ((last >= 91) & (last <= 96))
    bare = np.where(mark & (ends - starts > 1), ends - 1, ends)
    columns = []
    for i, n in enumerate((None, 4, 5)):
        stop = bare if n is None else np.minimum(bare, starts + n)
        columns.append(T.mix(T.span_hashes(data, starts, stop) + np.uint64(i + 1)) >> np.uint64(64 - BITS))
    return np.stack(columns, axis=1).astype(np.int32)


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of texts: the features of all words, and the word count before each text."""
    data, offsets = T.buffers(texts)
    for first, last in T.slices(offsets):
        own = T.lower_ascii(data[offsets[first] : offsets[last]])
        starts, ends, counts = T.word_bounds(own, offsets[first : last + 1] - offsets[first])
        yield features(own, starts, ends), counts


@dataclass
class Classifier:
    table: np.ndarray  # feature to responses, (2**BITS, sum of widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: np.ndarray  # (2**LANGUAGE_BITS, languages): log-probabilities of words
    priors: np.ndarray
    thresholds: np.ndarray


def _pooled(steps: np.ndarray, bounds: np.ndarray, want_places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(texts, filters): the largest sum of each filter's steps over a text, -inf where the text is too short."""
    n = len(bounds) - 1
    best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    places = np.zeros((n, len(WIDTHS) * FILTERS), np.int64) if want_places else None
    sizes = np.diff(bounds)
    for i, width in enumerate(WIDTHS):
        some = np.flatnonzero(sizes >= width)
        if not len(some):
            continue
        base = _OFFSETS[i]
        sums = steps[:, base : base + FILTERS].copy()
        for j in range(1, width):
            sums[:-j] += steps[j:, base + j * FILTERS : base + (j + 1) * FILTERS]
        for j in range(1, width):
            sums[bounds[some + 1] - j] = -np.inf
        into = slice(i * FILTERS, (i + 1) * FILTERS)
        # reduceat runs from one start to the next; what lies between are texts too short for this width
        for short in np.flatnonzero((sizes < width) & (sizes > 0)):
            sums[bounds[short] : bounds[short + 1]] = -np.inf
        best[some, into] = np.maximum.reduceat(sums, bounds[some], axis=0)
        if want_places:
            for k in some:
                places[k, into] = bounds[k] + np.argmax(sums[bounds[k] : bounds[k + 1]], axis=0)
    return best, places


def _guess(model_words: np.ndarray, priors: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The most likely language of each text."""
    total = np.zeros((len(own) + 1, len(priors)))
    np.cumsum(model_words[own[:, 0] >> (BITS - LANGUAGE_BITS)], axis=0, out=total[1:])
    return np.argmax(priors + total[bounds[1:]] - total[bounds[:-1]], axis=1)


def logits(model: Classifier, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    steps = model.table[own[:, 0]]
    steps += model.table[own[:, 1]]
    steps += model.table[own[:, 2]]
    return np.maximum(_pooled(steps, bounds)[0] + model.bias, 0) @ model.out + model.out_bias


def scores(model: Classifier, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    above = logits(model, own, bounds) - model.thresholds[_guess(model.languages, model.priors, own, bounds)]
    return 1 / (1 + np.exp(-np.clip(above.astype(np.float64), -60, 60)))


def _threshold(values: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the least weight of wrong decisions, in the middle of its gap."""
    order = np.argsort(values, kind="stable")
    v, bad, w = values[order], toxic[order], weights[order]
    wrong = np.concatenate(([0], np.cumsum(np.where(bad, w, 0)))) + np.concatenate((np.cumsum(np.where(bad, 0, w)[::-1])[::-1], [0]))
    i = int(np.argmin(wrong))
    low, high = v[max(0, i - 1)], v[min(len(v) - 1, i)]
    return float(low + high) / 2


Params = dict[str, np.ndarray]  # v: embeddings, seen: their squared steps, w, b: filters, o, ob: output


def _documents(texts: pa.Array) -> list[np.ndarray]:
    return [own[a:b] for own, bounds in text_features(texts) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def begin() -> Params:
    rng, shape = np.random.default_rng(SEED), (DIMENSIONS, int(_OFFSETS[-1]))
    return {
        "v": rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32), "seen": np.full((1 << BITS, 1), 1e-6, np.float32), "w": rng.normal(0, 0.4, shape).astype(np.float32),
        "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "ob": np.full(1, -1, np.float32),
    }


def descend(params: Params, docs: list[np.ndarray], toxic: np.ndarray, rounds: int, rate: float = 1.0, seed: int = SEED) -> None:
    """Steps over all documents, some times, on params in place."""
    rng, vectors, seen = np.random.default_rng(seed), params["v"], params["seen"]
    moved = ("w", "b", "o", "ob")
    moments = {k: (np.zeros_like(params[k]), np.zeros_like(params[k])) for k in moved}
    step = 0
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            own = np.concatenate([docs[i] for i in batch] + [np.zeros((0, 3), np.int32)])
            bounds = np.concatenate(([0], np.cumsum([len(docs[i]) for i in batch]))).astype(np.int64)
            if not len(own):
                continue
            step += 1
            embedded = vectors[own[:, 0]] + vectors[own[:, 1]] + vectors[own[:, 2]]
            best, places = _pooled(embedded @ params["w"], bounds, True)
            hidden = np.maximum(best + params["b"], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params["o"] + params["ob"], -30, 30)))
            d = ((p - toxic[batch]) / len(batch)).astype(np.float32)
            back = d[:, None] * params["o"] * (hidden > 0)
            grads = {"w": np.zeros_like(params["w"]), "b": back.sum(axis=0), "o": hidden.T @ d + 1e-4 * params["o"], "ob": d.sum(keepdims=True)}
            rows, steps = [], []
            for i, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    column = i * FILTERS + f
                    hit = np.flatnonzero(back[:, column])
                    for j in range(width):
                        at, to = places[hit, column] + j, _OFFSETS[i] + j * FILTERS + f
                        g = back[hit, column]
                        grads["w"][:, to] = g @ embedded[at]
                        rows.append(own[at])
                        steps.append(g[:, None] * params["w"][:, to])
            rows, steps = np.concatenate(rows), np.concatenate(steps)
            kinds, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(kinds), DIMENSIONS), np.float32)
            np.add.at(total, where.ravel(), np.repeat(steps, 3, axis=0))
            seen[kinds] += (total**2).mean(axis=1, keepdims=True)
            vectors[kinds] -= 0.1 * rate * total / np.sqrt(seen[kinds])
            for k in moved:
                first, second = moments[k]
                first += 0.1 * (grads[k] - first)
                second += 0.01 * (grads[k] ** 2 - second)
                params[k] -= 0.01 * rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)


def _summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sums of what tasks send as parts(name, piece, data): doubles in pieces of PIECE, as many as a model has, whatever the input's size."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("data"))
        return pa.table({"name": [key[0].as_py()], "piece": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    pieces = sorted(((r["name"], r["piece"], bytes(r["data"])) for r in parts.groupBy("name", "piece").applyInArrow(add, _PARTS).collect()), key=lambda r: r[:2])
    return {name: np.concatenate([np.frombuffer(x, np.float64) for n, _, x in pieces if n == name]) for name in {n for n, _, _ in pieces}}


def _sent(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    rows = [(name, i, flat[at : at + PIECE].tobytes()) for name, a in arrays.items() for flat in [a.astype(np.float64).ravel()] for i, at in enumerate(range(0, len(flat), PIECE))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["name", "piece", "data"])


def _learn(shared, names: list[str], rounds: int, rate: float):
    """A task's own descent over its rows from the shared parameters, and its counts of words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, n, words = {k: v.copy() for k, v in shared.value.items()}, 0, np.zeros((1 << LANGUAGE_BITS, len(names)))
        texts = np.zeros(len(names))
        for batch in batches:
            docs = _documents(batch.column("text"))
            for own, lang in zip(docs, batch.column("lang").to_pylist(), strict=True):
                np.add.at(words, (own[:, 0] >> (BITS - LANGUAGE_BITS), names.index(lang)), 1)
                texts[names.index(lang)] += 1
            descend(params, docs, batch.column("toxic").to_numpy(), rounds, rate, SEED + n)
            n += len(docs)
        if n:
            yield _sent({k: v * float(n) for k, v in params.items()} | {"words": words, "texts": texts, "n": np.array([n])})

    return run


def _cuts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        for batch in batches:
            toxic, at = batch.column("toxic").to_numpy(), 0
            for own, bounds in text_features(batch.column("text")):
                bins = np.floor(BINS * np.clip(logits(model, own, bounds), -60, 60)).astype(np.int32)
                guess = _guess(model.languages, model.priors, own, bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(guess), pa.array(bins), pa.array(toxic[at : at + len(bins)].astype(np.int32))], ["guess", "bin", "toxic"])
                at += len(bins)

    return run


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, lang, text, turn) of all labelled texts outside the held-out fold; turn, from 0 to 1, is fixed by the id."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(5, 0))
    known = known.withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30))
    # labels are a few bytes a row; up to this many are sent to the texts, which else are shuffled
    known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    return own.where(F.length("text") >= 1).join(known, "doc_id").select("toxic", "lang", "text", "turn")


def first_rows(rows: DataFrame) -> list:
    """A bounded part of labelled rows, from which the descent over all of them starts."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.create_map(*(F.lit(x) for k in (0, 1) for x in (k, min(1.0, 1.2 * TRAIN_DOCS / counts.get(k, 1)))))
    rank = (F.col("turn") - CALIBRATION) / (1 - CALIBRATION)
    some = rows.where((rank < F.element_at(share, F.col("toxic"))) & (F.length("text") <= TRAIN_CHARS)).limit(4 * TRAIN_DOCS).collect()
    some = sorted(some, key=lambda r: (r["turn"], r["text"]))
    return [r for k in (0, 1) for r in [x for x in some if x["toxic"] == k][:TRAIN_DOCS]]


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """A classifier learned from all labelled rows outside the held-out fold; none without both labels."""
    spark = docs.sparkSession
    every = settle(labelled(docs, labels))
    rows, kept = every.where(F.col("turn") >= CALIBRATION), every.where(F.col("turn") < CALIBRATION)
    if rows.select("toxic").distinct().count() < 2:
        return None
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    first = first_rows(rows)
    params, start = begin(), _documents(pa.array([r["text"] for r in first], pa.string()))
    descend(params, start, np.array([r["toxic"] for r in first]), max(EPOCHS, -(-LEAST_STEPS // max(1, len(start) // BATCH))))
    for step in range(PASSES):
        found = _summed(rows.select("toxic", "lang", "text").mapInArrow(_learn(spark.sparkContext.broadcast(params), names, 1, RATE / (step + 1)), _PARTS))
        params = {k: (found[k] / found["n"]).astype(np.float32).reshape(v.shape) for k, v in params.items()}
    counts = found["words"].reshape(-1, len(names)) + 0.1
    model = Classifier((params["v"] @ params["w"]).astype(np.float32), params["b"], params["o"], float(params["ob"][0]), np.log(counts / counts.sum(axis=0)), np.log(found["texts"] / found["texts"].sum()), np.zeros(len(names)))
    bins = kept.select("toxic", "text").mapInArrow(_cuts(spark.sparkContext.broadcast(model)), "guess int, bin int, toxic int").groupBy("guess", "bin", "toxic").count().collect()
    guess, at, toxic, n = (np.array([r[i] for r in bins]) for i in range(4)) if bins else (np.zeros(0),) * 4
    values = (at + 0.5) / BINS
    overall = _threshold(values, toxic == 1, n) if bins else 0.0
    for i in range(len(names)):
        some = guess == i
        enough = min(n[some & (toxic == 1)].sum(), n[some & (toxic == 0)].sum()) >= 20
        model.thresholds[i] = _threshold(values[some], toxic[some] == 1, n[some]) if enough else overall
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier | None = shared.value
        for batch in batches:
            if model is None:
                found = np.zeros(batch.num_rows)
            else:
                found = np.concatenate([*(scores(model, own, bounds) for own, bounds in text_features(batch.column("text"))), np.zeros(0)])
            predicted = (found >= 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array(predicted)], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); lang is read only to learn how to guess it."""
    small_batches(docs.sparkSession)
    if model is None:
        model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
