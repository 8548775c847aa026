"""Language identification by character language models.

Method: one interpolated Kneser-Ney model of characters per language.

1. Training counts come from labelled documents: of each language, documents in
   an order fixed by a hash of the id until sample_chars() characters are reached.
   Every language that has a label is learned, however many there are; as the
   model holds a column per language, the more there are the less text of each is
   taken, so that its size stays near MODEL_CELLS. All orders up to ORDER are
   counted; below the highest, Kneser-Ney counts distinct left contexts instead
   of occurrences. Absolute discounts are estimated per order from the numbers of
   n-grams seen once and twice.
2. The interpolated probability of every n-gram that any language has seen, and
   the backoff weight of every context, are computed once and stored in arrays
   sorted by n-gram hash, one column per language. Their size is bounded by the
   training bound, so they can be sent to every task.
3. Scoring looks each position's longest n-gram up by binary search, falls back
   order by order for those that no language has, and sums log-probabilities per
   text. The language with the lowest cross-entropy per character wins. The score
   is the softmax of the mean log-probabilities, scaled by the root of the length.
4. Rejection is calibrated on texts that training does not see, one in
   CALIBRATE of the sample. A text of n symbols is rejected if it has no letter, or
   if its best cross-entropy exceeds a + b / sqrt(n): a is REJECT_FACTOR times the
   largest cross-entropy of the language's calibration texts, and b the least with
   which no piece of them, whatever its length, is rejected. So the margin widens
   for short texts by what short pieces of the language need.

Letters are lower-cased, runs of white space are one space, digits are one
symbol. Whole texts are scored.

Defined results: a null text, or one without any letter, is `und` with score 0
and is rejected. Without any training text every text is `und`. Null languages
are never learned. Of a training document longer than its language's whole sample,
so many characters are read. A language without a calibration text has the widest
limits of all others, or none. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from wordloom.llm import textblocks as T
from wordloom.llm.exchange import loose, packed, small_batches

UNKNOWN = "und"
ORDER = 4
#: Bounds of the labelled sample: characters of a language at most and at least, and entries of the model.
TRAIN_CHARS = 400_000
LEAST_CHARS = 16
MODEL_CELLS = 1 << 24
#: One text in so many calibrates rejection; from each language, so many pieces of each length at most.
CALIBRATE = 5
PIECES = 200
PIECE_SYMBOLS = (2, 4, 8, 16, 32, 64)
REJECT_FACTOR = 1.5
_SYMBOLS = 21  # bits of a code point


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


_CLASSES = np.zeros(0, np.uint32)


def _classes() -> np.ndarray:
    """For each code point the symbol that stands for it: lower case, one space, one digit."""
    global _CLASSES
    if not len(_CLASSES):
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            low = ch.lower()
            table[c] = 32 if ch.isspace() else 48 if ch.isdigit() else ord(low) if len(low) == 1 else c
        table[0x3000] = 32
        _CLASSES = table
    return _CLASSES


def symbols(text: str) -> np.ndarray:
    """The symbols of a text between two spaces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.concatenate(([32], _classes()[points], [32])).astype(np.uint64)
    return out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(own: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each symbol from the n-th on."""
    if len(own) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(T.WORD_BASE) + own[i : len(own) - n + 1 + i]
    return out


def grams_at(own: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at the given symbols."""
    out = np.full(len(ends), n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(T.WORD_BASE) + own[ends - (n - 1 - i)]
    return out


@dataclass
class Model:
    """hashes[n]: sorted n-gram hashes; probs[n][i, l]: the interpolated probability in language l, whether seen there or not.

    backoff[n]: for sorted context hashes of n symbols, the weight with which each language falls back.
    """

    languages: list[str]
    hashes: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray  # (languages, 2): a and b of the rejection limit a + b / sqrt(n)


def _order(own: list[np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """All n-grams of some texts, with the hash of context (all but the last symbol) and of suffix (all but the first)."""
    whole = [grams(s, n) for s in own]
    context = [grams(s[:-1], n - 1) if n > 1 else np.zeros(len(s), np.uint64) for s in own]
    suffix = [grams(s[1:], n - 1) if n > 1 else np.zeros(len(s), np.uint64) for s in own]
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.uint64)])
    keys, first, counts = np.unique(join(whole), return_index=True, return_counts=True)
    return keys, counts, join(context)[first], join(suffix)[first]


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models of some languages' texts."""
    languages = sorted(texts)
    per = []
    for language in languages:
        own = [symbols(t) for t in texts[language]]
        levels = [_order(own, n) for n in range(1, order + 1)]
        tables = []
        for n in range(1, order + 1):
            keys, counts, context, _ = levels[n - 1]
            if n < order:  # continuation counts: distinct symbols to the left
                above = levels[n][3]
                kinds, lefts = np.unique(above, return_counts=True)
                at = np.searchsorted(kinds, keys)
                at[at == len(kinds)] = 0
                counts = np.where(len(kinds) and kinds[at] == keys, lefts[at], 1) if len(kinds) else np.ones_like(counts)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            heads, where = np.unique(context, return_inverse=True)
            totals = np.bincount(where, weights=counts, minlength=len(heads))
            fan = np.bincount(where, minlength=len(heads))
            tables.append((keys, np.maximum(counts - discount, 0) / totals[where], heads, discount * fan / totals))
        per.append(tables)
    n_languages = len(languages)
    hashes, probs, contexts, backoff = [], [], [], []
    all_keys = {n: np.unique(np.concatenate([t[n - 1][0] for t in per])) for n in range(1, order + 1)}
    vocabulary = len(all_keys[1]) + 1
    below: tuple[np.ndarray, np.ndarray] | None = None
    suffixes: dict[int, np.ndarray] = {}
    heads_of: dict[int, np.ndarray] = {}
    everything = [symbols(t) for language in languages for t in texts[language]]
    for n in range(2, order + 1):
        keys, _, context, suffix = _order(everything, n)
        suffixes[n], heads_of[n] = suffix, context
        assert np.array_equal(keys, all_keys[n])
    floor = np.zeros(n_languages)
    for n in range(1, order + 1):
        keys = all_keys[n]
        own = np.zeros((len(keys), n_languages))
        heads = np.unique(np.concatenate([t[n - 1][2] for t in per]))
        weight = np.ones((len(heads), n_languages))
        for i, t in enumerate(per):
            own[np.searchsorted(keys, t[n - 1][0]), i] = t[n - 1][1]
            weight[np.searchsorted(heads, t[n - 1][2]), i] = t[n - 1][3]
        if n == 1:
            floor = weight[0] / vocabulary
            lower, share = np.full((len(keys), n_languages), 1 / vocabulary), weight[np.zeros(len(keys), np.int64)]
        else:
            lower, share = below[1][np.searchsorted(below[0], suffixes[n])], weight[np.searchsorted(heads, heads_of[n])]
        below = keys, own + share * lower
        hashes.append(keys)
        probs.append(np.log(below[1]).astype(np.float32))
        contexts.append(heads)
        backoff.append(np.log(weight).astype(np.float32))
    return Model(languages, hashes, probs, contexts, backoff, np.log(floor), np.full((n_languages, 2), np.inf))


def calibrated(model: Model, texts: dict[str, list[str]]) -> Model:
    """The model with limits from texts that it was not trained on."""
    limits = np.full((len(model.languages), 2), np.nan)
    for i, language in enumerate(model.languages):
        own = [t for t in texts.get(language, ()) if has_letter(t)]
        if not own:
            continue
        whole = REJECT_FACTOR * max(-sums[i] / n for sums, n in score(model, own))
        whole_text, margin = " ".join(own), 0.0
        for size in PIECE_SYMBOLS:
            step = max(size, len(whole_text) // PIECES)
            pieces = [p for at in range(0, len(whole_text), step) if has_letter(p := whole_text[at : at + size])]
            for sums, n in score(model, pieces):
                margin = max(margin, (-sums[i] / n - whole) * np.sqrt(n))
        limits[i] = whole, margin
    known = ~np.isnan(limits[:, 0])
    limits[~known] = limits[known].max(axis=0) if known.any() else np.inf
    model.limits = limits
    return model


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _log_probs(model: Model, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(symbols, languages): the log-probability of each symbol after those before it in its text."""
    order = len(model.hashes)
    out = np.zeros((len(own), len(model.languages)), np.float32)
    missed = np.ones(len(own), bool)
    if len(own) >= order:
        at, hit = _find(model.hashes[-1], grams(own, order))
        for start in bounds[1:-1]:
            hit[max(0, start - order + 1) : start] = False  # these would end in one text and start in another
        out[order - 1 :] = model.probs[-1][at]
        missed[order - 1 :] = ~hit
    left = np.flatnonzero(missed)
    out[left] = 0
    depth = left - bounds[np.searchsorted(bounds, left, side="right") - 1] + 1  # the longest n-gram inside the text
    for n in range(order, 0, -1):
        deep = depth >= n
        mine = left[deep]
        at, hit = _find(model.hashes[n - 1], grams_at(own, n, mine))
        out[mine[hit]] += model.probs[n - 1][at[hit]]
        lost = mine[~hit]
        if n > 1:
            at, known = _find(model.contexts[n - 1], grams_at(own, n - 1, lost - 1))
            out[lost[known]] += model.backoff[n - 1][at[known]]
        else:
            out[lost] += model.floor.astype(np.float32)
        depth = np.concatenate((depth[deep][~hit], depth[~deep]))
        left = np.concatenate((lost, left[~deep]))
    return out


def score(model: Model, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """(summed log-probability per language, symbols) of each whole text."""
    group: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, int]]:
        bounds = np.concatenate(([0], np.cumsum([len(g) for g in group])))
        logs = _log_probs(model, np.concatenate(group), bounds)
        sums = np.add.reduceat(logs.astype(np.float64), bounds[:-1], axis=0)
        for total, g in zip(sums, group, strict=True):
            yield total, len(g)

    for text in texts:
        own = symbols(text)
        group.append(own)
        size += len(own)
        if size >= T.SLICE_BYTES // 2:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def sample_chars(languages: int) -> int:
    """Characters taken of each of so many languages."""
    return max(LEAST_CHARS, min(TRAIN_CHARS, MODEL_CELLS // languages**2))


def training_texts(docs: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Texts of each language to train and to calibrate on: a bounded sample, fixed by a hash of the id; held-out rows take no part."""
    labelled = docs.where(~held_out(3, 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("docs")).collect()
    if not counts:
        return {}, {}
    most = sample_chars(len(counts))
    # a row a language, fewer than the model's columns hold entries, so texts need no shuffle; documents enough for the sample twice over and twenty more, so that no language is sorted whole
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * most / r["chars"] + 20 / r["docs"])) for r in counts], "lang string, share double")
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    some = labelled.withColumn("turn", turn).join(F.broadcast(shares), "lang").where(F.col("turn") < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.length("text") > most, "turn", "doc_id", "text")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("nth", F.row_number().over(order)).where(F.col("before") < most)
    train_on: dict[str, list[str]] = {}
    hold: dict[str, list[str]] = {}
    for row in sorted(some.select("lang", "nth", F.substring("text", 1, most).alias("text")).collect(), key=lambda r: (r["lang"], r["nth"])):
        if has_letter(row["text"]):
            into = hold if row["nth"] % CALIBRATE == 0 else train_on
            into.setdefault(row["lang"], []).append(row["text"])
    return train_on, hold


def _predict(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            usable = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            best, scores, entropy, reject = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            for i, (sums, n) in zip(usable, score(model, [texts[i] for i in usable]), strict=True):
                means = sums / n
                top = int(np.argmax(means))
                best[i] = model.languages[top]
                scores[i] = float(1 / np.exp((means - means[top]) * np.sqrt(n)).sum())
                entropy[i] = float(-means[top])
                reject[i] = bool(entropy[i] > model.limits[top, 0] + model.limits[top, 1] * n**-0.5)
            columns = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(entropy, pa.float64()), pa.array(reject, pa.bool_())], [*carry, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of docs(doc_id, text, lang); with `carry`, also those columns as the struct `carried`."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string").alias("text")
    if model is None:
        train_on, hold = training_texts(docs.select("doc_id", text, F.col("lang").cast("string").alias("lang")))
        model = calibrated(train(train_on), hold) if train_on else None
    shared = spark.sparkContext.broadcast(model)
    own = docs.select("doc_id", held_out(3, 1).alias("held_out"), text, *([packed(docs, carry).alias("carried")] if carry is not None else []))
    kept = [c for c in own.columns if c != "text"]
    found = StructType.fromDDL("lang_pred string, score double, cross_entropy double, rejected boolean")
    schema = StructType([*(StructField(f.name, loose(f.dataType)) for f in own.schema if f.name != "text"), *found])
    return own.mapInArrow(_predict(shared, kept), schema)
