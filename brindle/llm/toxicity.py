"""Toxicity by multiple-instance learning.

A document is a bag of sentences and toxic if any of them is.  Sentences are scored by a logistic
model of their words and word beginnings, a document by noisy-or over its sentences, and the
model is fitted to labels of documents alone; its sentence scores then say where the
offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import vector
from brindle.operators.joins import join_small
from brindle.sources.shared import materialize

#: Labelled documents that the model is fitted on, about, toxic ones and others; they are chosen by a hash of doc_id.
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 8000
#: Bytes of text that the sample has, about; single texts above a 64th of it are not learnt from.
SAMPLE_BYTES = 1 << 28
#: Features that the model may use: those whose share of documents differs most between the classes.
FEATURES = 2000
LEAST_DOCS = 3
#: Beginnings of words (in bytes) that are features, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
STEPS = 600
#: Share of the features that a step of training sees, so that none relies on others being there too.
KEPT = 0.8
RATE = 0.1
DECAY = 1e-6
THRESHOLD = 0.3

_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


class Model(NamedTuple):
    keys: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float


class _Slice(NamedTuple):
    """Features of a slice of texts, each once a sentence."""

    sentence: np.ndarray  # of each feature
    key: np.ndarray
    text: np.ndarray  # of each sentence
    start: np.ndarray  # of each sentence, in bytes of the slice
    end: np.ndarray


def _features(column: pa.Array, keys: np.ndarray | None = None) -> _Slice:
    """Sentences end at ``. ! ?`` and line ends.  With ``keys`` only features among them, as their index."""
    data, offsets = vector.utf8(column)
    low = vector.lower(data)
    inside = vector.letters(data) | vector.IS_DIGIT[data]
    s_start, s_end = vector.runs(~_STOP[data], offsets)
    w_start, w_end = vector.runs(inside, offsets)
    sentence = np.searchsorted(s_start, w_start, side="right") - 1
    hasher = vector.Hasher(low)
    found = []
    for length in (0, *PREFIXES):
        if length:
            long = w_end - w_start > length
            a, s = w_start[long], sentence[long]
            key = hasher(a, a + length) ^ np.uint64(length)
        else:
            key, s = hasher(w_start, w_end), sentence
        if keys is not None:
            at = vector.find(keys, key)
            key, s = at[at >= 0], s[at >= 0]
        found.append((s, key))
    s, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((key, s))
    s, key = s[order], key[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (key[1:] != key[:-1])
    return _Slice(s[new], key[new], vector.owner(s_start, offsets), s_start, s_end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature."""
    for whole in batches:
        for batch in vector.slices(whole, "text"):
            found = _features(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            text = found.text[found.sentence]
            order = np.lexsort((text, found.key))
            key, text = found.key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            key, text = key[new], text[new]
            keys, which = np.unique(key, return_inverse=True)
            counts = [np.bincount(which[toxic[text] == side], minlength=len(keys)) for side in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c, pa.int64()) for c in counts)], names=["key", "toxic", "clean"])


def _bags(keys: np.ndarray):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                found = _features(batch.column("text"), keys)
                n_sentences = np.bincount(found.text, minlength=batch.num_rows)
                first = np.cumsum(n_sentences) - n_sentences
                cut = np.searchsorted(found.text[found.sentence], np.arange(batch.num_rows + 1))
                own = found.sentence - first[found.text[found.sentence]]
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (own, found.key)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n_sentences), *lists], names=["toxic", "sentences", "own", "keys"])

    return bags


def _train(toxic: np.ndarray, sentence: np.ndarray, key: np.ndarray, text: np.ndarray, n_keys: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the labels under noisy-or, by Adam on the whole sample."""
    value = np.zeros(n_keys + 1)
    value[-1] = -4.0  # few sentences of few documents are toxic
    mean, square = np.zeros_like(value), np.zeros_like(value)
    n_docs, n_sentences = len(toxic), len(text)
    draw = np.random.default_rng(0)
    for step in range(1, STEPS + 1):
        used = draw.random(n_keys) < KEPT
        z = np.bincount(sentence, weights=(value[:-1] * used)[key], minlength=n_sentences) + value[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs)
        some = np.maximum(-np.expm1(none), 1e-9)
        # The likelihood's slope in a sentence's score: -p in clean documents, p (1 - P) / P in toxic ones.
        slope = np.where(toxic, np.exp(none) / some, -1.0)[text] * p
        gradient = np.append(np.bincount(key, weights=slope[sentence], minlength=n_keys), slope.sum()) / n_docs
        gradient[:-1] = gradient[:-1] * used - DECAY * value[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        value += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return value[:-1], float(value[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, features: int = FEATURES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) names.

    Rows without a label or text are left out.  The sample has about ``sample_toxic`` and
    ``sample_clean`` labels; it is drawn from the labels alone, so only few rows are joined with the texts.
    Features are counted by Spark, and those whose shares of the two classes differ most are kept,
    up to ``features``.  What is collected are those features' places in the sample's sentences, which
    ``sample_bytes`` bounds.
    With fewer than two classes no feature is used, and every score is near that class.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    counts = {bool(r.toxic): r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("toxic") != 0, sample_toxic / counts.get(True, 1)).otherwise(sample_clean / counts.get(False, 1))
    drawn = materialize(labels.where(spot < share), "labels")
    sample = materialize(join_small(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), drawn, "doc_id"), "sample")
    n_bytes = F.octet_length("text").cast("bigint")
    sample = sample.where(n_bytes <= sample_bytes // 64)
    total = sample.agg(F.sum(n_bytes)).first()[0] or 0
    if total > sample_bytes:
        spot = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / (1 << 30)
        sample = materialize(sample.where(spot < sample_bytes / total), "sample")
    drawn = {bool(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 5.0 if drawn.get(True) else -5.0)
    found = sample.select("text", "toxic").mapInArrow(_count, "key bigint, toxic bigint, clean bigint")
    found = found.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") / max(1, drawn.get(True, 0)), F.col("clean") / max(1, drawn.get(False, 0))
    differs = F.abs(a - b) / F.sqrt(a + b)
    best = found.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).orderBy(differs.desc(), "key").limit(features)
    keys = np.sort(np.array([r.key for r in best.select("key").collect()], np.int64).view(np.uint64))
    bags = sample.select("text", "toxic").mapInArrow(_bags(keys), "toxic int, sentences bigint, own array<int>, keys array<int>").toArrow()
    sentences = bags["sentences"].to_numpy()
    first = np.cumsum(sentences) - sentences
    sizes = pa.compute.list_value_length(bags["keys"]).to_numpy()
    own = pa.compute.list_flatten(bags["own"]).to_numpy() + np.repeat(first, sizes)
    toxic = bags["toxic"].to_numpy() != 0
    weights, bias = _train(toxic, own, pa.compute.list_flatten(bags["keys"]).to_numpy(), np.repeat(np.arange(len(toxic)), sentences), len(keys))
    return Model(keys, weights, bias)


def score_sentences(model: Model, column: pa.Array) -> tuple[_Slice, np.ndarray]:
    """The sentences of some texts and the probability that each is toxic."""
    found = _features(column, model.keys)
    z = np.bincount(found.sentence, weights=model.weights[found.key], minlength=len(found.text)) + model.bias
    return found, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(found: _Slice, p: np.ndarray, n_texts: int) -> np.ndarray:
    """The probability that any sentence of a text is toxic, by text."""
    return -np.expm1(np.bincount(found.text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_texts))


def _score(shared, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                column = batch.column("text")
                found, p = score_sentences(shared.value, column)
                at = np.flatnonzero(p >= threshold)
                spots = vector.parts(column, found.start[at], found.end[at])
                cut = np.searchsorted(found.text[at], np.arange(batch.num_rows + 1)).astype(np.int32)
                offending = pa.ListArray.from_arrays(pa.array(cut), pa.array(spots, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(noisy_or(found, p, batch.num_rows)), offending], names=["doc_id", "score", "offending"])

    return score


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= ``threshold``) and offending of every row of ``docs`` (doc_id, text).

    ``offending`` are the sentences whose own probability reaches the threshold.  Null and empty
    texts and texts without a sentence have score 0.  Repeated rows are scored alike; an empty table gives an
    empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by ``fit``
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared, threshold), "doc_id bigint, score double, offending array<string>")
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(column: pa.Array) -> np.ndarray:
        found, p = score_sentences(shared.value, column)
        return noisy_or(found, p, len(column)) < threshold

    return vector.filter_texts(docs, "text", clean)
