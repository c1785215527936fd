"""Language ID by words first, and by ever shorter character n-grams for words never seen."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import vector
from brindle.operators.joins import join_small
from brindle.sources.shared import materialize

#: Labelled documents of each language that the model is fitted on, about; they are chosen by a hash of doc_id.
SAMPLE_DOCS = 2000
#: Words, and n-grams of each length, that the model keeps: each language has an equal part, its own most frequent.
WORDS = 200_000
GRAMS = 100_000
#: More labels than these are an error: the model has a number for each word or n-gram and language.
MOST_LANGUAGES = 100
LONGEST = 5
ALPHA = 0.5
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    #: By n-gram length, 0 for words: sorted hashes, and a row of log frequencies by language for each.
    keys: list[np.ndarray]
    logs: list[np.ndarray]


class _Slice(NamedTuple):
    """Distinct words of a slice of texts."""

    text: np.ndarray  # of each word: which text
    which: np.ndarray  # of each word: which distinct word
    hashes: np.ndarray  # of each distinct word
    counts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    hasher: vector.Hasher


def _words(column: pa.Array) -> _Slice:
    data, offsets = vector.utf8(column)
    low = vector.lower(data)
    start, end = vector.runs(vector.letters(data), offsets)
    hasher = vector.Hasher(low)
    hashes, first, which, counts = np.unique(hasher(start, end), return_index=True, return_inverse=True, return_counts=True)
    return _Slice(vector.owner(start, offsets), which, hashes, counts, start[first], end[first], low, hasher)


def _grams(words: _Slice, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some distinct words, and the place in ``chosen`` of each one's word."""
    start, end = words.start[chosen], words.end[chosen]
    sizes = end - start
    of = np.repeat(np.arange(len(chosen)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[of]
    heads = (words.low[at] & 0xC0) != 0x80
    at, of = at[heads], of[heads]
    if len(at) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.where(np.append(of[1:] == of[:-1], False), np.append(at[1:], 0), end[of])
    n = len(at) - length + 1
    inside = of[:n] == of[length - 1 :]
    return words.hasher(at[:n][inside], stop[length - 1 :][inside]), of[:n][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in vector.slices(whole, "text"):
            for lang in batch.column("lang").unique().to_pylist():
                texts = batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text")
                words = _words(texts)
                tables = [(words.hashes, words.counts)]
                for length in range(1, LONGEST + 1):
                    grams, of = _grams(words, np.arange(len(words.hashes)), length)
                    keys, which = np.unique(grams, return_inverse=True)
                    tables.append((keys, np.bincount(which, weights=words.counts[of], minlength=len(keys)).astype(np.int64)))
                for length, (keys, counts) in enumerate(tables):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), pa.array(np.full(n, length, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())],
                        names=["lang", "length", "key", "n"],
                    )


def _spot(key: str, seed: int) -> Column:
    """A number from 0 to 1 that looks random, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / (1 << 30)


def _sample(labelled: DataFrame, counts: DataFrame, label: str, size: int) -> DataFrame:
    """About ``size`` rows of each label, by a hash of doc_id; all of a label that has fewer.  ``counts`` has a row a label."""
    share = join_small(labelled, counts, label)
    return share.where(_spot("doc_id", 5) < F.lit(float(size)) / F.col("_n")).drop("_n")


def _most_frequent(counts: DataFrame, words: int, grams: int) -> DataFrame:
    """The (length, key) of ``counts`` (length, key, lang, n) that some language has among its own most frequent.

    Found by how many keys come how often; of keys as frequent as the last that fit, a share is taken by hash.
    """
    sizes = counts.groupBy("length", "lang", "n").agg(F.count("*").alias("_keys"))
    upto = F.sum("_keys").over(Window.partitionBy("length", "lang").orderBy(F.desc("n")))  # a row a number of occurrences
    room = F.when(F.col("length") == 0, words).otherwise(grams) - (upto - F.col("_keys"))
    cut = materialize(sizes.withColumn("_share", room / F.col("_keys")).where("_share > 0").select("length", "lang", "n", "_share"), "cut")
    return join_small(counts, cut, ["length", "lang", "n"]).where(_spot("key", 6) < F.col("_share")).select("length", "key").distinct()


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = WORDS, grams: int = GRAMS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from ``labelled`` (doc_id, text, lang).

    Rows without a language or text are left out.  Counts are made and summed by Spark, over a sample of
    about ``sample_docs`` documents a language.  Each language's most frequent words and n-grams, as many as its part of
    ``words`` and ``grams`` (of each length), become the model, with their counts in all languages; so a language with
    few documents keeps its own.  More than ``most_languages`` labels are a ValueError: they need cleaning first, and
    the size of the model, which is broadcast, is bounded by these parameters alone.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = materialize(labelled.groupBy("lang").agg(F.count("*").alias("_n")), "labels")
    n_languages = labels.limit(most_languages + 1).count()
    if n_languages > most_languages:
        raise ValueError(f"there are more than {most_languages} languages")
    rows = _sample(labelled, labels, "lang", sample_docs)
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, length int, key bigint, n bigint")
    counts = materialize(counts.groupBy("length", "key", "lang").agg(F.sum("n").alias("n")), "counts")
    sums = {(r.length, r.lang): r.n for r in counts.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in sums})
    part = max(1, n_languages)
    chosen = materialize(_most_frequent(counts, -(-words // part), -(-grams // part)), "chosen")
    entries = counts.join(chosen, ["length", "key"]).select("length", "key", "lang", "n").toArrow()
    lengths, hashes, n = (entries.column(c).to_numpy() for c in ("length", "key", "n"))
    lang = np.searchsorted(np.array(languages, object), entries.column("lang").to_numpy(zero_copy_only=False)) if languages else np.zeros(0, np.int64)
    keys, logs = [], []
    for length in range(LONGEST + 1):
        at = np.flatnonzero(lengths == length)
        own, which = np.unique(hashes[at].view(np.uint64), return_inverse=True)
        table = np.zeros((len(own), len(languages)))
        table[which, lang[at]] = n[at]
        total = np.array([sums.get((length, k), 0) for k in languages], float)
        keys.append(own)
        logs.append(np.log((table + ALPHA) / (total + ALPHA * (len(own) + 1))).astype(np.float32))
    return Model(languages, keys, logs)


def score_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the likeliest language (its index) and its share of the probability."""
    words = _words(column)
    known = vector.find(model.keys[0], words.hashes)
    scores = np.zeros((len(words.hashes), len(model.languages)), np.float32)
    scores[known >= 0] = model.logs[0][known[known >= 0]]
    open_words = np.flatnonzero(known < 0)
    for length in range(LONGEST, 0, -1):
        if not len(open_words):
            break
        grams, of = _grams(words, open_words, length)
        at = vector.find(model.keys[length], grams)
        of, at = of[at >= 0], at[at >= 0]
        found = np.bincount(of, minlength=len(open_words))
        for k in range(len(model.languages)):
            sums = np.bincount(of, weights=model.logs[length][at, k], minlength=len(open_words))
            scores[open_words, k] = sums / np.maximum(found, 1)
        open_words = open_words[found == 0]
        scores[open_words] = 0
    sums = np.stack([np.bincount(words.text, weights=scores[words.which, k], minlength=len(column)) for k in range(len(model.languages))], axis=1)
    best = sums.argmax(axis=1)
    return best, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                if model.languages:
                    best, share = score_texts(model, batch.column("text"))
                    lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
                    names = np.where(lettered, np.array(model.languages, object)[best], UNKNOWN)
                    share = np.where(lettered, share, 0.0)
                else:
                    names, share = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return predict


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script; null has none."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the share of probability, 0 to 1) of every row of ``docs`` (doc_id, text).

    A text's score for a language is the sum over its words: a known word's log frequency, or for an
    unseen word the mean over its known n-grams of the greatest length that has any.
    Null texts and texts without a letter are ``und`` with score 0, and so is all if the
    model knows no language.  Ties go to the language first by code point.
    Repeated rows are scored alike; an empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by ``fit``
    rows = docs.select("doc_id", "text", has_letter(F.col("text")).alias("lettered"))
    return rows.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")
