"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence scores ``sigmoid(b + sum of its words' weights)``, a document scores the
noisy-or of its telling sentences and of one leak term, ``1 - (1 - leak) * product(1 - p)``. A sentence tells if its
words' weights speak for toxicity and its p is at least ``TELLING``; the others count as 0, so however many sentences a text has, they
don't add up to a rejection. What toxic documents no weight explains is in the leak, once a document. The weights are fitted to labels of whole documents
alone, through the noisy-or of all sentences with a feature, until the gradient vanishes; afterwards each sentence's own score tells
which ones offend. A word's weight is the sum over its features: the word itself, its prefixes and its suffixes. All features that
tell toxic from other documents in the training sample, for or against, carry weight, however many: those in at least ``LEAST_DOCS`` documents and with ``LEAST_Z`` standard deviations between their
rates; on the others the sample has no evidence, and their weight is 0.

The fit uses at most ``max_train_docs`` labelled documents, those with the
least seeded hashes (4,000 by default), as far as they have ``max_train_words`` words (4 million by default) together: documented, fixed bounds, so what the driver holds
doesn't grow. Executors cut their texts into sentences and words; the driver gets these as numbers of words and one list of different words, makes features some words at a time,
and gives the memory back. Every document is scored, over its whole text, in one pass without a shuffle; the model that is broadcast
has one weight for a feature of the sample at most.

Defined results: a null, empty or wordless text has no sentence and scores 0. Repeated rows score alike.
A document with several labels counts as toxic if one of them says so;
null labels and ids don't train. Without labels, or with one class only, no word
has a weight and a document with sentences scores the training rate. Other columns pass.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_chunk, cut, numbered

MAX_TRAIN_DOCS, MAX_TRAIN_WORDS = 4000, 4_000_000
#: Lengths of the prefixes and suffixes that are features.
ENDS = range(3, 7)
#: Evidence for a weight: this many documents, and this many standard deviations between the rates in toxic and other ones.
LEAST_DOCS, LEAST_Z = 3, 3.0
#: The least p of a sentence that counts in its document's score.
TELLING = 0.25
_TELLING_Z = math.log(TELLING / (1 - TELLING))
SEED = 17
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has a word."""
    found = ((m.start(), m.end(), _WORD.findall(m.group().lower())) for m in _SENTENCE.finditer(text))
    return [x for x in found if x[2]]


def features(word: str) -> set[str]:
    """``=word``, and its prefixes (``^pre``) and suffixes (``fix$``)."""
    out = {f"={word}"}
    for n in ENDS:
        if n <= len(word):
            out.add(f"^{word[:n]}")
            out.add(f"{word[-n:]}$")
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # of features
    bias: float = -4.0
    leak: float | None = None  # log-odds of the leak term; the bias if there is none


class _Weights(dict):
    """A word's weight, remembered for the words seen last."""

    def __init__(self, model: Model):
        super().__init__()
        self.of = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        self[word] = w = sum(self.of[f] for f in sorted(features(word)) if f in self.of)
        return w


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


@dataclass
class Words:
    """The words of labelled documents: of each place its word (a number in *vocabulary*) and its sentence, and of each sentence its document. All in order."""

    vocabulary: list[str]
    word: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + count - 1`` of each pair, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _hashes(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the features of each word, one after another, and their counts. Made for some words at a time: as Python's numbers those of all words would take several times as much."""
    counts, parts = np.zeros(len(vocabulary), np.int32), [np.empty(0, np.uint64)]
    for start in range(0, len(vocabulary), 4096):
        made = [[xxhash.xxh64_intdigest(f) for f in features(w)] for w in vocabulary[start : start + 4096]]
        counts[start : start + 4096] = [len(m) for m in made]
        parts.append(np.array([h for m in made for h in m], np.uint64))
    return np.concatenate(parts), counts


def telling_features(words: Words, y: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The features whose rates in toxic documents and in the others differ, in order; and pairs of a word and a place in that list."""
    hashes, counts = _hashes(words.vocabulary)
    ids, feature = np.unique(hashes, return_inverse=True)
    feature, starts, n = feature.astype(np.int32), np.cumsum(counts, dtype=np.int64) - counts, len(ids)
    del hashes
    both = words.doc[words.sentence].astype(np.int64)
    both *= len(counts)
    both += words.word
    doc, word = np.divmod(np.unique(both), len(counts))
    del both
    toxic, all_ = np.zeros(n), np.zeros(n)
    firsts = np.searchsorted(doc, np.arange(len(y) + 1))  # some documents at a time
    edges = [*firsts[:-1][np.diff(firsts[:-1] // 65_536, prepend=-1) > 0], len(doc)]
    for a, b in zip(edges, edges[1:], strict=False):
        met = np.unique(np.repeat(doc[a:b], counts[word[a:b]]) * n + feature[_spread(starts[word[a:b]], counts[word[a:b]])])
        toxic += np.bincount(met % n, y[met // n], minlength=n)
        all_ += np.bincount(met % n, minlength=n)
    of_toxic, of_other, p = toxic / y.sum(), (all_ - toxic) / (1 - y).sum(), all_ / len(y)
    z = (of_toxic - of_other) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (1 - y).sum()) + 1e-12)
    told = (all_ >= LEAST_DOCS) & (np.abs(z) > LEAST_Z)
    having = np.unique(np.repeat(np.arange(len(counts), dtype=np.int32), counts)[told[feature]]).tolist()
    kept = set(ids[told].tolist())
    pairs = [(i, f) for i in having for f in sorted(features(words.vocabulary[i])) if xxhash.xxh64_intdigest(f) in kept]
    names = sorted({f for _, f in pairs})
    number = {f: i for i, f in enumerate(names)}
    return names, np.array([i for i, _ in pairs], np.int64), np.array([number[f] for _, f in pairs], np.int64)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, sentence: np.ndarray, place: np.ndarray, doc: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The noisy-or's log loss (with half *decay* times the squared weights) and its derivatives at *x*: the weights, the bias, the leak's log-odds.

    *sentence* and *place*: the sentence and the number of each feature met; *doc*: the document of each sentence.
    """
    w, b, leak = x[:-2], x[-2], x[-1]
    z = np.clip(b + np.bincount(sentence, w[place], minlength=len(doc)), -500, 500)
    missed = np.bincount(doc, -np.logaddexp(0, z), minlength=len(y)) - np.logaddexp(0, leak)  # log of (1 - leak) * product of 1 - p
    hit = np.maximum(-np.expm1(missed), 1e-12)
    off = (hit - y) / hit / len(y)
    dz = off[doc] / (1 + np.exp(-z))
    g = np.concatenate([np.bincount(place, dz[sentence], minlength=len(w)) + decay * w, [dz.sum(), off.sum() * _sigmoid(leak)]])
    return float(-(y * np.log(hit) + (1 - y) * missed).mean() + decay / 2 * (w @ w)), g


def fit(docs: list[list[list[str]]], labels: np.ndarray, **how) -> Model:
    """``fit_words`` for documents given as their sentences' words."""
    number: dict[str, int] = {}
    sentences_ = [s for d in docs for s in d]
    word = np.array([number.setdefault(w, len(number)) for s in sentences_ for w in s], np.int64)
    sentence = np.repeat(np.arange(len(sentences_)), [len(s) for s in sentences_])
    return fit_words(Words(list(number), word, sentence, np.repeat(np.arange(len(docs)), [len(d) for d in docs])), labels, **how)


def fit_words(words: Words, labels: np.ndarray, epochs: int = 1000, rate: float = 0.1, decay: float = 1e-4, least: float = 1e-5) -> Model:
    """Full-batch Adam on the noisy-or's log loss, until no derivative is over *least* (*epochs* steps at most). Documents without a sentence don't count."""
    present, doc_of = np.unique(words.doc, return_inverse=True)
    y = np.asarray(labels, np.float64)[present]
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        return Model({}, leak=math.log(p / (1 - p)))
    names, owner, number = telling_features(Words(words.vocabulary, words.word, words.sentence, doc_of), y)
    counts = np.bincount(owner, minlength=len(words.vocabulary))
    met = counts[words.word]
    sentence, place = np.repeat(words.sentence, met), number[_spread((np.cumsum(counts) - counts)[words.word], met)]
    with_, sentence = np.unique(sentence, return_inverse=True)  # sentences with a feature
    doc = doc_of[with_]
    k, mean = len(names), float(y.mean())
    x = np.concatenate([np.zeros(k), [-4.0, math.log(mean / (1 - mean))]])  # weights, bias, leak
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, epochs + 1):
        _, g = loss_and_gradient(x, y, sentence, place, doc, decay)
        if np.abs(g).max() <= least:
            break
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * min(1.0, 300 / step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Model(dict(zip(names, x[:k].tolist(), strict=True)), float(x[k]), float(x[k + 1]))


def train(
    documents: DataFrame, labels: DataFrame, train_if: Callable[[Column], Column], max_train_docs: int = MAX_TRAIN_DOCS, label: str = "toxic", max_train_words: int = MAX_TRAIN_WORDS
) -> Model:
    """Fits a model to the labelled documents whose ``doc_id`` satisfies *train_if*.

    At most *max_train_docs* of them, by seeded hash, train, and of these the first that have *max_train_words* words together.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & train_if(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(max_train_docs)
    )
    # Of repeated rows with a chosen id, the least text trains.
    chosen = documents.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [[s for _, _, s in sentences(text or "")] for text in batch.column("text").to_pylist()]
        sizes = pa.array([sum(map(len, bag)) for bag in bags], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), sizes, pa.array(bags, pa.list_(pa.list_(pa.string())))], ["doc_id", "y", "size", "bag"])

    bags = cut(chosen.mapInArrow(by_chunk(make, 64), f"doc_id {dict(documents.dtypes)['doc_id']}, y int, size bigint, bag array<array<string>>"))
    so_far = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))  # at most max_train_docs rows
    few = bags.select("doc_id", "size").withColumn("so_far", so_far).where(F.col("so_far") <= max_train_words).select("doc_id")
    table = bags.join(few, "doc_id").select("doc_id", "y", "bag").toArrow().sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return fit([], np.zeros(0))
    y = table.column("y").to_numpy().astype(np.float64)
    words = _numbers(table.column("bag").combine_chunks())
    del table
    _give_back()
    model = fit_words(words, y)
    del words
    _give_back()
    return model


def _numbers(bag: pa.ListArray) -> Words:
    """Documents as lists of sentences of words, with numbers for the words."""
    numbers = lambda x: np.repeat(np.arange(len(x), dtype=np.int32), x.value_lengths().to_numpy(zero_copy_only=False))
    lists = bag.flatten()
    coded = lists.flatten().dictionary_encode()
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), numbers(lists), numbers(bag))


def _give_back() -> None:
    """Returns what was freed to the system: Arrow's pool and the C library keep it else, as long as the driver lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has this
        ctypes.CDLL(None).malloc_trim(0)


_RESULT = "doc_id bigint, score double, n_sentences int, n_offending int, worst_start int, worst_end int"


def score_text(text: str | None, weights: dict, bias: float, leak: float | None = None) -> tuple[float, int, int, int, int]:
    """Score; sentences; offending sentences; start and end (in characters) of the worst. Without *leak* the leak term's log-odds are *bias*."""
    miss, count, bad, worst, at = 0.0, 0, 0, -math.inf, (-1, -1)
    get = weights.__getitem__
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m.group().lower())
        if not words:
            continue
        evidence = sum(map(get, words))
        z = bias + evidence
        if evidence > 0 and z >= _TELLING_Z:
            miss += _softplus(z)
        count += 1
        bad += z >= 0
        if z > worst:
            worst, at = z, m.span()
    if count:
        miss += _softplus(bias if leak is None else leak)
    return -math.expm1(-miss), count, bad, *at


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of *documents*: doc_id, score, and where the offending sentences are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(_Weights(shared.value))
        rows = [score_text(t, cache[0], shared.value.bias, shared.value.leak) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_end"])

    cache: list[_Weights] = []
    return documents.select("doc_id", "text").mapInArrow(by_chunk(make, 1024), _RESULT)


def offending_sentences(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """A row for each sentence that scores *threshold* or more: doc_id, start, end, sentence, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, rows = _Weights(shared.value), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for start, end, words in sentences(text or ""):
                p = _sigmoid(shared.value.bias + sum(map(weights.__getitem__, words)))
                if p >= threshold:
                    rows.append((doc, start, end, text[start:end], p))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    return documents.select("doc_id", "text").mapInArrow(by_chunk(make, 1024), "doc_id bigint, start int, end int, sentence string, score double")


def held_out(doc_id) -> Column:
    """Whether labels of this document are kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(documents: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """Scores of *documents* by a model trained on the labels that aren't held out (a null id counts as not held out)."""
    model = train(train_on if train_on is not None else documents, labels, lambda c: ~held_out(c))
    rows = score(documents, model)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")


def keep(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of *documents*, with all their columns, whose text scores under *threshold*."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    cache: list[_Weights] = []

    at = documents.columns.index("text")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(_Weights(shared.value))
        return batch.filter(pa.array([score_text(t, cache[0], shared.value.bias, shared.value.leak)[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    rows = numbered(documents)
    return rows.mapInArrow(by_chunk(make, 1024), rows.schema).toDF(*documents.columns)
