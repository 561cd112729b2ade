"""Toxicity by multiple-instance learning.

A document is a bag of sentences, of which only the bag has a label. A sentence's logit is a bias and the sum of its
distinct words' weights (a word's weight is that of the word itself and of its first four to seven letters, hashed);
sentence probabilities are combined by noisy-or: a document is clean if all its sentences are. Gradients of the document's
likelihood go through the noisy-or to the sentences, so the model learns which sentences offend, and ``locate`` names
them.

Fitted on a bounded sample: about ``rows_by_label`` documents of each label, by a hash of the id. Null or empty text:
no sentence, score 0. Null doc_id: passed through. Repeated rows: each is scored. A null label is no label; where a
document has several, the highest counts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Memo, held, map_texts, texts, verdicts

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
BUCKETS = 1 << 18


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first letters."""
    return [crc32(b"w" + word.encode()) % BUCKETS] + [crc32(b"p" + word[:n].encode()) % BUCKETS for n in range(4, min(len(word), 7) + 1)]


def sentences(text: str) -> Iterator[dict[str, None]]:
    """The distinct lower-case words of each sentence that has any, in order."""
    for sentence in SENTENCE.findall(text.lower()):
        words = dict.fromkeys(WORD.findall(sentence))
        if words:
            yield words


class ToxicityModel:
    """weights of hashed features and a bias; a worker holds the words' weights in a memo."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def words(self) -> Memo:
        of = self.weights.tolist()  # single values of a list come faster than those of an array
        return Memo(lambda w: sum([of[i] for i in features(w)]))

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.bias)

    def logits(self, text: str) -> np.ndarray:
        """Of the sentences with words, in order."""
        of = held(self.words).__getitem__
        return np.array([sum(map(of, words)) for words in sentences(text)], np.float64) + self.bias

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-np.logaddexp(0, self.logits(text)).sum())) if text else 0.0

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with at least that probability; the likeliest one if the document
        reaches it only by all sentences together."""
        spans = [(m.start(), m.end(), z[0]) for m in SENTENCE.finditer(text) if len(z := self.logits(m.group()))]
        found = [(a, b, float(1 / (1 + np.exp(-z)))) for a, b, z in spans]
        return [x for x in found if x[2] >= least] or sorted(found, key=lambda x: -x[2])[:1]


def fit(rows: list[tuple[str, int]], rounds: int = 160, rate: float = 0.1, decay: float = 2e-4, seen: int = 2, start: float = 0.5) -> ToxicityModel:
    """Gradient descent (Adam) on the documents' negative log-likelihood. seen: a feature must be in so many documents."""
    bias, theta = -6.0, np.zeros(BUCKETS, np.float32)
    if not rows or len({y for _, y in rows}) < 2:
        return ToxicityModel(theta, bias)
    index: dict[str, int] = {}
    word, sentence, bag = array("i"), array("i"), array("i")  # four bytes an entry: the driver holds the whole sample
    for d, (text, _) in enumerate(rows):
        for words in sentences(text or ""):
            word.extend([index.setdefault(w, len(index)) for w in words])
            sentence.extend([len(bag)] * len(words))
            bag.append(d)
    word, sentence, bag = (np.frombuffer(x, np.intc) if x else np.zeros(0, np.intc) for x in (word, sentence, bag))
    feature, count = array("i"), array("i")
    for w in index:
        own = features(w)
        feature.extend(own)
        count.append(len(own))
    feature, n_words = np.array(feature, np.intc), len(count)
    owner = np.repeat(np.arange(n_words, dtype=np.intc), np.array(count, np.intc))
    y = np.array([v for _, v in rows])
    pairs = np.unique(word * np.int64(len(rows)) + bag[sentence])  # distinct (word, document)
    toxic = y[pairs % len(rows)] == 1
    inside, outside = (np.bincount(feature, weights=np.bincount(pairs[x] // len(rows), minlength=n_words)[owner], minlength=BUCKETS) for x in (toxic, ~toxic))
    known = inside + outside >= seen
    # descent starts at the smoothed log-odds of features that speak for toxicity
    odds = np.log((inside + 0.5) / ((y == 1).sum() + 1)) - np.log((outside + 0.5) / ((y == 0).sum() + 1))
    del pairs, toxic
    importance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = known * start * np.maximum(0, odds - 1)
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, rounds + 1):
        of_word = np.bincount(owner, weights=w[feature], minlength=n_words)
        z = np.bincount(sentence, weights=of_word[word], minlength=len(bag)) + bias
        a = np.maximum(np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(rows)), 1e-9)
        slope = importance * np.where(y == 1, -np.exp(-a) / -np.expm1(-a), 1.0)  # of the loss by a document's sum
        by_sentence = slope[bag] / (1 + np.exp(-z))
        by_word = np.bincount(word, weights=by_sentence[sentence], minlength=n_words)
        g = np.bincount(feature, weights=by_word[owner], minlength=BUCKETS) * known + decay * w
        gb = by_sentence.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up = lambda first, second: rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
        w -= up(m, v)
        bias -= float(up(mb, vb))
    return ToxicityModel(w.astype(np.float32), float(bias))


def fit_calibrated(rows: list[tuple[str, int]], least: int = 40) -> ToxicityModel:
    """A fit on four fifths of the rows, its bias moved so that scores part at 0.5 in the last fifth: where recall less
    five times the rate of false alarms is best, in the middle of equally good places. With fewer than least rows of a
    label in that fifth, the bias stays."""
    fold = [crc32((t or "").encode()) % 5 for t, _ in rows]  # copies are in one fold
    last = [r for r, k in zip(rows, fold) if k == 0]
    model = fit([r for r, k in zip(rows, fold) if k])
    toxic = np.array([y for _, y in last]) == 1
    if min(toxic.sum(), (~toxic).sum()) < least:
        return model
    shifts = np.arange(-1.0, 4.01, 0.1)
    logits = [model.logits(t) for t, _ in last]
    flagged = np.array([[np.logaddexp(0, z + s).sum() >= np.log(2) for s in shifts] for z in logits])
    gain = flagged[toxic].mean(axis=0) - 5 * flagged[~toxic].mean(axis=0)
    model.bias += float(np.median(shifts[gain >= gain.max() - 1e-9]))
    return model


def train(docs: DataFrame, labels: DataFrame, rows_by_label: int = 3000) -> ToxicityModel:
    """From documents (doc_id, text) and labels (doc_id, toxic). Some hundredths more or fewer rows than stated may be
    drawn: a hash of the id decides."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(False)
    for label, n in counts.items():
        share = share | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * min(1, rows_by_label / n))))
    drawn = F.broadcast(known.where(share))  # bounded by rows_by_label
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").select("text", "toxic").collect()
    return fit_calibrated(sorted((r["text"], r["toxic"]) for r in rows))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, worst_start, worst_end: the last two are the likeliest sentence of a document predicted
    toxic, else null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def rows(ids, batch):
        own = shared.value
        for i, t in zip(ids, batch):
            s = own.score(t)
            worst = max(own.locate(t), key=lambda x: x[2]) if s >= 0.5 else (None, None)
            yield i, s, int(s >= 0.5), worst[0], worst[1]

    return map_texts(texts(docs), "doc_id long, score double, predicted int, worst_start int, worst_end int", rows)


def locate(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, starts, ends: the offending sentences of each document that is predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids, batch):
        for i, t in zip(ids, batch):
            if shared.value.score(t) >= 0.5:
                found = shared.value.locate(t, least)
                yield i, [a for a, _, _ in found], [b for _, b, _ in found]

    return map_texts(texts(docs), "doc_id long, starts array<int>, ends array<int>", rows)


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def harmless(values: pa.Array) -> pa.Array:
        return verdicts(values, lambda part: [shared.value.score(t) < 0.5 for t in part])

    return docs.where(harmless("text"))
