"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of one to three letters (separators are one symbol) that both have,
over the geometric mean of how many each has: presence, not frequency, blended over the lengths. Landmarks (a few
texts of each language) make the Nyström approximation; kernel ridge regression with targets +1 and -1, one against the
rest, is solved on the landmarks. Prediction is two matrix products for a batch: presence by landmark n-grams, then
kernel values by coefficients.

The model is fitted on a bounded sample: about ``rows_by_language`` texts of each language, by a hash of the id, and the
n-grams of those only go to the driver. ``und`` with score 0: null text, or no letter, or nothing learned. Score: the
winner's regression value, moved from [-1, 1] to [0, 1]. Null doc_id: passed through. Repeated rows: each is scored.

The score does not tell a text of none of the languages: without a common n-gram it is 0.5. What does is the share of the
text's distinct trigrams that the landmarks of the winner have. ``accepted`` asks for half the median share of the
sample's texts of that language, or for the share that all but a hundredth of them have if that is less.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import id_crc, map_texts, verdicts

SYMBOLS = 64
TRIGRAMS, BIGRAMS = SYMBOLS**3, SYMBOLS**2
SPACE = TRIGRAMS + BIGRAMS + SYMBOLS
UNDEFINED = "und"


@functools.cache
def symbols() -> np.ndarray:
    """Symbol of each code point below U+10000: 0 separator, 1 to 26 a to z, 27 to 63 other letters by a hash."""
    out = np.zeros(1 << 16, np.int32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 12) % 37
    return out


def n_grams(text: str, flags: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text, ascending. flags: SPACE false values, given back as such."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = symbols()[np.where(points < 1 << 16, points, 0)]
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    two = s[:-1] * SYMBOLS + s[1:]
    flags[two[:-1] * SYMBOLS + s[2:]] = True
    flags[two + TRIGRAMS] = True
    flags[s + (TRIGRAMS + BIGRAMS)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class LanguageModel:
    def __init__(self, languages: list[str], vocabulary: np.ndarray, landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.vocabulary, self.landmarks, self.coefficients = languages, vocabulary, landmarks, coefficients
        #: by trigram of the vocabulary and language, if a landmark has it; by language, the least share of an accepted text
        self.known, self.least_share = np.zeros((len(vocabulary), len(languages)), np.float32), np.zeros(len(languages))

    def presence(self, grams: list[np.ndarray]) -> np.ndarray:
        """By text (as n-grams) and n-gram of the vocabulary, 1 or 0."""
        place = np.full(SPACE, -1, np.int32)
        place[self.vocabulary] = np.arange(len(self.vocabulary))
        present = np.zeros((len(grams), len(self.vocabulary)), np.float32)
        for i, g in enumerate(grams):
            at = place[g]
            present[i, at[at >= 0]] = 1
        return present

    def kernel(self, grams: list[np.ndarray], present: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of texts (as n-grams) and landmarks."""
        present = self.presence(grams) if present is None else present
        return (present @ self.landmarks) / np.sqrt(np.maximum([len(g) for g in grams], 1))[:, None]

    def shares(self, grams: list[np.ndarray], present: np.ndarray) -> np.ndarray:
        """By text and language, the share of the text's trigrams that a landmark has."""
        return (present @ self.known) / np.maximum([np.searchsorted(g, TRIGRAMS) for g in grams], 1)[:, None]

    def predict(self, batch: list[str | None]) -> list[tuple[str, float]]:
        return [(y, s) for y, s, _ in self.judge(batch)]

    def judge(self, batch: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and if the text is like those of the language."""
        out: list[tuple[str, float, bool]] = []
        flags = np.zeros(SPACE, bool)
        for at in range(0, len(batch), 256):
            part = batch[at : at + 256]
            known = [has_letter(t) and bool(self.languages) for t in part]
            found = iter(())
            if any(known):
                grams = [n_grams(t, flags) for t, k in zip(part, known) if k]
                present = self.presence(grams)
                found = zip(self.kernel(grams, present) @ self.coefficients, self.shares(grams, present))
            for k in known:
                if not k:
                    out.append((UNDEFINED, 0.0, False))
                    continue
                values, shares = next(found)
                best = int(np.argmax(values))
                out.append((self.languages[best], float(np.clip((values[best] + 1) / 2, 0, 1)), bool(shares[best] >= self.least_share[best])))
        return out


def solve(languages: list[str], labels: list[str], grams: list[np.ndarray], landmarks_by_language: int, ridge: float) -> LanguageModel:
    """Ridge regression on the Nyström landmarks: the first texts of each language."""
    chosen = [i for x in languages for i in [k for k, y in enumerate(labels) if y == x][:landmarks_by_language]]
    if not chosen:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[np.searchsorted(vocabulary, grams[i]), j] = 1 / np.sqrt(max(1, len(grams[i])))
    model = LanguageModel(languages, vocabulary, marks, np.zeros((len(chosen), len(languages))))
    k = np.concatenate([model.kernel(grams[a : a + 512]) for a in range(0, len(grams), 512)]).astype(np.float64)
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1 / labels.count(y) for y in labels])[:, None]  # languages count alike
    model.coefficients = np.linalg.solve(k.T @ (weight * k) + ridge * k[chosen] + 1e-9 * np.eye(len(chosen)), k.T @ (weight * target))
    calibrate(model, labels, grams, chosen)
    return model


def calibrate(model: LanguageModel, labels: list[str], grams: list[np.ndarray], chosen: list[int]) -> None:
    """known and least_share; a landmark's own share is that of the trigrams of the language's other landmarks."""
    trigram = model.vocabulary < TRIGRAMS
    for j, y in enumerate(model.languages):
        own = [i for i in chosen if labels[i] == y]
        n = np.bincount(np.searchsorted(model.vocabulary, np.concatenate([grams[i] for i in own])), minlength=len(trigram))
        model.known[:, j] = (n > 0) & trigram
        others, twice = model.vocabulary[(n > 0) & trigram], model.vocabulary[(n > 1) & trigram]
        shares = [np.isin(g[g < TRIGRAMS], twice if i in own else others, assume_unique=True).mean() for i, g in enumerate(grams) if labels[i] == y and (g < TRIGRAMS).any()]
        model.least_share[j] = min(np.median(shares) / 2, np.quantile(shares, 0.01)) if shares else 0.0


def train(rows: DataFrame, rows_by_language: int = 600, landmarks_by_language: int = 24, ridge: float = 1e-3) -> LanguageModel:
    """From (doc_id, text, lang), rows with null text or lang left out."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = F.lit(False)
    for lang, n in sorted(counts.items()):
        share = share | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1, rows_by_language / n))))

    def grams_of(langs, batch):
        flags = np.zeros(SPACE, bool)
        return ((y, n_grams(t, flags).tolist()) for y, t in zip(langs, batch) if has_letter(t))

    sample = sorted(map(tuple, map_texts(rows.where(share), "lang string, grams array<int>", grams_of, first="lang").collect()))
    # a fixed shuffle, so that landmarks are not the texts that sort first
    order = np.random.default_rng(5).permutation(len(sample))
    labels = [sample[i][0] for i in order]
    return solve(sorted(set(labels)), labels, [np.array(sample[i][1], np.int64) for i in order], landmarks_by_language, ridge)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x their n-grams: bounded by the sample

    def rows(ids, batch):
        return ((i, y, s) for i, (y, s) in zip(ids, shared.value.predict(batch)))

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, lang_pred string, score double", rows)


def accepted(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is identified with a score of least or more and that are like the
    sample's texts of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(values: pa.Array) -> pa.Array:
        return verdicts(values, lambda part: [y != UNDEFINED and s >= least and like for y, s, like in shared.value.judge(part)])

    return docs.where(known("text"))


def training_rows(docs: DataFrame, fold: Column | None = None) -> DataFrame:
    return docs.where(id_crc(4) != 2 if fold is None else fold).select("doc_id", "text", "lang")
