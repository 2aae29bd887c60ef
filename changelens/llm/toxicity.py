"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a probability from a logistic model over its
words' hashed features; the document's score is their noisy-or, one minus the product of the
sentences' complements.  Only document labels are known, so the sentence model is trained through the
noisy-or, and the sentences that carry a document's label are located afterwards.

Learning and scoring count the same things: a sentence counts once however often it is repeated, and one
without any feature that the model weighs has probability 0, so that length alone makes nothing toxic.
Weights are never negative: a word can speak for toxicity, none against it.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import released, texts, tune
from changelens.llm.sampling import fold, labelled_sample

#: Hashed features, labelled documents that are fitted at most, folds and the held-out one.
BUCKETS = 1 << 18
FIT_DOCS = 6000
FOLDS, HELD = 5, 0
#: A word's features beside itself: its beginnings of these lengths.
BEGINNINGS = (3, 4, 5)
SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = "\"'()[]{}<>,;:*#$%&|-–_+=/\\…¡¿«»“”‘’"
CACHE_WORDS = 200_000
#: A feature is kept if it stands in LEAST labelled documents, and this many times as often in toxic ones as in others.
LEAST, RATIO = 2, 3.0


def word_features(word: str) -> list[int]:
    w = word.lower().strip(EDGE)
    if not w:
        return []
    own = [w] + ["^" + w[:n] for n in BEGINNINGS if len(w) > n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in own]


class Features(dict):
    """Word -> features, bounded."""

    def __missing__(self, word: str):
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = word_features(word)
        return out


def sentence_keys(text: str) -> dict[str, None]:
    """A text's distinct sentences in order, in lower case with single spaces; those of edge marks alone left out."""
    keys = dict.fromkeys(" ".join(s.split()) for s in SENTENCE.findall(text.lower()))
    return {k: None for k in keys if k.strip(EDGE + " ")}


def _bags(batches):
    """Each document's distinct sentences as sorted distinct features."""
    known = Features()
    for b in batches:
        flat, ends = [], []
        for text in b.column("text").to_pylist():
            bags = [sorted({f for w in s.split() for f in known[w]}) for s in sentence_keys(text)]
            flat.append(np.array([f for s in bags for f in s], "<i4").tobytes())
            ends.append(np.cumsum([len(s) for s in bags]).astype("<i4").tobytes())
        yield pa.record_batch(
            [b.column("y"), pa.array(flat, pa.binary()), pa.array(ends, pa.binary())], names=["y", "flat", "ends"]
        )


# ---------------------------------------------------------------------------------- the model
class Problem:
    """The negative log-likelihood of document labels under noisy-or over the kept features' sentences."""

    def __init__(self, bags: list[tuple[int, np.ndarray, np.ndarray]], kept: np.ndarray, l2: float = 5e-5):
        self.y = np.array([b[0] for b in bags], np.float64)
        self.kept, self.l2 = kept, l2
        column = np.full(BUCKETS, -1)
        column[kept] = np.arange(len(kept))
        doc, rows, cols, n = [], [], [], 0
        for d, (_, flat, ends) in enumerate(bags):
            c = column[flat]
            s = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            has = c >= 0
            used, at = np.unique(s[has], return_inverse=True)
            doc.append(np.full(len(used), d))
            rows.append(at + n)
            cols.append(c[has])
            n += len(used)
        none = [np.zeros(0, np.int64)]
        self.doc, self.rows, self.cols, self.n = np.concatenate(none + doc), np.concatenate(none + rows), np.concatenate(none + cols), n
        # toxic documents are few: each counts as the root of how many others there are for it
        self.cost = np.where(self.y == 1, ((1 - self.y).sum() / max(1.0, self.y.sum())) ** 0.5, 1.0)

    def loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """(value, gradient by weights, gradient by the bias).  Of a document, the sum over its sentences of
        log(1 + exp(z)) is minus the log of the probability that none is toxic."""
        z = bias + np.bincount(self.rows, w[self.cols], minlength=self.n)
        total = np.maximum(np.bincount(self.doc, np.logaddexp(0.0, z), minlength=len(self.y)), 1e-12)
        each = np.where(self.y == 1, -np.log(-np.expm1(-total)), total) * self.cost
        slope = np.where(self.y == 1, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) * self.cost
        dz = slope[self.doc] / (1 + np.exp(-z))
        dw = np.bincount(self.cols, dz[self.rows], minlength=len(self.kept)) / len(self.y) + self.l2 * w
        return each.mean() + 0.5 * self.l2 * float(w @ w), dw, dz.sum() / len(self.y)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 100, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """``(label, features, sentence ends)`` of documents -> (weights, bias).

    Features kept are those of LEAST documents at least that are RATIO times as common in toxic documents as in
    others; all others weigh nothing.  Without labels of both kinds no feature weighs anything.
    """
    bags = [b for b in bags if len(b[2])]
    y = np.array([b[0] for b in bags], np.float64)
    weights = np.zeros(BUCKETS)
    if not len(y) or y.min() == y.max():
        return weights, -12.0
    in_pos, in_neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, flat, _ in bags:
        (in_pos if label else in_neg)[np.unique(flat)] += 1
    ratio = ((in_pos + 0.5) / (y.sum() + 1)) / ((in_neg + 0.5) / ((1 - y).sum() + 1))
    kept = np.flatnonzero((in_pos + in_neg >= LEAST) & (ratio > RATIO))
    problem = Problem(bags, kept)
    w, bias = np.log(ratio[kept]), -7.0  # starts from the log odds of the documents
    g2_w, g2_b, m_w = np.full(len(kept), 1e-8), 1e-8, np.zeros(len(kept))
    for _ in range(rounds):
        _, dw, db = problem.loss(w, bias)
        g2_w = 0.9 * g2_w + 0.1 * dw * dw
        g2_b = 0.9 * g2_b + 0.1 * db * db
        m_w = 0.8 * m_w + 0.2 * dw
        w = np.maximum(w - rate * m_w / np.sqrt(g2_w), 0.0)
        bias -= rate * db / math.sqrt(g2_b)
    weights[kept] = w
    return weights, float(min(bias, 0.0))


class Scorer:
    """Sentence and document probabilities of a fitted model."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, tuple] = {}

    def _word(self, word: str) -> tuple:
        """The word's features that weigh something, with their weights; () for most words."""
        w = self.weights
        return tuple((f, w[f]) for f in set(word_features(word)) if w[f])

    def logit(self, sentence: str) -> float | None:
        """Of a sentence in lower case; None without a feature that weighs something."""
        cache, hit = self.cache, None
        for word in sentence.split():
            own = cache.get(word)
            if own is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                own = cache[word] = self._word(word)
            if own:
                hit = hit or {}
                hit.update(own)
        return self.bias + sum(hit.values()) if hit else None

    def document(self, text: str) -> float:
        total = 0.0
        for s in {" ".join(x.split()) for x in SENTENCE.findall(text.lower())}:
            z = self.logit(s)
            if z is not None:
                total += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        return -math.expm1(-total)

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at ``least`` or above, repeats too, in code points."""
        found = []
        for m in SENTENCE.finditer(text):
            z = self.logit(m[0].lower())
            p = 0.0 if z is None else 1 / (1 + math.exp(-z))
            if p >= least:
                found.append((m.start(), m.end(), p))
        return found


# ------------------------------------------------------------------------------- the operator
def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    tune(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD, False, most)
    rows = sample.select("doc_id", "y", "text").mapInArrow(_bags, "y int, flat binary, ends binary").collect()
    return fit([(r.y, np.frombuffer(r.flat, "<i4"), np.frombuffer(r.ends, "<i4")) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], spans: bool = False) -> DataFrame:
    """``doc_id, score`` and, if asked for, ``sentences array<struct<start,end,score>>``: those of 0.5 or more, or of
    a document that scores 0.5 or more without one, the likeliest.

    Null and empty texts have no sentence and score 0.  Very long texts are scored whole.  One row per input row.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        s = Scorer(*shared.value)
        for b in batches:
            all_texts = b.column("text").to_pylist()
            points = [s.document(t) for t in all_texts]
            cols = [b.column("doc_id"), pa.array(points, pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                # no sentence reaches one half in a document that doesn't
                found = [(s.offending(t) or [max(s.offending(t, 0.0), key=lambda x: x[2])]) if p >= 0.5 else [] for t, p in zip(all_texts, points)]
                cols.append(pa.array([[dict(zip(("start", "end", "score"), x)) for x in f] for f in found], kind))
            yield pa.record_batch(cols, names=["doc_id", "score", "sentences"][: len(cols)])

    schema = "doc_id long, score double"
    return texts(docs).mapInArrow(released(run), schema + (", sentences array<struct<start:long,end:long,score:double>>" if spans else ""))


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = False, most: int = FIT_DOCS) -> DataFrame:
    """Fit and score: ``doc_id, held_out, score, predicted[, sentences]``, one row per input row.

    A null doc_id is not held out.  Without labels of both kinds every score is 0.  Repeated rows score
    alike; other columns are ignored; an empty table gives an empty table.
    """
    s = score(docs, train(docs, labels, most), spans)
    held = F.coalesce(fold(s, FOLDS) == HELD, F.lit(False))
    more = ["sentences"] if spans else []
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, in one pass and with their own columns."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    at = docs.columns.index("text")

    def run(batches):
        s = Scorer(*shared.value)
        for b in batches:
            keep = [s.document(t or "") < 0.5 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
