"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel.  Ridge weights solve the normal equations, which partitions sum over
their rows and the driver adds up.  The raw scores of labelled rows kept out of the fit are calibrated
by isotonic regression, so that a score is a probability.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import materialise, texts, tune
from changelens.llm.sampling import fold, labelled_sample

#: Labelled documents used at most, tasks that sum the equations, folds and the held-out one.
FIT_DOCS, FIT_TASKS = 12_000, 12
FOLDS, HELD = 4, 2
FEATURES, RIDGE, SEED = 256, 1.0, 20
THRESHOLD = 0.7

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: What stands after a word's last letter or digit, if anything.
NAMES = (
    "log_chars", "log_words", "word_length", "word_spread", "distinct_words", "same_as_before", "commonest_word",
    "letters", "upper", "spaces", "digits", "common_marks", "odd_marks", "lines", "repeated_lines", "line_length",
    "ended_lines", "marked_words", "entropy", "upper_words", "bigrams", "short_words",
)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; zeros throughout for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(NAMES)
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    n = float(len(raw))
    words = text.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    index: dict[str, int] = {}
    code = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    most = np.bincount(code).max() if len(code) else 0
    same = float((code[1:] == code[:-1]).sum()) if len(code) > 1 else 0.0
    pairs = len(np.unique(code[1:] * len(index) + code[:-1])) if len(code) > 1 else 1
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = len(set(lines))
    p = counts[counts > 0] / n
    letters, upper, spaces = counts[_LETTERS].sum(), counts[_UPPER].sum(), counts[_SPACE].sum()
    digits, plain = counts[_DIGIT].sum(), counts[_PLAIN].sum()
    ended = sum(x.rstrip()[-1:] in ".!?" for x in lines)
    odd = sum(map(len, re.findall(r"[^\w\s.,;:'\"()?-]+(?=\s|$)", text)))
    big = sum(w.isupper() and len(w) > 1 for w in index)
    return [
        math.log1p(n), math.log1p(len(words)), float(size.mean()), float(size.std()), len(index) / m, same / m, most / m,
        letters / n, upper / max(1.0, letters), spaces / n, digits / n, plain / n, (n - letters - spaces - digits - plain) / n,
        math.log1p(len(lines)), 1 - distinct_lines / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        ended / max(1, len(lines)), odd / m, float(-(p * np.log(p)).sum()), big / max(1, len(index)),
        pairs / max(1, len(code) - 1), float((size <= 2).mean()),
    ]


class Basis:
    """Standardisation and random Fourier features: ``x -> sqrt(2/D) cos(xW + b)``, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = 0.22):
        r = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = r.normal(0, width, (len(mean), features))
        self.b = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        phi = np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.concatenate([phi, np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the nondecreasing fit; equal x share a value."""
    ux, at = np.unique(x, return_inverse=True)
    w = np.bincount(at).astype(np.float64)
    v = np.bincount(at, y) / w
    value, weight, last = [], [], []
    for i in range(len(ux)):
        value.append(v[i])
        weight.append(w[i])
        last.append(i)
        while len(value) > 1 and value[-2] >= value[-1]:
            both = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / both
            weight[-2] = both
            last[-2] = last[-1]
            value.pop(), weight.pop(), last.pop()
    first = np.r_[0, np.array(last[:-1], np.int64) + 1].astype(np.int64)
    # middle of each block, so that scores rise within and between blocks
    return (ux[first] + ux[last]) / 2, np.array(value)


class Model:
    def __init__(self, basis: Basis, weights: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.basis, self.weights, self.knots, self.values = basis, weights, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a little of the raw score keeps order among equal probabilities."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def _matrix(batch) -> np.ndarray:
    flat = batch.column("x").combine_chunks() if hasattr(batch.column("x"), "combine_chunks") else batch.column("x")
    return flat.flatten().to_numpy().reshape(len(flat), len(NAMES))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<double>[, y]``."""
    more = ["y"] if "y" in docs.columns else []

    def run(batches):
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            col = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.record_batch([b.column("doc_id"), col, *[b.column(c) for c in more]], names=["doc_id", "x", *more])

    schema = "doc_id long, x array<double>" + (", y int" if more else "")
    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


def _moments(batches):
    n, s, q = 0, np.zeros(len(NAMES)), np.zeros(len(NAMES))
    for b in batches:
        x = _matrix(b)
        n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    yield pa.record_batch([pa.array([n]), pa.array([np.r_[s, q].tobytes()], pa.binary())], names=["n", "sums"])


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold.

    Three of four of them (by a hash of the id) enter the normal equations, the rest calibrate, however few they are.  One
    matrix of ``(FEATURES + 1) ** 2`` doubles comes from each of ``FIT_TASKS`` tasks.
    """
    tune(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, False, most)
    rows = materialise(measure(sample), "statistics").coalesce(FIT_TASKS)
    part = rows.mapInArrow(_moments, "n long, sums binary").collect()
    n = sum(r.n for r in part)
    total = sum((np.frombuffer(r.sums) for r in part), np.zeros(2 * len(NAMES))) / max(1, n)
    mean = total[: len(NAMES)]
    basis = Basis(mean, np.sqrt(np.maximum(total[len(NAMES) :] - mean**2, 0)))
    d = FEATURES + 1

    def equations(batches):
        a, c = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            phi, y = basis(_matrix(b)), b.column("y").to_numpy().astype(np.float64)
            a += phi.T @ phi
            c += phi.T @ y
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

    aside = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    sums = rows.where(~aside).mapInArrow(equations, "a binary, c binary").collect()
    a = sum((np.frombuffer(r.a).reshape(d, d) for r in sums), np.zeros((d, d)))
    c = sum((np.frombuffer(r.c) for r in sums), np.zeros(d))
    reg = RIDGE * np.eye(d)
    reg[-1, -1] = 1e-6
    weights = np.linalg.solve(a + reg, c)

    def raw(batches):
        for b in batches:
            yield pa.record_batch([pa.array(basis(_matrix(b)) @ weights), b.column("y")], names=["raw", "y"])

    kept = rows.where(aside).mapInArrow(raw, "raw double, y int").collect()
    if not kept:
        return Model(basis, weights, np.array([0.0]), np.array([0.5]))
    knots, values = isotonic(np.array([r.raw for r in kept]), np.array([r.y for r in kept], np.float64))
    return Model(basis, weights, knots, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text; null counts as empty."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.record_batch([b.column("doc_id"), pa.array(m(x), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """Fit and score: ``doc_id, held_out, score, predicted``, one row per input row.

    A null doc_id is not held out.  Without labels every score is about one half.  Repeated rows
    score alike; other columns are ignored.
    """
    s = score(docs, train(docs, labels, most))
    held = F.coalesce(fold(s, FOLDS) == HELD, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
