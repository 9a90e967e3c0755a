"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training rows labelled 1, the unlabelled set is web text of training rows whatever their label, both in
bounded samples. The class prior is estimated from the two samples (see ``estimate_prior``). A linear model is then fitted by Adam on
the non-negative unbiased risk
``prior R_p(+) + max(0, R_u(-) - prior R_p(-))`` with logistic loss, so its sigmoid is the probability of label 1.

Features: shares of hashed token shapes (letters in lower or upper case, digits, marks as they are; runs collapsed) and
indicator bins of whole-text statistics. Labels, lang, source and doc_id are not among them.

Defined results: null text is empty; texts without tokens have the features of zero statistics and get a score; without positives the
score is 0.5 for all; repeated rows each get a row; a null doc_id is never held out and never labelled; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values, materialize
from quartzite.llm.learning import bounded_sample, crc_mod, sigmoid

SHAPES = 512
BINS = 12
POSITIVES = 4_000
UNLABELLED = 8_000
STEPS = 600
_SHAPE = bytes(48 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL).sub
KEPT_BYTES = 256  # shapes beyond are not kept, whatever their number
#: Upper ends of the bins of each statistic.
EDGES = {
    "log_tokens": np.linspace(0, 10, BINS - 1),
    "distinct": np.linspace(0.05, 0.98, BINS - 1),
    "repeats": np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8]),
    "upper": np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15, 0.25, 0.4, 0.6, 0.9]),
    "marks": np.array([0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5]),
    "digits": np.array([0.001, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6]),
    "word_length": np.linspace(2, 12, BINS - 1),
    "line_repeats": np.array([0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]),
    "tokens_a_line": np.array([1.5, 2.5, 4, 6, 9, 13, 20, 30, 45, 70, 120.0]),
    "commonest": np.array([0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8]),
}
WIDTH = SHAPES + BINS * len(EDGES)


class Features:
    """Turns texts into dense rows; keeps the collapsed shapes it has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _bucket(self, shape: bytes) -> int:
        return xxhash.xxh64_intdigest(_RUNS(rb"\1", shape), 4) % SHAPES

    def row(self, text: bytes) -> np.ndarray:
        x = np.zeros(WIDTH, np.float32)
        classes = text.translate(_SHAPE)
        words = text.split()
        n = len(words)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for shape, k in Counter(classes.split()).items():
            at = known.get(shape)
            if at is None:
                at = self._bucket(shape)
                if len(shape) <= KEPT_BYTES:
                    known[shape] = at
            x[at] += k
        if n:
            x[:SHAPES] = np.sqrt(x[:SHAPES] / n)
        size = max(1, len(text))
        lines = text.split(b"\n")
        upper, lower, digit = classes.count(b"A"), classes.count(b"a"), classes.count(b"0")
        space = size - sum(map(len, words)) if n else 0
        seen = Counter(words)
        stats = (
            np.log1p(n), len(seen) / n if n else 0, sum(map(eq, words, words[1:])) / n if n else 0, upper / max(1, upper + lower),
            max(0, size - upper - lower - digit - space) / size, digit / size, (size - space) / n if n else 0,
            1 - len(set(lines)) / len(lines), n / len(lines), max(seen.values()) / n if n else 0,
        )
        for k, (value, edges) in enumerate(zip(stats, EDGES.values(), strict=True)):
            x[SHAPES + k * BINS + int(np.searchsorted(edges, value))] = 1
        return x


def _rows(df: DataFrame, text: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f.row(t).astype("<f2").tobytes() for t in byte_values(b.column(0))], pa.binary())], ["x"])

    sample = materialize(df.select(F.col(text).cast("string").alias("text")), "sample")  # of bounded rows, written once, so tasks share the work
    got = sorted(bytes(r.x) for r in sample.mapInArrow(run, "x binary").collect())
    return np.array([np.frombuffer(x, "<f2") for x in got], np.float32).reshape(len(got), WIDTH)


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk. When the negative part falls below zero a step climbs it back, as
    the estimator's authors advise."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(WIDTH + 1) for _ in range(3))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        zp, zu = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
        up, down_p, down_u = -sigmoid(-zp), sigmoid(zp), sigmoid(zu)  # slopes of the logistic loss for +1 and -1
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        part = lambda x, s: np.r_[x.T @ s, s.sum()] / len(s)
        spare = part(b, down_u) - prior * part(a, down_p)
        g = prior * part(a, up) + spare if negative >= 0 else -spare
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * min(1.0, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the unlabelled to the positive share with a score above a
    threshold, over thresholds that keep at least half of the positives. Each half of the samples is counted by the scorer that the
    other half fitted; the two estimates are averaged."""
    found = []
    for k in (0, 1):
        w, bias = fit_nnpu(p[k::2], u[k::2], 0.5, steps=300)
        zp, zu = np.sort(p[1 - k :: 2] @ w + bias), np.sort(u[1 - k :: 2] @ w + bias)
        cuts = np.quantile(zp, np.linspace(0, 0.5, 26))
        above_p, above_u = 1 - np.searchsorted(zp, cuts) / len(zp), 1 - np.searchsorted(zu, cuts) / len(zu)
        found.append((above_u / above_p).min())
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    good = bounded_sample(labels.where(train & (F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct(), key, positives, 5)
    p = _rows(docs.join(F.broadcast(good), key, "left_semi"), text)  # at most 1.1 * positives keys
    u = _rows(bounded_sample(docs.where(train), key, unlabelled, 6), text)
    if len(p) < 2 or len(u) < 2:
        return None
    prior = estimate_prior(p, u)
    w, bias = fit_nnpu(p, u, prior)
    return {"w": w, "bias": bias, "prior": prior}


def predict(docs: DataFrame, model: dict | None, key: str, text: str) -> DataFrame:
    """``key, score``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            z = [float(f.row(t) @ model["w"] + model["bias"]) if model else 0.0 for t in byte_values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(np.array(z, np.float64)))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op4."""
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    out = predict(docs, fit(docs, labels, ~held_out, "doc_id", "text", "quality"), "doc_id", "text")
    return out.select(
        F.col("key").alias("doc_id"), (crc_mod(F.col("key"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
