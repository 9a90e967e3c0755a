"""What the trained text operators share: bounded training samples, sparse FTRL, words of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CASE = bytes(range(65, 91))
#: Letters in lower case, bytes of other scripts as they are, everything else a space.
LETTERS = bytes(b + 32 if b in _CASE else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; letters of other scripts keep their case here."""
    return text.translate(LETTERS).split()


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as -1, so it is never held out."""
    return F.coalesce((F.crc32(key.cast("string")) % n).cast("int"), F.lit(-1))


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    """About ``rows`` rows of ``df``, never more than a tenth beyond: those with the least share of hash values. All, if there are no more.

    The share depends on the row count alone, so the same rows are taken on every run. Only where so many rows share a key that a hash
    can't part them does a limit do it.
    """
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * 1_000_000_007)
    taken = df.where(F.pmod(F.xxhash64(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1_000_000_007)) < cut)
    most = rows + rows // 10
    return taken if taken.count() <= most else taken.limit(most)


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader (proximal) with elastic-net penalties on sparse rows.

    Per coordinate: z gathers gradients less the pull of the step size, n their squares; a weight is zero while |z| <= l1, else
    -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2). Targets may be soft.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> np.ndarray:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        w, bias = self.weights(at), self.bias()
        error = (softmax(x @ w + bias) - target) * weight
        g = x[:, None] * error[None, :]
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more
        more = self.bias_n + error * error
        self.bias_z += error - (np.sqrt(more) - np.sqrt(self.bias_n)) / self.alpha * bias
        self.bias_n = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature that gives held-back rows the least log loss, by golden-section search over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(40):
        if loss(c) < loss(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return float(np.exp((a + b) / 2))
