"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters. A seed lexicon gives one voter for each of its groups. From a bounded sample of labelled training rows, word beginnings and
whole words that occur in several different toxic texts and hardly in others are found in every language; each becomes a voter of its
own (the shortest beginning of a family stands for it). Pattern voters look at how many hits a text has and how densely they stand, and clean
voters speak against toxicity where there is no hit.

Label model. Each voter casts its vote or abstains. Given the class, votes are not independent: every voter hangs on one other, its parent,
by a tree of greatest mutual information given the class. The model's parameters are the chances of a vote given the class and whether the
parent voted: accuracies and correlations (of either sign) in one table. EM estimates them from the votes on unlabelled texts, first with
independent voters, then with the tree; the class balance is that of the labelled training rows. A copy of another voter adds nothing.

Classifier. Sparse logistic regression (FTRL, elastic net) on hashed words and word beginnings learns the posterior labels of a bounded sample of
training texts; a text's score is the sigmoid of the sum over its distinct words. Labels, lang, source and doc_id are not inputs.

Defined results: null text is empty, and a text without letters has the score of the bias alone; without training rows
the score is 0; repeated rows each get a row; a null doc_id is never held out and never labelled; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values, materialize
from quartzite.llm.learning import bounded_sample, crc_mod, letter_words, sigmoid

THRESHOLD = 0.3
LABELLED_ROWS = 8_000
UNLABELLED_ROWS = 8_000
MIN_SUPPORT = 4  # different texts
MIN_PRECISION = 0.9  # with one clean text more than were seen, if any was
SEED_PRECISION = 0.5
FEATURES = 1 << 22
WHOLE = 1 << 20  # posteriors are summed in these parts
CACHE_WORDS = 150_000
BEGINNINGS = (3, 4, 5, 6)

#: Seed lexicon: common English words of insult, by group.
LEXICON = {
    "intellect": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "imbeciles", "cretin", "cretins", "dimwit", "halfwit", "dunce"),
    "contempt": ("pathetic", "worthless", "useless", "disgusting", "despicable", "repulsive", "vile", "revolting"),
    "dehumanising": ("scum", "scumbag", "vermin", "trash", "garbage", "filth", "subhuman", "parasite", "parasites"),
    "ridicule": ("loser", "losers", "clown", "clowns", "buffoon", "crybaby", "wimp"),
    "dullness": ("stupid", "stupidity", "dumb", "dumbass", "brainless", "braindead"),
    "coarse": ("bastard", "bastards", "asshole", "assholes", "jerk", "jerks", "bitch", "bitches", "crap", "shit", "bullshit"),
}


def beginnings(word: str) -> list[str]:
    """The patterns a word shows: its beginnings, marked by a star, and itself."""
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n] + [word]


def _distinct(text: bytes) -> set[str]:
    return {w.decode("utf-8", "replace").lower() for w in set(letter_words(text))}


def find_patterns(labelled: DataFrame, text: str, label: str) -> tuple[list[str], list[str]]:
    """Word beginnings and words of the sampled labelled rows that mark toxic ones, the commonest first; and the seed words that
    stand mostly in clean ones (a seed can be an innocent word of another language). Equal texts of one label count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for t, toxic in zip(byte_values(b.column(0)), b.column(1).to_pylist(), strict=True):
                k = 1 if toxic else 0
                for p in {p for w in _distinct(t) for p in beginnings(w)}:
                    seen.setdefault(p, [0, 0])[k] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())],
                ["pattern", "clean", "toxic"],
            )

    once = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).alias("label")).distinct()
    total = once.mapInArrow(run, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seeds = {w for words in LEXICON.values() for w in words}
    toxic, both = F.col("toxic"), F.col("clean") + F.col("toxic")
    # no more rows than the words of the bounded sample's toxic texts by MIN_SUPPORT
    rows = total.where(F.col("pattern").isin(*seeds) | ((toxic >= MIN_SUPPORT) & (toxic >= MIN_PRECISION * (both + F.least("clean", F.lit(1)))))).orderBy(F.desc("toxic"), F.length("pattern"), "pattern").collect()
    off = [r.pattern for r in rows if r.pattern in seeds and r.toxic < SEED_PRECISION * (r.toxic + r.clean)]
    telling = [r.pattern for r in rows if r.toxic >= MIN_SUPPORT and r.toxic >= MIN_PRECISION * (r.toxic + r.clean + min(r.clean, 1))]
    stems = {p for p in telling if p.endswith("*")}
    # a pattern whose shorter beginning is one too says nothing of its own
    return [p for p in telling if not any(b != p and b in stems for b in beginnings(p.rstrip("*")))], off


class Voters:
    """Votes of a text: +1 toxic, -1 clean, 0 none."""

    def __init__(self, patterns: list[str], off: list[str]):
        self.patterns = patterns
        self.group = {w: g for g, words in enumerate(LEXICON.values()) for w in words if w not in off}
        self.learned = {p: len(LEXICON) + i for i, p in enumerate(patterns)}
        self.n = len(LEXICON) + len(patterns) + 6
        self.known: dict[str, tuple[int, ...]] = {}

    def _hits(self, word: str) -> tuple[int, ...]:
        found = [self.learned[p] for p in beginnings(word) if p in self.learned]
        if word in self.group:
            found.append(self.group[word])
        return tuple(found)

    def row(self, text: bytes) -> np.ndarray:
        v = np.zeros(self.n, np.int8)
        words = [w.decode("utf-8", "replace").lower() for w in letter_words(text)]
        hits, seeds = 0, 0
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) > CACHE_WORDS:
                    self.known.clear()
                own = self.known[w] = self._hits(w)
            if own:
                v[list(own)] = 1
                hits += 1
                seeds += w in self.group
        base = len(LEXICON) + len(self.patterns)
        v[base] = 1 if hits >= 2 else 0
        v[base + 1] = 1 if hits >= 4 else 0
        v[base + 2] = 1 if hits and hits * 100 >= len(words) else 0
        v[base + 3] = -1 if not hits else 0
        v[base + 4] = -1 if not seeds else 0
        v[base + 5] = -1 if hits * 1000 < len(words) or not words else 0
        return v


def dependence_tree(cast: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """The parent of each voter (the first has none: -1) in the tree of greatest mutual information given the class; ``weights`` has each
    row's share of either class."""
    n, m = cast.shape
    info = np.zeros((m, m))
    for q in weights:
        size = q.sum() + 1e-9
        both = (cast * q[:, None]).T @ cast / size
        p = np.diag(both).copy()
        for cell, a, b in ((both, p[:, None], p[None, :]), (p[:, None] - both, p[:, None], 1 - p[None, :]), (p[None, :] - both, 1 - p[:, None], p[None, :]), (1 - p[:, None] - p[None, :] + both, 1 - p[:, None], 1 - p[None, :])):
            info += size / n * cell * np.log(np.maximum(cell, 1e-12) / np.maximum(a * b, 1e-12))
    parent, inside = np.full(m, -1), np.zeros(m, bool)
    best, via = np.full(m, -1.0), np.full(m, -1)
    at = 0
    for _ in range(m):
        inside[at] = True
        parent[at] = via[at]
        better = ~inside & (info[at] > best)
        best[better], via[better] = info[at][better], at
        at = int(np.argmax(np.where(inside, -2.0, best)))
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """P(toxic) of each row of ``votes``, and what the model estimates: for each voter its parent and the chance of its vote by class
    and by whether the parent voted (``[class, parent voted, voter]``)."""
    n, m = votes.shape
    cast = (votes != 0).astype(np.float32)
    against = np.zeros(m, bool) if not n else (votes < 0).any(0)
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    # to start with, nine in ten toxic votes and 97 in 100 clean ones are right, whatever share of texts a voter speaks to
    right = np.where(against[None, :], np.array([[0.97], [0.03]]), np.array([[0.1], [0.9]]))
    start = np.clip(cast.mean(0)[None, :] * right / np.array([[1 - prior], [prior]]), 1e-6, 0.99)
    chance = np.stack([start, start], 1)  # class, parent voted, voter
    parent = np.full(m, -1)
    posterior = np.full(n, prior)
    for phase in range(2):
        beside = np.where(parent[None, :] >= 0, cast[:, np.maximum(parent, 0)], 0).astype(np.float32)
        for _ in range(rounds):
            # a voter that abstains says nothing; one that votes says what its vote adds to its parent's
            ratio = np.clip(np.log(chance[1] / chance[0]), -8, 8).astype(np.float32)
            score = np.log(prior / (1 - prior)) + (cast * (1 - beside)) @ ratio[0] + (cast * beside) @ ratio[1]
            posterior = sigmoid(score.astype(np.float64))
            cells = []  # by class: the voter's votes beside its parent's, its silence there, its votes without, its silence without
            for q in (1 - posterior, posterior):
                q = q.astype(np.float32)
                a, parents, votes_of = (x.astype(np.float64) for x in (q @ (cast * beside), q @ beside, q @ cast))
                cells.append((a, parents - a, votes_of - a, q.sum() - parents - votes_of + a, votes_of, float(q.sum())))
            # the association is the same in either class (Mantel-Haenszel), so that a class which hardly ever sees the parent vote takes it from the other
            odds = (sum(a * d / n_k for a, _, _, d, _, n_k in cells) + 1e-3) / (sum(b * c / n_k for _, b, c, _, _, n_k in cells) + 1e-3)
            for k, (a, b, c, d, both, n_k) in enumerate(cells):
                alone = np.clip((both + 2 * start[k]) / (n_k + 2), 1e-6, 1 - 1e-6)
                chance[k, 0] = np.clip((c + 2 * alone) / (c + d + 2), 1e-6, 1 - 1e-6)
                lean = chance[k, 0] * odds / (1 - chance[k, 0] + chance[k, 0] * odds)
                chance[k, 1] = np.clip((a + 2 * lean) / (a + b + 2), 1e-6, 1 - 1e-6)
        if phase == 0:
            parent = dependence_tree(cast, [1 - posterior, posterior])
    return posterior, {"parent": parent, "chance": chance}


def feature_ids(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(p, 6) % FEATURES for p in beginnings(word)]


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> dict | None:
    """Sparse word-pattern weights and bias."""
    marked = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    sample = F.broadcast(bounded_sample(marked, key, labelled_rows, 8))  # at most 1.1 * labelled_rows short rows
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(sample, key)
    share = marked.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
    if share is None:
        return None
    patterns, off = find_patterns(rows, text, "_label")
    # the sample is written once, so each of the three passes over it is shared by tasks
    texts = materialize(bounded_sample(docs.where(train & F.col(text).isNotNull()), key, unlabelled_rows, 9).select(F.col(text).cast("string").alias("text")), "sample")

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voters(patterns, off)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.row(t).tobytes() for t in byte_values(b.column(0))], pa.binary())], ["votes"])

    got = sorted(bytes(r.votes) for r in texts.mapInArrow(cast, "votes binary").toLocalIterator())
    if not got:
        return None
    posterior, _ = label_model(np.array([np.frombuffer(v, np.int8) for v in got]), share)
    toxic_of = dict(zip(got, posterior.tolist(), strict=True))  # equal votes, equal posterior

    def features(t: bytes) -> np.ndarray:
        return np.unique(np.array([i for w in _distinct(t) for i in feature_ids(w)], np.uint32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voters(patterns, off)
        n, toxic = np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.float64)
        for b in batches:
            for t in byte_values(b.column(0)):
                at = features(t)
                n[at] += 1
                toxic[at] += round(toxic_of[v.row(t).tobytes()] * WHOLE)  # whole numbers: sums don't depend on their order
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some], pa.int64()), pa.array(toxic[some].astype(np.int64))], ["feature", "n", "toxic"])

    # features too rare to be learned, or mostly of texts that the label model holds clean, are left out; the voters' own always stay
    own = sorted({int(xxhash.xxh64_intdigest(p, 6) % FEATURES) for p in [*patterns, *Voters(patterns, off).group]})
    sums = texts.mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    chosen = sums.where((F.col("n") >= MIN_SUPPORT) & (F.col("toxic") >= SEED_PRECISION * WHOLE * F.col("n"))).select("feature").collect()
    telling = np.array(sorted({*own, *(r.feature for r in chosen)}), np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voters(patterns, off)
        for b in batches:
            votes, ids = [], []
            for t in byte_values(b.column(0)):
                at = features(t)
                votes.append(v.row(t).tobytes())
                ids.append(np.searchsorted(telling, at[np.isin(at, telling)]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(votes, pa.binary())], ["ids", "votes"])

    pairs = sorted((bytes(r.ids), toxic_of[bytes(r.votes)]) for r in texts.mapInArrow(keep, "ids binary, votes binary").toLocalIterator())
    w, bias = fit_positive([np.frombuffer(ids, "<u4") for ids, _ in pairs], np.array([p for _, p in pairs]), len(telling))
    return {"at": telling, "w": w, "bias": bias}


def fit_positive(rows: list[np.ndarray], target: np.ndarray, features: int, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by FTRL-proximal with elastic net and weights of zero or more: a pattern can speak for
    toxicity, only the bias against it."""
    z, n = np.zeros(features), np.zeros(features)
    base = float(np.clip(np.mean(target), 1e-3, 1 - 1e-3))
    bias = start = float(np.log(base / (1 - base)))
    bias_z = bias_n = 0.0
    order = np.random.default_rng(0)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.maximum(0.0, (-z[at] - l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            error = float(sigmoid(w.sum() + bias)) - target[i]
            more = n[at] + error * error
            z[at] += error - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
            more = bias_n + error * error
            bias_z += error - (more**0.5 - bias_n**0.5) / alpha * (bias - start)
            bias_n = more
            bias = start - bias_z / ((beta + bias_n**0.5) / alpha)
    return weights(slice(None)), float(bias)


class Scorer:
    """Scores of a batch of texts; keeps the weight of each word it has met."""

    def __init__(self, model: dict | None):
        self.model = model
        self.weight = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True)) if model else {}
        self.known: dict[bytes, float] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        known, weight, z = self.known, self.weight, []
        for t in byte_values(texts):
            words = set(letter_words(t))
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = sum(weight.get(i, 0.0) for i in feature_ids(w.decode("utf-8", "replace").lower()))
            z.append(sum(sorted(map(known.__getitem__, words))) + self.model["bias"])  # sorted: equal texts, equal sums
        return sigmoid(np.array(z, np.float64))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    model = model_of(docs, labels, key, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: dict | None, key: str, text: str) -> DataFrame:
    """``key, score``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double")


def model_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """The production model: learns from rows that aren't held out."""
    return fit(docs, labels, crc_mod(F.col(key), 4) != 2, key, text, label)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op6."""
    out = predict(docs, model_of(docs, labels), "doc_id", "text")
    return out.select(
        F.col("key").alias("doc_id"), (crc_mod(F.col("key"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
