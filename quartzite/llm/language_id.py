"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all training texts. The classifier is fitted by FTRL-proximal with elastic-net penalties on a
bounded sample of labelled rows (``sample_rows``), then its logits are divided by a temperature fitted on a fifth of that sample
held back. Prediction reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled training row every text is
``und`` with score 0; repeated rows each get a row; a null doc_id is never held out; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values
from quartzite.llm.learning import Ftrl, bounded_sample, crc_mod, fit_temperature, softmax

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 3_000
EPOCHS = 3
UNDETERMINED = "und"
_letter = regex.compile(r"\p{L}").search


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed character n-grams of the lower-cased text, by bucket."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(buckets, np.int64)
    h = np.zeros(0, np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        part = c[n - 1 :]
        h = (part if n == 1 else h[:-1] * np.uint32(0x01000193) ^ part) * np.uint32(0x9E3779B1)
        mixed = h ^ h >> np.uint32(15)
        out += np.bincount((mixed * np.uint32(2654435769 - 2 * n) >> np.uint32(18)).astype(np.int64) & buckets - 1, minlength=buckets)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts. Tasks return one count per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in byte_values(b.column(0)):
                df += ngram_counts(t.decode("utf-8", "replace")) > 0
            n += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], ["bucket", "n"])

    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    real = rows[rows.bucket >= 0]
    out[real.bucket.to_numpy(np.int64)] = real.n.to_numpy(np.int64)
    return out, int(rows[rows.bucket < 0].n.sum())


def fit(labelled: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The model of rows with text and label: languages, idf, weights, bias, temperature. None without rows."""
    df, n = document_frequencies(labelled, text)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = [], []
            for t in byte_values(b.column(1)):
                i, v = _vector(ngram_counts(t.decode("utf-8", "replace")), idf)
                at.append(i.astype("<u2").tobytes())
                x.append(v.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["label", "at", "x"])

    sample = bounded_sample(labelled, key, sample_rows, 3).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    got = sample.mapInArrow(rows, "label string, at binary, x binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.at), bytes(r.x)))
    langs = sorted({r.label for r in got})
    data = [(np.frombuffer(bytes(r.at), "<u2").astype(np.int64), np.frombuffer(bytes(r.x), "<f4").astype(np.float64), langs.index(r.label)) for r in got]
    order = np.random.default_rng(0).permutation(len(data))
    back = len(data) // 5
    model = Ftrl(BUCKETS, len(langs), alpha=1.0, l1=0.02, l2=0.01)
    one = np.eye(len(langs))
    for _ in range(EPOCHS):
        for i in order[back:]:
            at, x, y = data[i]
            model.learn(at, x, one[y])
    w, bias = model.weights(), model.bias()
    held = [data[i] for i in order[:back]]
    logits = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(len(held), len(langs))
    t = fit_temperature(logits, np.array([y for _, _, y in held], np.int64))
    return {"langs": langs, "idf": idf.astype(np.float32), "w": (w / t).astype(np.float32), "bias": bias / t}


def predict(docs: DataFrame, model: dict | None, key: str, text: str) -> DataFrame:
    """``key, lang_pred, score``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for t in byte_values(b.column(1)):
                s = t.decode("utf-8", "replace")
                if model is None or not _letter(s):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, x = _vector(ngram_counts(s), model["idf"])
                p = softmax(x @ model["w"][at] + model["bias"])
                langs.append(model["langs"][int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")


def identify(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    labelled = docs.where(train & F.col(text).isNotNull() & F.col(label).isNotNull())
    return predict(docs, fit(labelled, key, text, label, sample_rows), key, text)


def report(docs: DataFrame) -> DataFrame:
    """The result of query op3."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs, ~held_out)
    return out.select(F.col("key").alias("doc_id"), (crc_mod(F.col("key"), 4) == 2).alias("held_out"), "lang_pred", "score")
