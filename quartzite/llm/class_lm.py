"""Language-model scores by a class bigram model after Brown et al., with classes from exchange clustering.

Words are bytes between ASCII white space, lower-cased A-Z; every text ends with an end token. Pass 1 counts all training words
and takes the ``frequent`` commonest. Pass 2 turns texts into units: a frequent word is a unit of its own, all other words belong to
one of ``endings`` units by their ending. Exchange clustering moves units between classes to the greatest class-bigram likelihood;
its input is the square table of unit bigrams, of fixed size. Then every other word gets a class of its own: the occurrences of a
word, with the units before and after, meet in hash buckets, and each learned word takes the class that its neighbours' classes speak
for, with the class table fixed; only words that aren't learned stay with their ending. Classes and exact counts go back to
the places of the words, and the class bigrams are counted anew. The score of a text is the sum of log10 P(class | previous class) and
log10 P(word | class); P(word | class) is (c + 0.5) / (n + 0.5 (v + 1)) over the class's tokens n and distinct words v.

Words are told apart by a 64-bit hash in the buckets. Defined results: null text is empty and has the end token alone; a null
doc_id is trained on and not held out; repeated rows each get a row; with no training token at all V and N are zero; an
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values, materialize

FREQUENT = 1024
ENDINGS = 256
CLASSES = 64
SWEEPS = 6
SLICES = 8
BATCH_ROWS = 4096  # texts met at once
BUCKET_WORDS = 2_000_000  # that share a bucket, about
HELD_WORDS = 200_000  # of a task before it hands its counts on
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def ending_unit(word: bytes, endings: int) -> int:
    """Which of ``endings`` groups a word is in, by its last three bytes."""
    return xxhash.xxh64_intdigest(word[-3:], 7) % endings


def frequent_words(docs: DataFrame, count: int) -> tuple[list[bytes], int]:
    """The commonest words of the training texts by their exact counts, at most ``count``, and the number of all words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in byte_values(b.column(0)):
                seen.update(words_of(t))
                if len(seen) > HELD_WORDS:
                    yield sums()
                    seen.clear()
        yield sums()

    found = docs.where("train").select("text").mapInArrow(run, "word binary, n long")
    counts = materialize(found.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(count).collect()
    return sorted(bytes(r.word) for r in top), counts.agg(F.sum("n")).first()[0] or 0


def _units(docs: DataFrame, kind: str, frequent: list[bytes], endings: int, buckets: int) -> DataFrame:
    """Rows of three kinds. seq: a batch's keys, lengths and units; grams: a slice of its partition's unit-bigram counts; words: postings."""
    own = {w: i for i, w in enumerate(frequent)}
    n_own = len(frequent)
    end_unit = n_own + endings
    total = end_unit + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        grams = np.zeros(total * total, np.int64)
        parts = (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        for turn, b in enumerate(parts):
            batch = task << 24 | turn
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            known = dict(own)
            ids, lengths = [], []
            for t in byte_values(b.column(2)):
                ws = words_of(t)
                for w in ws:
                    if w not in known:
                        known[w] = len(known)
                ids.append(np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)))
                lengths.append(len(ws))
            lengths = np.array(lengths, np.int64)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            rare = list(known)[n_own:]
            del ids
            unit_of = np.concatenate([np.arange(n_own), n_own + np.fromiter((ending_unit(w, endings) for w in rare), np.int64, len(rare))]).astype(np.int32)
            units = unit_of[flat]
            row = np.repeat(np.arange(len(lengths)), lengths)
            # the sequence with the end token of each text
            at = np.arange(len(flat)) + row
            seq = np.full(len(flat) + len(lengths), end_unit, np.int32)
            seq[at] = units
            before = np.r_[np.int32(end_unit), seq[:-1]][: len(seq)]
            used = np.repeat(train, lengths + 1)
            grams += np.bincount((before.astype(np.int64) * total + seq)[used], minlength=total * total)
            # the words that are not units are numbered by bucket, and the sequence row keeps their numbers in the order of the texts
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in rare), np.uint64, len(rare))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(rare), np.int64)
            number[order] = np.arange(len(rare))
            mask = flat >= n_own
            numbers, place = number[flat[mask] - n_own], at[mask]
            del flat, units, row, at, mask, known
            heads = pa.array([b.column(0).to_pylist()], pa.list_(b.schema.field(0).type))
            yield _rows(kind, "seq", [batch], heads, [train.astype(np.uint8).tobytes()], [lengths.astype("<u4").tobytes()], [seq.astype("<u2").tobytes()], [numbers.astype("<u4").tobytes()])
            # postings: how often each of them is learned, and the units before and after each time
            if len(rare):
                learned = used[place]
                by_word = np.argsort(numbers[learned], kind="stable")
                own_places = place[learned][by_word]
                times = np.bincount(numbers[learned], minlength=len(rare))
                ends = np.r_[0, np.cumsum(times)]
                left, right = before[own_places], seq[own_places + 1]
                cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
                out: list[list] = [[], [], [], [], []]
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out[0].append(int(bucket[order[s]]))
                    out[1].append(hashes[order[s:e]].astype("<u8").tobytes() + unit_of[n_own + order[s:e]].astype("<u2").tobytes())
                    out[2].append(times[s:e].astype("<u4").tobytes())
                    out[3].append(left[ends[s] : ends[e]].astype("<u2").tobytes() + right[ends[s] : ends[e]].astype("<u2").tobytes())
                    out[4].append(batch.to_bytes(8, "little") + s.to_bytes(8, "little"))
                nothing = pa.nulls(len(out[0]), pa.list_(b.schema.field(0).type))
                yield _rows(kind, "words", out[0], nothing, out[1], out[2], out[3], out[4])
        for k in range(SLICES):
            part = grams[len(grams) * k // SLICES : len(grams) * (k + 1) // SLICES]
            some = np.flatnonzero(part)
            if len(some):
                nothing = pa.nulls(1, pa.list_(pa_kind))
                yield _rows(kind, "grams", [k], nothing, [some.astype("<u4").tobytes()], [part[some].astype("<u8").tobytes()], [b""], [b""])

    pa_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def _rows(kind: str, what: str, ids: list, heads: pa.Array, a: list, b: list, c: list, d: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([what] * len(ids)), pa.array(ids, pa.int64()), heads, *(pa.array(x, pa.binary()) for x in (a, b, c, d))],
            ["what", "id", "keys", "a", "b", "c", "d"],
        )

    schema = f"what string, id long, keys array<{kind}>, a binary, b binary, c binary, d binary"
    return docs.mapInArrow(run, schema)


def affinity(table: np.ndarray) -> np.ndarray:
    """Log ratio of each class bigram's count to what it would be by chance, drawn to 0 where little is expected."""
    expected = np.outer(table.sum(1), table.sum(0)) / max(1.0, table.sum())
    return np.log((table + 0.5) / (expected + 0.5))


def _classed(words: DataFrame, label: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """Per bucket: exact training counts and the class of the words of each batch, from the number ``start`` on, and distinct learned
    words by class (batch -1). A word takes the class that its own neighbours' classes speak for most, the class table being
    fixed; a word that isn't learned takes that of its ending."""
    near, free = affinity(table), max(1, classes - 1)
    after, ahead = near[:, :free], near[:free].T.copy()  # by the class before, by the class that follows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, units, times, lefts, rights = [], [], [], [], []
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["c"], strict=True):
            n, m = len(a) // 10, len(c) // 4
            hashes.append(np.frombuffer(a, "<u8", n))
            units.append(np.frombuffer(a, "<u2", n, 8 * n))
            times.append(np.frombuffer(b, "<u4", n))
            lefts.append(np.frombuffer(c, "<u2", m))
            rights.append(np.frombuffer(c, "<u2", m, 2 * m))
        word, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        own = np.repeat(back, np.concatenate(times))
        order = np.argsort(own, kind="stable")
        own, left, right = own[order], label[np.concatenate(lefts)[order]], label[np.concatenate(rights)[order]]
        c = np.bincount(own, minlength=len(word))
        chosen = label[np.concatenate(units)[first]]
        ends = np.r_[0, np.cumsum(c)]
        for s in range(0, len(word), 4096):
            some = min(4096, len(word) - s)
            part = slice(ends[s], ends[s + some])
            at = (own[part] - s) * classes
            l, r = (np.bincount(at + x[part], minlength=some * classes).reshape(some, classes).astype(np.float64) for x in (left, right))
            best = np.argmax(l @ after + r @ ahead, axis=1)
            chosen[s : s + some] = np.where(c[s : s + some] > 0, best, chosen[s : s + some])
        types = np.bincount(chosen[c > 0], minlength=classes)
        out = {"batch": [-1], "start": [0], "class": [types.astype("<u8").tobytes()], "n": [b""]}
        at = 0
        for n, d in zip(map(len, hashes), pdf["d"], strict=True):
            mine = back[at : at + n]
            out["batch"].append(int.from_bytes(d[:8], "little"))
            out["start"].append(int.from_bytes(d[8:], "little"))
            out["class"].append(chosen[mine].astype("<u2").tobytes())
            out["n"].append(c[mine].astype("<u4").tobytes())
            at += n
        return pd.DataFrame(out)

    return words.groupBy("id").applyInPandas(run, "batch long, start long, class binary, n binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(grams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit: units start in classes by frequency rank, the last unit (the end token) in one of its own, and each
    sweep moves every other unit to the class that gives the greatest class-bigram likelihood, until none moves."""
    total = len(grams)
    free = max(1, classes - 1)
    weight = grams.sum(0) + grams.sum(1)
    label = np.empty(total, np.int64)
    label[np.argsort(-weight, kind="stable")] = np.arange(total) % free
    label[-1] = classes - 1
    grams = grams.astype(np.float64)
    member = np.zeros((total, classes))
    member[np.arange(total), label] = 1
    right, left = grams @ member, grams.T @ member  # of a unit to, from the classes
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-weight[:-1], kind="stable"):
            if not weight[u]:
                break
            a, own, r, l = label[u], grams[u, u], right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] -= own
            # what follows and precedes a class, the unit's own part in other classes' sums included
            rows, cols = table.sum(1) + l, table.sum(0) + r
            gain = (_xlogx(table + r) - _xlogx(table)).sum(1) + (_xlogx(table + l[:, None]) - _xlogx(table)).sum(0)
            cell = np.diag(table)
            gain += _xlogx(cell + r + l + own) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + l.sum() + own) - _xlogx(cols)
            best = int(np.argmax(gain[:free]))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            table[best, :] += r
            table[:, best] += l
            table[best, best] += own
            if best != a:
                moved += 1
                label[u] = best
                right[:, a] -= grams[:, u]
                right[:, best] += grams[:, u]
                left[:, a] -= grams[u, :]
                left[:, best] += grams[u, :]
        if not moved:
            break
    return label


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, endings: int = ENDINGS, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text, learning from rows where ``train`` holds."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own, n_words = frequent_words(source, frequent)
    total = len(own) + endings + 1
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // BUCKET_WORDS)  # so that a bucket doesn't grow with the corpus
    parts = materialize(_units(source, kind, own, endings, buckets), "units")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        size = total * total
        k = int(pdf["id"].iloc[0])
        summed = np.zeros(size * (k + 1) // SLICES - size * k // SLICES, np.int64)
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            summed[np.frombuffer(a, "<u4")] += np.frombuffer(b, "<u8").astype(np.int64)
        return pd.DataFrame({"id": [k], "n": [summed.astype("<u8").tobytes()]})

    grams = np.zeros(total * total, np.int64)
    for r in parts.where("what = 'grams'").select("id", "a", "b").groupBy("id").applyInPandas(merge, "id int, n binary").collect():
        grams[total * total * r.id // SLICES : total * total * (r.id + 1) // SLICES] = np.frombuffer(bytes(r.n), "<u8")
    grams = grams.reshape(total, total)
    count = grams.sum(0)  # training tokens of each unit

    label = exchange(grams, classes, sweeps)
    member = np.zeros((total, classes))
    member[np.arange(total), label] = 1
    added = materialize(_classed(parts.where("what = 'words'").select("id", "a", "b", "c", "d"), label, member.T @ grams @ member, classes), "classed")

    def summed(rows: DataFrame, length: int) -> np.ndarray:
        """The sum of the arrays of longs in column n, added up in groups first."""

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [sum(np.frombuffer(x, "<u8") for x in pdf["n"]).astype("<u8").tobytes()]})

        out = np.zeros(length, np.int64)
        for r in rows.withColumn("g", F.expr("pmod(xxhash64(n), 16)")).groupBy("g").applyInPandas(add, "n binary").collect():
            out += np.frombuffer(bytes(r.n), "<u8").astype(np.int64)
        return out

    types = summed(added.where("batch = -1").select(F.col("class").alias("n")), classes).astype(np.float64)
    single = np.r_[np.arange(len(own)), total - 1]  # units of one word
    np.add.at(types, label[single], count[single] > 0)
    n_all, v_all = int(count.sum()), int(types.sum())
    base_norm = np.log10(n_all + 0.5 * (v_all + 1))
    gain = np.zeros(total)
    gain[single] = np.log10(count[single] + 0.5)
    seen = np.zeros(total, np.int64)
    seen[single] = count[single] > 0
    label_of = label.astype("<u2")

    def settle(_: tuple, seqs: pd.DataFrame, adds: pd.DataFrame) -> pd.DataFrame:
        """A batch's tokens by their final class, the class-independent part of its texts' scores, and its class bigrams to learn from."""
        outs = []
        for keys, flags, lens, blob, numbers in zip(seqs["keys"], seqs["a"], seqs["b"], seqs["c"], seqs["d"], strict=True):
            n = len(flags)
            lengths = np.frombuffer(lens, "<u4").astype(np.int64) + 1
            seq, numbers = np.frombuffer(blob, "<u2").astype(np.int64), np.frombuffer(numbers, "<u4")
            row = np.repeat(np.arange(n), lengths)
            words = int(numbers.max()) + 1 if len(numbers) else 0
            own_class, own_count = np.zeros(words, "<u2"), np.zeros(words, np.int64)
            for start, c, k in zip(adds["start"], adds["class"], adds["n"], strict=True):
                own_class[start : start + len(k) // 4] = np.frombuffer(c, "<u2")
                own_count[start : start + len(k) // 4] = np.frombuffer(k, "<u4")
            cls, token_gain, token_seen = label_of[seq], gain[seq], seen[seq]
            at = (seq >= len(own)) & (seq < total - 1)
            cls[at], token_gain[at], token_seen[at] = own_class[numbers], np.log10(own_count + 0.5)[numbers], (own_count > 0)[numbers]
            before = np.r_[classes - 1, cls[:-1]][: len(cls)].astype(np.int64)
            used = np.repeat(np.frombuffer(flags, np.uint8) > 0, lengths)
            table = np.bincount((before * classes + cls)[used], minlength=classes * classes)
            outs.append(pd.DataFrame({
                "keys": [keys], "flags": [flags], "lengths": [lengths.astype("<u4").tobytes()], "classes": [cls.tobytes()],
                "shared": [np.bincount(row, token_gain, minlength=n).astype("<f8").tobytes()], "known": [np.bincount(row, token_seen, minlength=n).astype("<u4").tobytes()],
                "n": [table.astype("<u8").tobytes()],
            }))
        return pd.concat(outs) if outs else pd.DataFrame({c: [] for c in ("keys", "flags", "lengths", "classes", "shared", "known", "n")})

    seqs = parts.where("what = 'seq'").select("id", "keys", "a", "b", "c", "d")
    adds = added.where("batch >= 0").select(F.col("batch").alias("id"), "start", "class", "n")
    layout = f"keys array<{kind}>, flags binary, lengths binary, classes binary, shared binary, known binary, n binary"
    settled = materialize(seqs.groupBy("id").cogroup(adds.groupBy("id")).applyInPandas(settle, layout), "settled")
    table = summed(settled.select("n"), classes * classes).reshape(classes, classes).astype(np.float64)
    class_n = table.sum(0)
    share = (class_n + 0.5) / (n_all + 0.5 * classes)
    step = np.log10((table + 20 * share) / (table.sum(1, keepdims=True) + 20))
    emit = -np.log10(class_n + 0.5 * (types + 1))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for keys, flags, lens, blob, shared, known in zip(*(pdf[c] for c in ("keys", "flags", "lengths", "classes", "shared", "known")), strict=True):
                lengths, cls = np.frombuffer(lens, "<u4").astype(np.int64), np.frombuffer(blob, "<u2").astype(np.int64)
                shared = np.frombuffer(shared, "<f8")
                before = np.r_[classes - 1, cls[:-1]][: len(cls)]
                model = np.bincount(np.repeat(np.arange(len(flags)), lengths), step[before, cls] + emit[cls], minlength=len(flags))
                yield pd.DataFrame({
                    "key": pd.array(list(keys), dtype="Int64") if kind in ("bigint", "int") else list(keys), "held_out": np.frombuffer(flags, np.uint8) == 0, "n_tokens": lengths, "n_known": np.frombuffer(known, "<u4").astype(np.int64),
                    "train_tokens": n_all, "base_score": shared - lengths * base_norm, "score": shared + model,
                    "perplexity": 10.0 ** (-(shared + model) / lengths),
                })

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return settled.drop("n").mapInPandas(finish, schema)


def report(docs: DataFrame) -> DataFrame:
    """The result of query op9."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score(docs, ~held_out).withColumnRenamed("key", "doc_id")
