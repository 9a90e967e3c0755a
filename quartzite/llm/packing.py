"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are dealt to partitions of bounded size, whatever their
values, and each partition is packed by best-fit decreasing. Dual feasible functions give a lower bound on each partition's bins and, from
the counts of all lengths, on the bins of the whole. Full bins are final. While partitions have gaps they put the pieces of their other
bins into a common pool, which is dealt anew (so documents change partitions) and packed again; once that saves no more, certified
partitions give their part-filled bins too, as long as the whole has a gap to its bound, and the emptiest bins meet in one partition. This ends when the whole meets its bound, when
the pool is one partition, or when a round saves less than ``LEAST_SAVING`` of the gap to the bound.

Defined results: null text is empty and yields the end token alone; repeated rows each get their pieces; null keys are carried;
an empty table gives an empty table; extra columns are not read. ``certified`` says whether the partition that packed a piece last met
its bound.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values, fresh, materialize

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 32_768  # about; pieces are dealt by a hash
LEAST_SAVING = 0.01
FULL, CERTIFIED, GAP = range(3)  # of a bin: full, part-filled in a partition that meets its bound, part-filled in one that doesn't
_BIN_BITS, _GROUP_BITS = 24, 30  # of a sequence id; the rest is the round
CACHE_WORDS = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pieces never cross white space: words are encoded once and kept.

    Words of plain Latin letters go straight to the tokenizer's merge model after its own normalisation (NFC, lower case) and
    split; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.limit = cache_words
        self.cache: dict[bytes, bytes] = {}  # of words as they stand
        self.parts: dict[str, bytes] = {}  # of what the split makes of them
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.simple = regex.compile(r"[!-~¡-İĲ-ɀ]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = (i for i in range(256) if i not in set(printable))
        self.symbol = {i: chr(i) for i in printable} | {b: chr(256 + k) for k, b in enumerate(spare)}

    def _ids(self, word: str) -> bytes:
        if not self.simple(word) or "<|" in word:
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return self._part(word)
            if word[:-1].isalpha():  # a word and its punctuation mark
                return self._part(word[:-1]) + self._part(word[-1])
        else:
            word = unicodedata.normalize("NFC", word).lower()
        return b"".join(map(self._part, self.split(word)))

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            symbols = part if part.isascii() else "".join(map(self.symbol.__getitem__, part.encode()))
            known = self.parts[part] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return known

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = text.split()
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            pass
        for held in (cache, self.parts):
            if len(held) > self.limit:
                for w in list(islice(held, self.limit // 2)):
                    del held[w]
        for w in words:
            if w not in cache:
                cache[w] = self._ids(w.decode("utf-8", "replace"))
        return b"".join(map(cache.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: documents cut into pieces of at most ``capacity`` ids, the end id included."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, t in enumerate(byte_values(b.column(1))):
                ids = encoder.encode(t) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(r)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            keys = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room
    mask, count = 0, 0  # bit r of mask: there is an open bin with room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = room_of[room].pop()
            if not room_of[room]:
                mask ^= 1 << room
        else:
            room, own, count = capacity, count, count + 1
        bins[i], offsets[i] = own, capacity - room
        room -= size
        if room:
            room_of[room].append(own)
            mask |= 1 << room
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The greatest bound that these dual feasible functions give on the bins for ``counts`` pieces of each length: the identity, the
    threshold functions (a length over capacity - t counts whole, one under t not at all) and the rounding functions floor((k+1) x) / k."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    upto, weight = np.cumsum(counts), np.cumsum(counts * size)
    for t in range(1, capacity // 2 + 1):
        whole = int(upto[capacity] - upto[capacity - t])
        between = int(weight[capacity - t] - weight[t - 1])
        best = max(best, whole - (-between // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0  # such lengths keep their own share: in units of capacity * k
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def _bound(parts: DataFrame, capacity: int) -> int:
    """The lower bound of all pieces, from the number of pieces of each length."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    return bound_of_counts(counts, capacity)


def _by_room(counts: dict[int, int], group_rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """(room, first partition, number of partitions) for the pieces of bins of each room, the emptiest bins first, and the number of all."""
    out, at, held = [], 0, 0
    for r in sorted(counts, reverse=True):
        if held and held + counts[r] > group_rows:
            at, held = at + 1, 0
        out.append((r, at, max(1, -(-counts[r] // group_rows))))
        held += counts[r]
        if held >= group_rows:
            at, held = at + out[-1][2], 0
    return out, at + (held > 0)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, least_saving: float = LEAST_SAVING) -> DataFrame:
    """``parts`` (with a column length) and, for each, sequence_id and offset, and whether the partition that packed it met its bound."""
    names = parts.columns
    row, group, state, room = fresh(parts, "row", "group", "state", "room")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + f", sequence_id long, offset long, certified boolean, `{state}` int, `{room}` int"

    def packer(turn: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = pdf["length"].to_numpy(np.int64)
            bins, offsets, count = best_fit_decreasing(lengths, capacity)
            gap = count - lower_bound(lengths, capacity)
            fill = np.bincount(bins, lengths, minlength=count)
            out = pdf[names].copy()
            out["sequence_id"] = (turn << _BIN_BITS + _GROUP_BITS) + (pdf[group].to_numpy(np.int64) << _BIN_BITS) + bins
            out["offset"] = offsets
            out["certified"] = gap == 0
            out[state] = np.where(fill[bins] == capacity, FULL, GAP if gap else CERTIFIED)
            out[room] = capacity - fill[bins]
            return out

        return run

    bound = _bound(parts, capacity)
    done: list[DataFrame] = []  # final bins
    waiting: list[DataFrame] = []  # part-filled bins of certified partitions
    n_done = n_waiting = turn = 0
    pool, held, before, with_all = parts, None, None, False
    while True:
        # dealt by a number of the row, so that equal rows part; the pool is a written table, which gives a row the same number again
        numbered = pool.withColumn(row, F.monotonically_increasing_id())
        if with_all:
            first, groups = _by_room({r[room]: r["count"] for r in pool.groupBy(room).count().collect()}, group_rows)
            place = F.broadcast(parts.sparkSession.createDataFrame(first, f"`{room}` int, `{group}` long, `{state}` long"))  # at most ``capacity`` rows
            numbered = numbered.join(place, room)
            dealt = numbered.withColumn(group, F.col(group) + F.pmod(F.xxhash64(F.lit(turn), row), F.col(state)))
        else:
            groups = max(1, -(-pool.count() // group_rows))
            dealt = numbered.withColumn(group, F.pmod(F.xxhash64(F.lit(turn), row), F.lit(groups)))
        packed = materialize(dealt.groupBy(group).applyInPandas(packer(turn), schema), "packed")
        n = {r[state]: r["count"] for r in packed.where("offset = 0").groupBy(state).count().collect()}  # a bin has one piece at its start
        total = n_done + n_waiting + sum(n.values())
        if before is not None and total > before:  # the new packing is worse than the one it came from
            done += [held, *waiting]
            break
        slow = before is not None and before - total < max(1, least_saving * (total - bound))
        n_done += n.get(FULL, 0)
        done.append(packed.where(F.col(state) == FULL))
        part_filled = packed.where(F.col(state) != FULL)
        if total <= bound or (with_all and slow) or (groups == 1 and not waiting):
            done += [part_filled, *waiting]
            break
        if not with_all and not slow and groups > 1 and n.get(GAP, 0):
            waiting.append(packed.where(F.col(state) == CERTIFIED))
            n_waiting += n.get(CERTIFIED, 0)
            held = packed.where(F.col(state) == GAP)
        else:
            held = reduce(DataFrame.unionByName, [part_filled, *waiting])
            waiting, n_waiting, with_all = [], 0, True
        pool, before, turn = held.select(*names, room), total, turn + 1
    return reduce(DataFrame.unionByName, done).drop(state, room)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The result of query op10."""
    parts = materialize(pieces(docs, tokenizer or default_tokenizer(), capacity=capacity), "pieces")
    return pack(parts, capacity).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"
    )
