"""Near-duplicates by SimHash over word shingles and a byte-position inverted index.

A fingerprint has 8 bytes. Two that differ in at most ``radius`` = 3 bits agree in at least 5 of the 8 byte positions, so
at least 3 of those lie in one half: the index posts every fingerprint under the 8 triples of positions within a half,
and any pair to be found shares a posting list. In a list the shared positional bytes of a pair are tallied, pairs that reach 5
are kept and verified by their Hamming distance. A long list is cut into chunks and each pair of chunks is a tile of its own,
so no task holds more than one tile; a tile returns a spanning forest of its links, never the pairs themselves.

Defined results: null text is empty, and texts without words have fingerprint zero and link like any other; repeated rows each
get a row; a null doc_id is carried but never names a component unless no other is in it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values, fresh, materialize, signed
from quartzite.llm.components import components

SEED = 42
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
MIN_SHARED = 5


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words, lower-cased A-Z, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - width].tolist()]
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n - width + 1)


_PLANES = np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of ``hashes``; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        part = np.unpackbits(hashes[a : a + (1 << 14)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(part) // 255 * 255
        if full:
            total += part[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += part[full:].sum(axis=0, dtype=np.uint8)
    return int(np.bitwise_or.reduce((2 * total > n).astype(np.uint64) << _PLANES))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key, fp``: the fingerprint of every whole text as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((majority(shingle_hashes(t, width)) for t in byte_values(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(fps))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) of the components of links a-b."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def links_within(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all pairs in one group (rows sorted by group) whose bytes agree often enough and whose distance is within radius.

    side: 0 for both chunks of a tile that pairs a chunk with itself, else 1 or 2; pairs of one non-zero side belong to another tile.
    """
    found_a, found_b, held = [], [], 0
    at = np.arange(len(fp))
    change = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.repeat(np.r_[change[1:], len(fp)], np.diff(np.r_[change, len(fp)]))  # the end of the row's group
    d = 1
    at = at[at + d < last]
    while len(at):
        x = (fp[at] ^ fp[at + d]).astype(np.uint64, copy=False)
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        ok = shared >= MIN_SHARED
        ok &= (side[at] == 0) | (side[at] != side[at + d])
        hit = at[ok]
        hit = hit[np.bitwise_count(x[ok]) <= radius]
        if len(hit):
            found_a.append(fp[hit])
            found_b.append(fp[hit + d])
            held += len(hit)
            if held > 2_000_000:
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], len(a)
        d += 1
        at = at[at + d < last[at]]
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """``a, b``: links that connect every pair of distinct ``fp`` within ``radius`` bits (3 at most), directly or through others."""
    if not 0 <= radius <= 3:
        raise ValueError("the byte-position index guarantees radius 0 to 3")
    spark = fps.sparkSession
    parts = []
    for k, triple in enumerate(TRIPLES):
        value = F.lit(k)
        for p in triple:
            value = value * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        parts.append(value.cast("long"))
    posted = fps.select("fp", F.explode(F.array(*parts)).alias("list"))
    hot = posted.groupBy("list").count().where(F.col("count") > tile).select("list", F.ceil(F.col("count") / tile).cast("int").alias("chunks"))
    hot = materialize(hot, "hot")
    cold = posted.join(hot, "list", "left_anti").select("list", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    chunk = F.pmod(F.xxhash64("fp", "list"), F.col("chunks")).cast("int")
    dealt = (
        posted.join(hot, "list")
        .withColumn("own", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "fp",
        )
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = cold.union(dealt).repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]
            cut = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            kept = [c[cut:] for c in cols]
            yield from found(np.cumsum(new[:cut]), cols[3][:cut], cols[4][:cut])
        if kept is not None:
            yield from found(np.zeros(len(kept[0]), np.int64), kept[3], kept[4])

    def found(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fp):
            a, b = links_within(group, side, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

    return tiles.select("list", "i", "j", "side", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``key, fp, component``: the component is the least key that links reach, the row's own included."""
    prints = materialize(fingerprints(docs, key, text, width), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep", F.col("root").isNotNull().alias("moved"))
    linked = roots.select("root").distinct()
    least = (
        named.where("moved").groupBy("root").agg(F.min("rep").alias("rep"))
        .join(classes.select(F.col("fp").alias("root"), F.col("rep").alias("own")), "root")
        .select("root", F.least("rep", "own").alias("component"))
    )
    # only fingerprints that have links need the second name
    members = roots.union(linked.select(F.col("root").alias("node"), "root"))
    renamed = members.join(least, "root").select(F.col("node").alias("fp"), "component")
    table = materialize(classes.join(renamed, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component")), "names")
    return prints.join(table, "fp").select("key", "fp", "component")


def report(docs: DataFrame) -> DataFrame:
    """The result of query op8."""
    d = near_duplicates(docs)
    return d.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the least by key (null last) and then by a hash of the text, so texts that share an id
    are rows of their own. Of rows equal in both one stays."""
    (row,) = fresh(docs, "_row")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.withColumn(row, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.lit(15), t).alias("t1"), F.xxhash64(F.lit(16), t).alias("t2")))
    d = near_duplicates(marked, row, text)
    keep = materialize(d.where(F.col("key") == F.col("component")).groupBy("key").count(), "keep")
    kept = marked.join(keep.select(F.col("key").alias(row)), row, "left_semi")
    if keep.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([row])
    return kept.select(*docs.columns)
