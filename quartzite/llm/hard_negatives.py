"""Hard-negative mining by block matrix multiplication over two dimensions.

Anchors and rows are dealt into blocks by the hash of their id, and each block into chunks of dimensions. Anchor chunk (i, k) meets row chunk
(j, k) and makes a partial tile of 64-bit scores; the partial tiles of (i, j) are shuffled together and added into the score tile, which is
written. A tile travels in strips of a few anchors, as 32-bit numbers where they fit: writers and readers of Parquet hold a hundred rows or more at once,
which would be a GB of whole tiles. From the tiles each anchor's positives are reduced, then, for the window that every (anchor, positive) sets, its negatives: a tile keeps
the first few of each, ranking over the tiles decides. Memory is two tiles and some hundred strips a task, whatever the dimensions, rows or labels.

Defined results: rows with a null id, null label, null vector or a null or non-finite component take no part; components become
floor(256 * x), held within 64 bits, and scores are 64-bit sums, which wrap beyond that. Vectors of several lengths are padded with zeros. Of
rows with one id the least by label and components counts, so repeated rows count once. Ties go to the smaller id. An anchor without positives,
or a window without rows, gives no rows; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.llm.common import BROADCAST_ROWS, materialize

ANCHORS = 256  # of a tile
ROWS = 4096
DIMENSIONS = 32  # of a chunk
STRIPS = 16  # of a tile: what is shuffled, written and read as one row, a quarter of a MB
ROW_GROUP = {"parquet.block.size": str(1 << 24)}  # a writer holds a hundred rows at least, a reader a whole group
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
EXACT = 2.0**53


def quantised(df: DataFrame, key: Column, vector: Column, label: Column, anchor: Column) -> DataFrame:
    """``id, label, anchor, q``: one row for each id that takes part, its components as whole numbers."""
    read = df.select(key.cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("v"))
    read = read.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    read = read.where(F.coalesce(sound, F.lit(False))).select("id", "label", "anchor", whole.alias("q"))
    one = read.groupBy("id").agg(F.min(F.struct("label", "q")).alias("x"), F.max("anchor").alias("anchor"))
    return one.select("id", "x.label", "anchor", "x.q")


def chunks(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """``block, k, ids, labels, part``: blocks of rows dealt by the hash of the id, in chunks of dimensions; ``part`` holds the rows' components."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(blocks)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        ids, labels = (t.column(c).to_numpy() for c in ("id", "label"))
        q = pa.concat_arrays(t.column("q").chunks)
        sizes = q.value_lengths().to_numpy()
        wide = np.zeros((len(ids), max(1, int(sizes.max()))), np.int64)
        at = np.repeat(np.arange(len(ids)), sizes)
        wide[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = q.flatten().to_numpy()
        order = np.argsort(ids)
        ids, labels, wide = ids[order], labels[order], wide[order]
        n = -(-wide.shape[1] // width)
        names = [ids.tobytes(), labels.tobytes()]
        parts = [np.ascontiguousarray(wide[:, k * width : (k + 1) * width]).tobytes() for k in range(n)]
        block = t.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * n, pa.int32()), "k": pa.array(range(n), pa.int32()), "ids": [names[0]] * n, "labels": [names[1]] * n, "part": parts})

    return dealt.groupBy("block").applyInArrow(pack, "block int, k int, ids binary, labels binary, part binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in 64-bit whole numbers; by floating point where no sum can exceed 53 bits."""
    top = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0)
    if a.shape[1] * top < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def packed(tile: np.ndarray) -> bytes:
    """The bytes of whole numbers, 32 bits each where all fit."""
    near = tile.size and -(2**31) <= tile.min() and tile.max() < 2**31
    return (tile.astype(np.int32) if near else tile).tobytes()


def unpacked(data: pa.Buffer, count: int) -> np.ndarray:
    """``count`` numbers of 64 bits from ``packed`` ones."""
    return np.frombuffer(data, np.int32 if data.size == 4 * count else np.int64).astype(np.int64)


def score_tiles(rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """``i, j, ids, labels, others, kinds, tile``: the scores of anchor strip i (ids, labels), of STRIPS a block, against row block j (others, kinds)."""
    spark = rows.sparkSession
    n_i, n_j = -(-n_anchors // ANCHORS), -(-n_rows // ROWS)
    left = chunks(rows.where("anchor"), n_i, DIMENSIONS).select(F.col("block").alias("i"), "k", "ids", "labels", F.col("part").alias("a"))
    right = chunks(rows, n_j, DIMENSIONS).select(F.col("block").alias("j"), "k", F.col("ids").alias("others"), F.col("labels").alias("kinds"), F.col("part").alias("b"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(n, "i", "j", "k").join(right.repartition(n, "i", "j", "k"), ["i", "j", "k"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids, others = (np.frombuffer(one.column(c)[0].as_buffer(), np.int64) for c in (2, 4))
                a, b = (np.frombuffer(one.column(c)[0].as_buffer(), np.int64).reshape(len(x), -1) for c, x in ((6, ids), (7, others)))
                w = min(a.shape[1], b.shape[1])
                tile, labels, block = product(a[:, :w], b[:, :w]), np.frombuffer(one.column(3)[0].as_buffer(), np.int64), one.column(0)[0].as_py()
                for strip, at in enumerate(np.array_split(np.arange(len(ids)), STRIPS)):
                    if len(at):
                        own = [pa.array([block * STRIPS + strip], pa.int32()), one.column(1), pa.array([ids[at].tobytes()]), pa.array([labels[at].tobytes()]), one.column(4), one.column(5)]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([packed(tile[at])])], names=["i", "j", "ids", "labels", "others", "kinds", "tile"])

    shape = "i int, j int, ids binary, labels binary, others binary, kinds binary, tile binary"
    partial = met.select("i", "j", "ids", "labels", "others", "kinds", "a", "b").mapInArrow(multiply, shape)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                key = (one.column(0)[0].as_py(), one.column(1)[0].as_py())
                tile = unpacked(one.column(6)[0].as_buffer(), one.column(2)[0].as_buffer().size // 8 * (one.column(4)[0].as_buffer().size // 8))
                if key == at:
                    total += tile
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([*held, pa.array([packed(total)])], names=batch.schema.names)
                at, held, total = key, [pa.array(c.to_pylist(), c.type) for c in one.columns[:6]], tile
        if at is not None:
            yield pa.RecordBatch.from_arrays([*held, pa.array([packed(total)])], names=shape.replace(",", "").split()[::2])

    return partial.repartition(n, "i", "j").sortWithinPartitions("i", "j").mapInArrow(add, shape)


def _opened(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids, labels, others, kinds and scores of one tile."""
    ids, labels, others, kinds = (np.frombuffer(row.column(c)[0].as_buffer(), np.int64) for c in ("ids", "labels", "others", "kinds"))
    return ids, labels, others, kinds, unpacked(row.column("tile")[0].as_buffer(), len(ids) * len(others)).reshape(len(ids), len(others))


def positives_of(tiles: DataFrame, count: int) -> DataFrame:
    """``anchor, positive, score, i``: each anchor's first ``count`` other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, others, kinds, tile = _opened(batch.slice(row, 1))
                out: list[tuple[np.ndarray, ...]] = []
                for r in range(len(ids)):
                    at = np.flatnonzero((kinds == labels[r]) & (others != ids[r]))
                    at = at[np.lexsort((others[at], -tile[r, at]))[:count]]
                    out.append((np.full(len(at), ids[r]), others[at], tile[r, at]))
                a, p, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(p), pa.array(s), pa.array(np.full(len(a), batch.column("i")[row].as_py(), np.int32))], names=["anchor", "positive", "score", "i"])

    found = tiles.mapInArrow(run, "anchor long, positive long, score long, i int")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def windowed(ids: np.ndarray, labels: np.ndarray, others: np.ndarray, kinds: np.ndarray, tile: np.ndarray, want: np.ndarray, count: int, low: int, high: int) -> list[np.ndarray]:
    """anchor, positive, positive's score, negative, its score: of one tile the first ``count`` rows in each window. want: rows (anchor, positive, score)."""
    out, place = [], {int(x): r for r, x in enumerate(ids)}
    want = want[np.argsort(want[:, 0], kind="stable")]
    for group in np.split(want, np.flatnonzero(np.diff(want[:, 0])) + 1) if len(want) else []:
        r = place[int(group[0, 0])]
        # whole-number bounds of low * p <= 100 * s <= high * p
        least, most = [-((-low * int(p)) // 100) for p in group[:, 2]], [(high * int(p)) // 100 for p in group[:, 2]]
        s = tile[r]
        at = np.flatnonzero((kinds != labels[r]) & (s >= min(least)) & (s <= max(most)))
        at = at[np.lexsort((others[at], -s[at]))]
        down = -s[at]
        for (a, p, score), lo, hi in zip(group, least, most, strict=True):
            first, last = np.searchsorted(down, -hi, "left"), np.searchsorted(down, -lo, "right")
            took = at[first : min(last, first + count)]
            if len(took):
                out.append(np.stack([np.full(len(took), a), np.full(len(took), p), np.full(len(took), score), others[took], s[took]]))
    return list(np.concatenate(out, axis=1)) if out else []


def mine(df: DataFrame, anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for the rows where ``anchor`` holds."""
    rows = materialize(quantised(df, F.col(key), F.col(vector), label if label is not None else F.col("label"), anchor), "quantised")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    shape = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in names])
    if not n_anchors:
        return df.sparkSession.createDataFrame([], shape)
    tiles = materialize(score_tiles(rows, n_anchors, n_rows), "tiles", **ROW_GROUP)
    wanted = materialize(positives_of(tiles, positives), "positives")

    def pack(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(c).to_numpy() for c in ("anchor", "positive", "score")], axis=1)
        return pa.table({"i": t.column("i").slice(0, 1), "want": [np.ascontiguousarray(x, np.int64).tobytes()]})

    windows = wanted.groupBy("i").applyInArrow(pack, "i int, want binary")  # a strip of anchors has ANCHORS / STRIPS * positives at most, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                want = np.frombuffer(one.column("want")[0].as_buffer(), np.int64).reshape(-1, 3)
                found = windowed(*_opened(one), want, negatives, low, high)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    found = tiles.join(windows, "i").mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(*names)


def report(embeddings: DataFrame) -> DataFrame:
    """The result of query op13."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 100 == 0, moved)


ORACLE_SQL = f"""
WITH part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
neg AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT * FROM neg WHERE rank <= {NEGATIVES}
"""
