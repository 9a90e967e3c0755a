"""Embedding near-duplicates by NN-descent over balls.

1. Equal vectors of one label are one point with a weight.
2. Points in dense places are gathered into balls: a ball's points lie within half the link angle of its centre, so by the triangle inequality any
   two of them link and none of those pairs is ever made. Centres are looked for in a bounded random sample first (groups that hold a good part of
   all rows), then within cells of random hyperplanes (``CELL`` points each, larger cells dealt by hash). Points in no ball are balls of one.
3. NN-descent over the balls' centres: a first graph from cells of random hyperplanes, then rounds in which every centre's neighbours, forward and
   reverse, are compared with one another if one of them is new, and each keeps its nearest. A list full of balls that may link is saturated and is
   enlarged, so no partner is cut off. Rounds end when next to no new possible link comes, no list is saturated, and an audit of ``AUDIT`` random
   centres against all others finds at least ``RECALL`` of their possible links; else a fresh set of cells joins the graph.
   Comparisons use vectors of 8-bit steps with a margin for their error.
4. Pairs of balls whose centres are near enough for any link are settled in double precision: a point and a ball link wholly, or not at all, or, where
   neither is certain, point by point against the ball's blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing and are
their own component; vectors of different lengths don't link. Rows with a null id are left out; of rows with one id, the least by label and
vector that can link counts. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.llm.common import materialize
from quartzite.llm.components import components

COSINE = 0.93
NEIGHBOURS = 8
CELL = 512  # points of a cell in which balls are looked for
CHUNK = 48  # centres of a cell that start the graph
TABLES = 3  # sets of cells that start the graph
SAMPLE = 1024  # random points tried as centres over all rows
DENSE = 8  # points that a ball has at least
AUDIT = 256
RECALL = 0.99
ROUNDS = 16
SLACK = 0.04  # angle that steps of 8 bits may cost
EPS = 1e-9
BLOCK = 256


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _codes(x: np.ndarray) -> np.ndarray:
    u = _unit(x)
    return np.rint(u * (127.0 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)


def _near(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _planes(seed: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def _of_code(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.stack([np.frombuffer(x.as_buffer(), np.int8) for x in column])


def vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, g, v``: a row for each id; g, a hash of label and length, and v are null if it can't link."""
    read = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where("id is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    whole = F.when(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)), F.struct("label", "v"))
    return read.groupBy("id").agg(F.min(whole).alias("x")).select("id", F.when(F.col("x").isNotNull(), F.xxhash64("x.label", F.size("x.v"))).alias("g"), "x.v")


def _cells(df: DataFrame, seed: int, width: int) -> DataFrame:
    """``df`` (u, g, n, dim, v or code) with ``cell, part``: cells by signs against as many random hyperplanes as make them ``width`` rows on average,
    and the part within a cell that holds more."""
    name = "v" if "v" in df.columns else "code"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("dim").to_numpy()
            bits = np.clip(np.ceil(np.log2(np.maximum(batch.column("n").to_numpy() / width, 1))), 0, 30).astype(np.int64)
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = batch.take(pa.array(at)).column(name)
                x = _matrix(part) if name == "v" else _of_code(part).astype(np.float64)
                signs = (x @ _planes(seed, 30, int(dim))) > 0
                weights = np.where(np.arange(30)[None, :] < bits[at][:, None], 1 << np.arange(30)[None, :], 0)
                cell[at] = (signs * weights).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    shape = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    marked = df.mapInArrow(sign, f"{shape}, cell long")
    sizes = marked.groupBy("g", "cell").agg(F.ceil(F.count("*") / (2 * width)).cast("int").alias("parts"))
    hot = sizes.where("parts > 1")
    return marked.join(hot, ["g", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("u", F.lit(seed)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def greedy_balls(x: np.ndarray, weight: np.ndarray, reach: float, dense: int) -> np.ndarray:
    """For each row of unit vectors the row of its ball's centre or -1: again and again the row with most free rows within ``reach`` takes them."""
    owner = np.full(len(x), -1)
    close = (x @ x.T) >= math.cos(reach)
    np.fill_diagonal(close, True)
    free = np.ones(len(x), bool)
    while True:
        count = (close[:, free] @ weight[free]) * free
        best = int(np.argmax(count))
        if count[best] < dense:
            return owner
        took = close[best] & free
        owner[took] = best
        free &= ~took


def balls(nodes: DataFrame, cosine: float) -> DataFrame:
    """``u, g, w, v, dim, centre, angle``: each point with the ball it belongs to, named by its centre's id, and its angle to the centre."""
    reach = math.acos(cosine) / 2 - EPS
    # a bounded sample of points in random order, against all points of their group
    sample = nodes.select("u", "g", "v").orderBy(F.xxhash64("u", F.lit(31)), "u").limit(SAMPLE).toArrow()
    ids, groups, rows = sample.column("u").to_numpy(), sample.column("g").to_numpy(), sample.column("v").to_pylist()
    tried = {}
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        tried[int(g)] = (ids[at], _unit(np.array([rows[i] for i in at], np.float64)))
    send = nodes.sparkSession.sparkContext.broadcast(tried)

    def near(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """group, places in the batch, their angles to the group's sampled points"""
        g = batch.column("g").to_numpy()
        for one in map(int, np.unique(g)):
            if one in send.value:
                at = np.flatnonzero(g == one)
                yield one, at, _angles(_unit(_matrix(batch.column("v").take(pa.array(at)))) @ send.value[one][1].T)

    def reach_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, at, angle in near(batch):
                n = ((angle <= reach) * batch.column("w").to_numpy()[at][:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(send.value[one][0]), pa.array(n)], names=["u", "n"])

    reached = {r["u"]: r["n"] for r in nodes.mapInArrow(reach_of, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).collect()}  # SAMPLE rows at most
    order: dict[int, np.ndarray] = {}
    for g, (names, y) in tried.items():
        counts = np.array([reached.get(int(u), 0) for u in names])
        chosen: list[int] = []
        for i in np.lexsort((names, -counts)):  # a centre isn't itself within another's ball
            if counts[i] >= DENSE and all(_angles(y[j] @ y[i]) > reach for j in chosen):
                chosen.append(int(i))
        order[g] = np.array(chosen, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, angle, none = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for one, at, a in near(batch):
                keep = order[one]
                if not len(keep):
                    continue
                ok = a[:, keep] <= reach
                hit = np.flatnonzero(ok.any(axis=1))
                first = keep[ok[hit].argmax(axis=1)]
                centre[at[hit]], angle[at[hit]], none[at[hit]] = send.value[one][0][first], a[hit, first], False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre, mask=none), pa.array(angle, mask=none)], names=[*batch.schema.names, "centre", "angle"])

    shape = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    seen = materialize(nodes.mapInArrow(assign, f"{shape}, centre long, angle double"), "seen")
    rest = seen.where("centre is null").drop("centre", "angle")
    rest = rest.join(rest.groupBy("g").agg(F.count("*").alias("n")), "g")

    def gather(t: pa.Table) -> pa.Table:
        ids = t.column("u").to_numpy()
        order = np.argsort(ids)
        ids, x, weight = ids[order], _unit(_matrix(t.column("v")))[order], t.column("w").to_numpy()[order]
        owner = greedy_balls(x, weight, reach, DENSE)
        hit = np.flatnonzero(owner >= 0)
        return pa.table({"u": ids[hit], "c": ids[owner[hit]], "a": _angles((x[hit] * x[owner[hit]]).sum(axis=1))})

    second = _cells(rest, 1, CELL).groupBy("g", "cell", "part").applyInArrow(gather, "u long, c long, a double")
    named = F.coalesce("centre", "c", "u")
    angle = F.when(named == F.col("u"), 0.0).otherwise(F.coalesce("angle", "a", F.lit(0.0)))
    return seen.join(second, "u", "left").select("u", "g", "w", "v", "dim", named.alias("centre"), angle.alias("angle"))


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of each u's k first pairs by s, pairs counted once. k: by row, one for each u."""
    order = np.lexsort((v, -s, u))
    u2, v2 = u[order], v[order]
    new = np.r_[True, (u2[1:] != u2[:-1]) | (v2[1:] != v2[:-1])] if len(u) else np.zeros(0, bool)
    order, u2 = order[new], u2[new]
    start = np.flatnonzero(np.r_[True, u2[1:] != u2[:-1]]) if len(u2) else np.zeros(0, np.int64)
    rank = np.arange(len(u2)) - np.repeat(start, np.diff(np.r_[start, len(u2)]))
    return order[rank < k[order]]


def started(centres: DataFrame, seed: int) -> DataFrame:
    """``u, v, s``: each centre's nearest within its cell, one set of hyperplanes."""

    def pair(t: pa.Table) -> pa.Table:
        ids, k = t.column("u").to_numpy(), t.column("k").to_numpy()
        near = _near(_of_code(t.column("code")))
        s = near @ near.T
        np.fill_diagonal(s, -2.0)
        i, j = np.nonzero(s > -1.5)
        s = s[i, j].astype(np.float64)
        at = _best(ids[i], ids[j], s, k[i])
        return pa.table({"u": ids[i[at]], "v": ids[j[at]], "s": s[at]})

    return _cells(centres, seed, CHUNK).groupBy("g", "cell", "part").applyInArrow(pair, "u long, v long, s double")


def descend(graph: DataFrame, centres: DataFrame) -> DataFrame:
    """One round of NN-descent on ``graph`` (u, v, s, fresh): ``u, v, s`` found among neighbours of neighbours that would enter u's list."""
    n = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = graph.groupBy("u").agg(F.min("s").alias("least"), F.count("*").alias("has"))
    info = centres.select("u", "code", "k").join(low, "u", "left").select("u", "code", "k", F.when(F.coalesce("has", F.lit(0)) < F.col("k"), -2.0).otherwise(F.col("least")).alias("least"))
    back = graph.join(centres.select(F.col("u").alias("v"), F.col("k").alias("most")), "v")
    back = back.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where("place <= most")
    near = graph.select(F.col("u").alias("c"), F.col("v").alias("x"), "fresh").unionByName(back.select(F.col("v").alias("c"), F.col("u").alias("x"), "fresh"))
    near = near.unionByName(graph.select(F.col("u").alias("c"), F.col("u").alias("x"), F.lit(False).alias("fresh")).distinct())
    met = near.groupBy("c", "x").agg(F.max("fresh").alias("fresh")).join(info.withColumnRenamed("u", "x"), "x").select("c", "x", "fresh", "code", "k", "least")
    met = met.repartition(n, "c").sortWithinPartitions("c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            c = t.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1])) if len(c) else 0  # the last centre may go on in the next batch
            held = t.slice(cut)
            if cut:
                yield compared(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield compared(held)

    def compared(t: pa.Table) -> pa.RecordBatch:
        c, x, fresh, k, least = (t.column(name).to_numpy() for name in ("c", "x", "fresh", "k", "least"))
        codes = t.column("code").to_pylist()
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(starts, np.r_[starts[1:], len(c)], strict=True):
            if not fresh[a:b].any():
                continue
            y = _near(np.stack([np.frombuffer(z, np.int8) for z in codes[a:b]]))
            s = y @ y.T
            ok = (fresh[a:b, None] | fresh[None, a:b]) & (s > least[a:b, None])
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok)
            out.append((x[a + i], x[a + j], s[i, j].astype(np.float64), k[a + i]))
        u, v, s, most = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        at = _best(u, v, s, most)
        return pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at]), pa.array(s[at])], names=["u", "v", "s"])

    return met.mapInArrow(join, "u long, v long, s double")


def merged(graph: DataFrame, found: DataFrame, centres: DataFrame) -> DataFrame:
    """``graph`` with what was found, each list its k nearest; entries that weren't there are fresh."""
    both = graph.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(found.select("u", "v", "s", F.lit(True).alias("fresh")))
    both = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    both = both.join(centres.select("u", "k"), "u").withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    return both.where("place <= k").select("u", "v", "s", "fresh")


def possible(graph: DataFrame, centres: DataFrame, cosine: float) -> DataFrame:
    """``graph`` with ``can``: whether some points of the two balls may link."""
    most = math.acos(cosine) + SLACK
    sides = graph.join(centres.select("u", F.col("radius").alias("ru")), "u").join(centres.select(F.col("u").alias("v"), F.col("radius").alias("rv")), "v")
    return sides.withColumn("can", F.col("s") >= F.cos(F.least(most + F.col("ru") + F.col("rv"), F.lit(math.pi)))).select("u", "v", "s", "fresh", "can")


def audit(graph: DataFrame, centres: DataFrame, cosine: float, size: int = AUDIT) -> float:
    """The share of possible links of ``size`` random centres that ``graph`` (with ``can``) has, against all centres. 1 if there is none."""
    tried = centres.select("u", "g", "code", "radius").orderBy(F.xxhash64("u", F.lit(77)), "u").limit(size).toArrow()
    ids, groups, radius, codes = tried.column("u").to_numpy(), tried.column("g").to_numpy(), tried.column("radius").to_numpy(), tried.column("code").to_pylist()
    held = {int(g): (ids[at], radius[at], _near(np.stack([np.frombuffer(codes[i], np.int8) for i in at]))) for g in np.unique(groups) for at in [np.flatnonzero(groups == g)]}
    most = math.acos(cosine) + SLACK
    send = centres.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("g").to_numpy()
            for one in map(int, np.unique(g)):
                if one in send.value:
                    at = np.flatnonzero(g == one)
                    names, r, y = send.value[one]
                    u = batch.column("u").to_numpy()[at]
                    s = _near(_of_code(batch.column("code").take(pa.array(at)))) @ y.T
                    ok = s >= np.cos(np.minimum(most + batch.column("radius").to_numpy()[at][:, None] + r[None, :], math.pi))
                    i, j = np.nonzero(ok & (u[:, None] != names[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(u[i])], names=["u", "v"])

    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    true = centres.select("u", "g", "code", "radius").mapInArrow(run, "u long, v long").select(*pair).distinct()
    has = graph.where("can").select(*pair, F.lit(1).alias("has")).distinct()
    n, found = true.join(has, ["a", "b"], "left").agg(F.count("*"), F.count("has")).first()
    return found / n if n else 1.0


def candidate_pairs(centres: DataFrame, cosine: float) -> DataFrame:
    """``a, b``: pairs of centres (u, g, code, dim, radius), a < b, some points of whose balls may link; found by NN-descent."""
    n_of = centres.groupBy("g").agg(F.count("*").alias("n"))
    centres = materialize(centres.join(n_of, "g").withColumn("k", F.lit(NEIGHBOURS).cast("long")), "centres")
    seed, none = 100, centres.select("u", F.col("u").alias("v"), F.lit(0.0).alias("s"), F.lit(False).alias("fresh")).limit(0)
    first = started(centres, seed)
    for k in range(1, TABLES):
        first = first.unionByName(started(centres, seed + k))
    graph = materialize(possible(merged(none, first, centres), centres, cosine), "graph")
    seed, before = seed + TABLES, 0
    for _ in range(ROUNDS):
        graph = materialize(possible(merged(graph, descend(graph, centres), centres), centres, cosine), "graph")
        full = graph.groupBy("u").agg(F.count("*").alias("has"), F.count_if("can").alias("can")).join(centres.select("u", "k"), "u").where("has >= k and can >= k").select("u")
        links, saturated = graph.where("can").select(F.least("u", "v"), F.greatest("u", "v")).distinct().count(), full.count()
        grown, before = links - before, links
        if saturated:
            mark = materialize(full.withColumn("more", F.lit(2)), "saturated")
            centres = materialize(centres.join(mark, "u", "left").withColumn("k", F.col("k") * F.coalesce("more", F.lit(1))).drop("more"), "centres")
            graph = graph.join(mark, "u", "left").withColumn("fresh", F.col("fresh") | F.col("more").isNotNull()).drop("more")
            graph = materialize(graph, "graph")
        elif grown <= links * 0.001:
            if audit(graph, centres, cosine) >= RECALL:
                break
            graph = materialize(possible(merged(graph, started(centres, seed), centres), centres, cosine), "graph")
            seed += 1
    return materialize(graph.where("can").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "pairs")


def settled(pairs: DataFrame, placed: DataFrame, cosine: float) -> DataFrame:
    """``u, centre, other, n``: of points of ball ``centre`` the weight of those points of ball ``other`` that they link with, if any.
    pairs: (a, b) of centres; placed: the points with their balls."""
    limit = math.acos(cosine)
    ball = placed.groupBy("centre").agg(F.max("angle").alias("radius"), F.sum("w").alias("all"), F.count("*").alias("points"))
    heart = placed.where("u = centre").select("centre", F.col("v").alias("heart")).join(ball, "centre")
    both = pairs.select(F.col("a").alias("centre"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("centre"), F.col("a").alias("other")))
    met = both.join(heart.withColumnRenamed("centre", "other"), "other").join(placed.select("u", "centre", "v"), "centre")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.array([len(x) for x in batch.column("heart")])
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x, y = _matrix(part.column("v")), _matrix(part.column("heart"))
                c = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                a, r, one = _angles(c), part.column("radius").to_numpy(), part.column("points").to_numpy() == 1
                whole = np.where(one, c >= cosine, a + r <= limit - EPS)
                open_ = ~one & ~whole & (a - r <= limit + EPS)
                keep = pa.array(whole | open_)
                n = np.where(whole, part.column("all").to_numpy(), -1)
                out = [part.column(z) for z in ("u", "centre", "other", "v")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(n)], names=["u", "centre", "other", "v", "n"]).filter(keep)

    kind = dict(placed.dtypes)["v"]
    judged = met.select("u", "centre", "other", "v", "heart", "radius", "all", "points").mapInArrow(judge, f"u long, centre long, other long, v {kind}, n long")
    judged = materialize(judged, "judged")

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"other": t.column("centre").slice(0, 1), "ws": [t.column("w").to_numpy().tobytes()], "rows": [_matrix(t.column("v")).tobytes()]})

    wanted = judged.where("n < 0")
    blocks = placed.join(wanted.select(F.col("other").alias("centre")).distinct(), "centre", "left_semi").join(ball.select("centre", "points"), "centre")
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("points") / BLOCK)).cast("int")).select("centre", "part", "w", "v")
    blocks = blocks.groupBy("centre", "part").applyInArrow(pack, "other long, ws binary, rows binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x = np.array(batch.column("v")[i].as_py(), np.float64)
                w = np.frombuffer(batch.column("ws")[i].as_buffer(), np.int64)
                y = np.frombuffer(batch.column("rows")[i].as_buffer(), np.float64).reshape(len(w), -1)
                n[i] = w[(y @ x) / (np.linalg.norm(y, axis=1) * np.linalg.norm(x)) >= cosine].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "centre", "other")), pa.array(n)], names=["u", "centre", "other", "n"])

    counted = wanted.join(blocks, "other").select("u", "centre", "other", "v", "ws", "rows").mapInArrow(count, "u long, centre long, other long, n long")
    return judged.where("n >= 0").select("u", "centre", "other", "n").unionByName(counted.where("n > 0"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``id, n_links, component``: for each id how many others it links with, and the least id that links reach, its own included."""
    every = materialize(vectors(df, key, vector, label), "vectors")
    nodes = every.where("g is not null").groupBy("g", "v").agg(F.min("id").alias("u"), F.count("*").alias("w")).withColumn("dim", F.size("v"))
    nodes = materialize(nodes.select("u", "g", "w", "v", "dim"), "points")
    placed = materialize(balls(nodes, cosine), "balls")
    ball = materialize(placed.groupBy("centre").agg(F.max("angle").alias("radius"), F.sum("w").alias("all"), F.min("u").alias("least")), "radii")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                codes = pa.array([x.tobytes() for x in _codes(_matrix(part.column("v")))])
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("g"), part.column("dim"), codes], names=["u", "g", "dim", "code"])

    coded = placed.where("u = centre").select("u", "g", "dim", "v").mapInArrow(code, "u long, g long, dim int, code binary")
    centres = coded.join(ball.select(F.col("centre").alias("u"), "radius"), "u")
    found = materialize(settled(candidate_pairs(centres, cosine), placed, cosine), "settled")
    least = ball.select(F.col("centre"), F.col("least").alias("a"))
    edges = found.select("centre", "other").distinct().join(least, "centre").join(least.toDF("other", "b"), "other").select("a", "b")
    roots = components(edges).toDF("least", "root")
    named = ball.join(roots, "least", "left").select("centre", "all", F.coalesce("root", "least").alias("component"))
    per_point = placed.select("u", "centre").join(named, "centre").join(found.groupBy("u").agg(F.sum("n").alias("n")), "u", "left")
    per_point = materialize(per_point.select("u", (F.col("all") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component"), "linked")
    # only copies of a vector have another id than their point
    shared = nodes.where("w > 1").select("g", "v", F.col("u").alias("first"))
    named = every.join(shared, ["g", "v"], "left").select("id", F.coalesce("first", "id").alias("u"))
    return named.join(per_point, "u", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def report(embeddings: DataFrame) -> DataFrame:
    """The result of query op11."""
    d = near_duplicates(embeddings)
    return d.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: All pairs of a label, and what links reach; for ids that occur once.
ORACLE_SQL = f"""
WITH RECURSIVE able AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT r.a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = r.a GROUP BY r.a
"""
