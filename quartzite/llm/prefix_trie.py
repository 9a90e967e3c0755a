"""Prefix trie of conversations by chained digests.

A conversation's turns are read in order by one task in a stream, each prefix getting the SHA-256 of the digest before it and the turn. Every prefix
is a row; rows grouped by (depth, digest) are the nodes. Sums over subtrees explode each node to all its ancestors, after runs of nodes with the
same members have been folded into one segment: along the path of its smallest member a run is the nodes of one smallest member and one number of
members, so a long tail that nothing shares is a single segment and the rows grow with the branchings of a path, not with the square of its length.
Within a segment a node's sum is the segment's less what stands above.

Conversations that end at a node are hashed in order: ids are dealt by range, joined into pieces of ``PIECE`` and streamed.

Defined results: turns go by (turn, role, text), null turns first, null role and text as empty; repeated rows are turns of their own; rows with a
null conversation id take no part; a conversation without turns ends at the root; an empty table has no node, not even a root. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.llm.common import materialize

ROOT = b"\0" * 32
PIECE = 4096
NO_END = hashlib.sha256(b"").hexdigest()


def ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c, d, role, text``: the turns of each conversation, numbered from 1."""
    read = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    return read.select("c", F.row_number().over(order).cast("long").alias("d"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the first conversation of their hundred, h = crc32(id) % ``heads``.
    A turnless one keeps a row of depth 0."""
    lengths = turns.groupBy("c").agg(F.max("d").alias("n")).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % heads).withColumn("base", F.col("c") - F.col("c") % group)
    lengths = materialize(lengths, "lengths")
    bases = lengths.where("c = base").select("base", F.col("n").alias("has"))
    named = materialize(lengths.join(bases, "base", "left").select("c", "n", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("took")), "named")
    shared = turns.where(F.col("d") < heads).where(F.col("c") % group == 0).withColumnRenamed("c", "base")
    head = named.where("took > 0").join(shared, "base").where("d <= took").select("c", "d", "role", "text")
    own = turns.join(named.select("c", "h", "took"), "c").where("d > h").select("c", (F.col("d") - F.col("h") + F.col("took")).alias("d"), "role", "text")
    none = named.where("took = 0 and n <= h").select("c", F.lit(0).cast("long").alias("d"), F.lit("").alias("role"), F.lit("").alias("text"))
    return head.unionByName(own).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """``c, d, digest, parent, size, last``: every prefix of every conversation of ``turns`` (c, d, role, text), the root's included. size: code points
    of the last text; last: the conversation ends here. Two strings are told apart by their lengths in the digest."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.select("c", "d", "role", "text").repartition(n, "c").sortWithinPartitions("c", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        state: tuple[int, bytes, bytes | None, int] = (0, ROOT, None, 0)  # depth, digest, its parent, size of the last prefix, which awaits its successor
        for batch in batches:
            out: list[tuple] = []
            for c, d, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "d", "role", "text")), strict=True):
                if c != at:
                    if at is not None:
                        out.append((at, *state, True))
                    at, state = c, (0, ROOT, None, 0)
                if d > 0:
                    out.append((at, *state, False))
                    said = role.encode()
                    state = (state[0] + 1, hashlib.sha256(state[1] + len(said).to_bytes(8, "big") + said + text.encode()).digest(), state[1], len(text))
            yield _rows(out)
        if at is not None:
            yield _rows([(at, *state, True)])

    return dealt.mapInArrow(run, "c long, d long, digest binary, parent binary, size long, last boolean")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["c", "d", "digest", "parent", "size", "last"])


def id_hashes(ended: DataFrame) -> DataFrame:
    """``digest, sha``: of rows (digest, c) the SHA-256 of each digest's ids in ascending order, joined by commas. Ids of one digest may be any number:
    they are sorted over the cluster and meet in one stream, piece by piece."""
    n = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        cut = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])
        for batch in batches:
            for digest, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != at or len(ids) == PIECE:
                    if ids:
                        yield cut()
                    at, ids = digest, []
                ids.append(c)
        if ids:
            yield cut()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["digest", "sha"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "sha"])

    pieces = ended.select("digest", "c").repartitionByRange(n, "digest", "c").sortWithinPartitions("digest", "c").mapInArrow(join, "digest binary, first long, ids string")
    return pieces.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(chain, "digest binary, sha string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations ``turns`` (c, d, role, text; d from 1, or one row of depth 0 for a turnless one)."""
    rows = materialize(prefixes(turns), "prefixes")
    nodes = rows.groupBy("d", "digest").agg(F.min("c").alias("rep"), F.count("*").alias("n"), F.any_value("parent").alias("parent"), F.any_value("size").alias("size"))
    nodes = materialize(nodes.withColumn("saved", F.when(F.col("d") > 0, (F.col("n") - 1) * F.col("size")).otherwise(0)), "nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    # the smallest member's prefix one shorter belongs to the parent, so a node finds it by number, and no parent's key gathers all its children
    whose = rows.select("c", "d", F.col("digest").alias("own")).join(nodes.select("d", F.col("digest").alias("own"), "rep", "n"), ["d", "own"])
    chosen = materialize(rows.where("last").groupBy("digest").agg(F.min("c").alias("c")).select("c"), "chosen")  # of equal conversations the first
    # (c, d) with its node's name and members, along each path that some node is named after
    path = materialize(whose.join(chosen, "c", "left_semi").select("c", "d", "rep", "n"), "path")
    full = nodes.join(children, ["d", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = path.select(F.col("c").alias("rep"), (F.col("d") + 1).alias("d"), F.col("rep").alias("parent_conv_id"))
    full = full.join(above, ["rep", "d"], "left").withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    full = materialize(full.select("rep", "d", "digest", "n", "n_children", "leaf", "saved", "parent_conv_id"), "full")

    own = full.groupBy("rep", "n").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    steps = path.select("c", F.col("rep").alias("top"), F.col("n").alias("m")).distinct()
    rolled = own.join(steps, own.rep == steps.c).where("m >= n").groupBy("top", "m").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("whole"))
    before = F.sum("saved").over(Window.partitionBy("rep", "n").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    placed = full.withColumn("before", F.coalesce(before, F.lit(0)))
    summed = placed.join(rolled.select(F.col("top").alias("rep"), F.col("m").alias("n"), "n_leaves", "whole"), ["rep", "n"])
    out = summed.join(id_hashes(rows.where("last")), "digest", "left")
    return out.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("whole") - F.col("before")).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_END)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The result of query op12."""
    return trie(rebuilt(materialize(ordered(conversations), "turns")))


_STEP = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: {_STEP}))"
#: Each prefix by its hash, each node joined to all its ancestors. crc32 bit by bit.
ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
len AS (SELECT c, max(d) AS n, {_CRC} % 6 AS h, c - c % 100 AS base FROM turns GROUP BY c),
named AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS took FROM len a LEFT JOIN len b ON b.c = a.base),
built AS (SELECT named.c, t.d, t.role, t.text FROM named JOIN turns t ON t.c = base AND t.d <= took
  UNION ALL SELECT c, d - h + took, role, text FROM named JOIN turns USING (c) WHERE d > h),
lists AS (SELECT c, list(struct_pack(r := role, t := text) ORDER BY d) AS l FROM built GROUP BY c),
whole AS (SELECT c, coalesce(l, []) AS l FROM named LEFT JOIN lists USING (c)),
pre AS (SELECT c, d, sha256(to_json(l[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS size, d = len(l) AS ends FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM whole)),
node AS (SELECT d, k, min(c) AS rep, count(*) AS n, any_value(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM pre GROUP BY d, k),
up AS (SELECT x.d, x.k, x.rep, x.n, x.size, p.d AS ad, p.k AS ak FROM node x JOIN pre p ON p.c = x.rep AND p.d <= x.d),
kids AS (SELECT ad AS d, ak AS k, count(*) AS n_children FROM up WHERE ad = d - 1 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
rolled AS (SELECT ad AS d, ak AS k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(CASE WHEN up.d = 0 THEN 0 ELSE (up.n - 1) * up.size END) AS saved FROM up JOIN full_node f ON f.d = up.d AND f.k = up.k GROUP BY ALL),
parent AS (SELECT up.d, up.k, q.rep AS parent_conv_id FROM up JOIN node q ON q.d = up.ad AND q.k = up.ak WHERE up.ad = up.d - 1)
SELECT rep AS conv_id, d AS depth, parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM full_node JOIN rolled USING (d, k) LEFT JOIN parent USING (d, k)
"""
