"""Embedding near-dedup, the conversation trie and hard negatives against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quartzite.llm import embedding_dedup, hard_negatives, prefix_trie

VECTORS = "vec_id long, embedding array<float>, label int, u long, g string, score double"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], label, 0, "x", 0.5) for i, v, label in rows], VECTORS)


ODD = [(None, [1, 0], 1), (900, None, 1), (901, [0, 0], 1), (902, [1, None], 1), (903, [NAN, 1], 1), (904, [INF, 1], 1), (905, [1, 0], None), (906, [], 1)]

# 11 -------------------------------------------------------------------------------------------------------------------------


def linked(rows, cosine=0.93):
    """Links and components of rows (id, vector, label) by comparing all pairs."""
    best = {}
    for i, v, label in rows:
        if i is not None:
            ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
            best.setdefault(i, None)
            if ok:
                best[i] = min(filter(None, [best[i], (label, tuple(np.float32(x).item() for x in v))]))
    root = {i: i for i in best}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = dict.fromkeys(best, 0)
    groups = defaultdict(list)
    for i, x in best.items():
        if x:
            groups[x[0], len(x[1])].append(i)
    for ids in groups.values():
        x = np.array([best[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = x @ x.T >= cosine
        for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
            a, b = ids[a], ids[b]
            n[a] += 1
            n[b] += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (n[i], find(i)) for i in best}


def found(df):
    d = embedding_dedup.near_duplicates(df)
    assert d.columns == ["id", "n_links", "component"]
    return {r[0]: (r[1], r[2]) for r in d.collect()}


def cloud(seed, groups, dim=24):
    """Groups (size, spread) about random centres, two labels, and lone vectors; spreads near the threshold and far within."""
    rng, rows = np.random.default_rng(seed), []
    for g, (size, spread) in enumerate(groups):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((len(rows), list(map(float, centre + rng.standard_normal(dim) * spread / math.sqrt(dim))), g % 2))
    return rows


def test_near_vectors_and_odd_rows(spark):
    rows = cloud(1, [(1, 0.0)] * 150 + [(2, 0.2), (3, 0.25), (12, 0.1), (200, 0.12), (9, 0.3), (30, 0.27), (60, 0.22)])
    rows += [(500 + i, rows[170][1], rows[170][2]) for i in range(40)]  # copies
    rows += [(600, rows[170][1], rows[170][2] + 1), (601, [x * 3 for x in rows[170][1]], rows[170][2]), (602, rows[170][1][:5], rows[170][2])]
    rows += [(3, rows[3][1], rows[3][2]), (4, None, 7), *ODD]
    want, got = linked(rows), found(vectors(spark, rows))
    assert got == want and max(n for n, _ in want.values()) >= 200


def test_balls_don_t_lose_links_at_the_rim(spark):
    """A wide cloud: many pairs stand near the threshold, so whole balls neither link nor stay apart."""
    rows = cloud(5, [(150, 0.3), (150, 0.37), (80, 0.33)], 16)
    want, got = linked(rows), found(vectors(spark, rows))
    pairs, has = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert all(n <= want[i][0] for i, (n, _) in got.items()) and has >= 0.995 * pairs


def test_descent_mends_a_poor_start(spark, monkeypatch):
    """Neighbours of neighbours find what sets of narrow cells leave out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(embedding_dedup, "CHUNK", 12)
    rows = cloud(9, [(4, 0.2)] * 150, 32)
    x = np.array([v for _, v, _ in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True)}
    shape = "u long, g long, dim int, n long, k long, code binary, radius double"
    centres = spark.createDataFrame([(i, 1, 32, len(rows), 8, bytearray(c.tobytes()), 0.0) for (i, _, _), c in zip(rows, embedding_dedup._codes(x), strict=True)], shape)
    has = lambda g: len(true & {(min(r), max(r)) for r in g.select("u", "v").collect()}) / len(true)
    again = lambda g: spark.createDataFrame(g.toPandas(), g.schema)
    none = spark.createDataFrame([], "u long, v long, s double, fresh boolean")
    graph = again(embedding_dedup.merged(none, embedding_dedup.started(centres, 3).unionByName(embedding_dedup.started(centres, 4)), centres))
    before = has(graph)
    for _ in range(4):
        graph = again(embedding_dedup.merged(graph, embedding_dedup.descend(graph, centres), centres))
    assert before < 0.85 and has(graph) > 0.9, (before, has(graph))


def test_no_vectors(spark):
    assert found(vectors(spark, [])) == {}
    assert found(vectors(spark, ODD)) == {i: (0, i) for i in range(900, 907)}


# 12 -------------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, c long, d string, digest string"


def nodes_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    saved, leaves, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        kids[node[:-1]] += bool(node)
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not kids[node]
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows):
    got = prefix_trie.report(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    return set(map(tuple, got))


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bß", "long 🙂 text"])) for c in range(-210, 420, 3) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"turn {t}") for c in (500, 501, 502, 577, 578) for t in range(300)]  # long tails, shared
    rows += [(c, 0, "user", "same") for c in range(1000, 1400)]  # one conversation, many times
    assert trie(spark, rows) == nodes_of(rows)


def test_trie_on_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 0, "user", ""), (8, 3, "us", "er"), (9, 3, "u", "ser"), (10, 1, "user", "x" * 200_000), (200, 1, "a", "b")]
    assert trie(spark, rows) == nodes_of(rows)
    assert trie(spark, []) == set() == trie(spark, [(None, 1, "user", "x")])


def test_pieces_of_ids_meet_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = random.Random(1).sample(range(-5000, 10_000), 500)
    df = spark.createDataFrame([(bytearray(b"a"), i) for i in ids] + [(bytearray(b"b"), 3)], "digest binary, c long").repartition(5)
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert {bytes(r.digest): r.sha for r in prefix_trie.id_hashes(df).collect()} == {b"a": sha(ids), b"b": sha([3])}


# 13 -------------------------------------------------------------------------------------------------------------------------


def mined(rows, relabel=True):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if relabel and i % 7 == 0 else label
            x = (label, tuple(math.floor(256 * np.float32(x).item()) for x in v))
            best[i] = min(best.get(i, x), x)
    out, score = set(), lambda a, b: sum(x * y for x, y in zip(best[a][1], best[b][1], strict=False))
    for a in best:
        if a % 100 == 0:
            ranked = sorted(((-score(a, b), b) for b in best if b != a))
            for p, positive in [x for x in ranked if best[x[1]][0] == best[a][0]][:5]:
                hits = [x for x in ranked if best[x[1]][0] != best[a][0] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
                out |= {(a, positive, k, n, -p, -s) for k, (s, n) in enumerate(hits, 1)}
    return out


def test_hard_negatives(spark, monkeypatch):
    """Small blocks and chunks, so that tiles, partial sums and ranks over tiles all count; ties, repeated ids, vectors of two lengths."""
    for name, n in (("ANCHORS", 2), ("ROWS", 40), ("DIMENSIONS", 3)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 8))
    rows = [(i, [round(float(x), 2) for x in base[i % 6] + rng.standard_normal(8) * 0.6], int(rng.integers(0, 4))) for i in range(0, 700, 2)]
    rows += [(1001 + 2 * i, rows[5][1], 3) for i in range(12)] + [(100, [0.5] * 8, 1), (2000, [1.0, 0.5], 0), (2001, [], 2), *ODD[:-1]]
    got = set(map(tuple, hard_negatives.report(vectors(spark, rows)).collect()))
    assert got == mined(rows) and len(got) > 100
    assert hard_negatives.report(vectors(spark, [])).count() == 0 == hard_negatives.report(vectors(spark, ODD)).count()
    assert hard_negatives.report(vectors(spark, [(100, [1.0], 1), (1, [1.0], 1)])).count() == 0  # no negative


def test_products_beyond_53_bits_stay_whole():
    a = np.array([[2**31 + 1, 3]], np.int64)
    assert hard_negatives.product(a, a)[0, 0] == (2**31 + 1) ** 2 + 9


def test_tiles_travel_in_small_rows(spark):
    """No row of tiles is larger than a strip, and sums beyond 32 bits stay whole."""
    rng = np.random.default_rng(3)
    near, far = rng.integers(-9, 9, (40, 6)), rng.integers(-(2**40), 2**40, (40, 6))
    for x in (near, far):
        assert (hard_negatives.unpacked(pa.py_buffer(hard_negatives.packed(x)), x.size).reshape(x.shape) == x).all()
    rows = spark.createDataFrame([(i, i % 3, True, [int(v) for v in rng.integers(-256, 256, 40)]) for i in range(600)], "id long, label long, anchor boolean, q array<long>")
    tiles = hard_negatives.score_tiles(rows, 600, 600).selectExpr("length(ids) / 8 as n", "length(tile) as bytes", "length(others) / 8 as m").collect()
    assert max(r.n for r in tiles) <= 2 * hard_negatives.ANCHORS / hard_negatives.STRIPS and all(r.bytes == 4 * r.n * r.m for r in tiles)
    assert sum(r.n * r.m for r in tiles) == 600 * 600
