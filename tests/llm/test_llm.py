"""The training-data operators on small tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quartzite.llm import class_lm, decontaminate, language_id, license_scan, line_dedup, media_ts, packing, quality, simhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _qz_doc string, fp long, key string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 5}"), None, "x", 7, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, clashing column names."""
    rows = [(0, None, None, None, None, None, None, None), (1, "", "en", "a", 0, "", 0, ""), (2, LONG, "en", "b", 1, "", 0, ""), (3, "Ünïcode – ok", "de", None, 2, "", 0, ""),
            (3, "Ünïcode – ok", "de", None, 2, "", 0, ""), (None, "no id here", "fr", "c", 3, "", 0, ""), (5, "!!! 123", "fr", "c", 3, "", 0, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


# 1 --------------------------------------------------------------------------------------------------------------------------


def test_stream_round_trip():
    for n in (0, 1, 575, 576, 577, media_ts.UNIT, media_ts.UNIT + 1, 5 * media_ts.UNIT + 9):
        payload = media_ts.pad(random.Random(n).randbytes(n))
        media = media_ts.build_stream(payload)
        back, info = media_ts.parse_stream(media)
        assert back == payload and len(media) % 188 == 0 and not info["n_cc_errors"] + info["n_sync_errors"] + info["n_table_errors"]
        assert len(info["random_access_units"]) == info["n_units"] == -(-len(payload) // media_ts.UNIT)


def test_stream_damage_is_counted():
    media = media_ts.build_stream(media_ts.pad(b"x" * 9000))
    assert media_ts.parse_stream(media[: 188 * 5] + media[188 * 6 :])[1]["n_cc_errors"] == 1
    assert media_ts.parse_stream(b"\x00" * 188)[1]["n_table_errors"] == 1


def test_streams_of_others():
    payload = media_ts.pad(random.Random(5).randbytes(60_000))
    media = media_ts.build_stream(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    read = lambda ps: media_ts.parse_stream(b"".join(ps))
    back, info = read([*packets[:9], packets[8], *packets[9:]])  # one comes twice
    assert back == payload and (info["n_duplicates"], info["n_cc_errors"]) == (1, 0)
    k = next(i for i in range(9, len(packets)) if packets[i][3] & 0x20 and packets[i][4] > 1)
    jump = lambda p, flag: p[:3] + bytes([p[3] & 0xF0 | p[3] + 5 & 15]) + p[4:5] + bytes([p[5] | flag]) + p[6:] if p[3] & 0x20 else p[:3] + bytes([p[3] & 0xF0 | p[3] + 5 & 15]) + p[4:]
    for flag, errors in ((0x80, 0), (0, 1)):  # a jump of the counter that is signalled, and one that isn't
        back, info = read([*packets[:k], *(jump(p, flag if i == 0 else 0) for i, p in enumerate(packets[k:]))])
        assert back == payload and info["n_cc_errors"] == errors
    back, info = media_ts.parse_stream(b"junk" + b"".join(packets[:20]) + b"\x01\x47noise" + b"".join(packets[20:]) + b"tail")
    assert back == payload and info["n_sync_errors"] == 3 and info["n_packets"] == len(packets)
    lost = [*packets[:12], *packets[13:]]
    back, info = read(lost)
    assert len(back) < len(payload) and info["n_cc_errors"] == 1 and info["n_damaged_units"] == 1
    bad = packets[12][:1] + bytes([packets[12][1] | 0x80]) + packets[12][2:]
    assert read([*packets[:12], bad, *packets[13:]])[1]["n_sync_errors"] == 1
    # a table of many programs goes over several packets, and only the last has streams
    entries = b"".join((n).to_bytes(2, "big") + (0xE000 | 0x500 + n).to_bytes(2, "big") for n in range(1, 61)) + (99).to_bytes(2, "big") + (0xE000 | media_ts.PMT_PID).to_bytes(2, "big")
    section = media_ts._section(0x00, 1, entries)
    chunks = [b"\x00" + section[:183], section[183:]]
    pat = [(bytes([0x47, 0x40 if i == 0 else 0, 0, 0x10 | i]) + c).ljust(188, b"\xff") for i, c in enumerate(chunks)]
    back, info = read([*pat, *packets[1:]])
    assert back == payload and (info["n_programs"], info["program_number"], info["n_table_errors"]) == (61, 99, 0)
    assert read([packets[0][:20] + b"\x00" + packets[0][21:], *packets[1:]])[1]["n_table_errors"] >= 1
    # a new version of the map moves the stream to another PID
    moved = [p[:1] + bytes([p[1] & 0xE0 | 0x02, 0x22]) + p[3:] for p in packets[40:]]
    pmt = media_ts._section(0x02, 1, (0xE222).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE222).to_bytes(2, "big") + b"\xf0\x00")
    back, info = read([*packets[:40], media_ts._table_packet(media_ts.PMT_PID, pmt), *moved])
    assert back == payload and info["n_streams"] == 2
    assert media_ts.parse_stream(b"")[1]["n_packets"] == 0


def test_op1(spark, edge):
    rows = media_ts.digests(edge).collect()
    assert len(rows) == 7
    for r, (_, text, *_) in zip(rows, edge.collect(), strict=True):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert media_ts.digests(edge.limit(0)).count() == 0


# 2 --------------------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, edge):
    boiler, rare = "all of this is shared", "seen on two sites"
    texts = [f"{boiler}\nown line {i} here\n{rare if i < 2 else 'x'}" for i in range(6)]
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, texts)).collect()}
    assert out[0] == texts[0] and all(boiler not in out[i] and f"own line {i} here" in out[i] for i in range(1, 6)) and rare in out[1]
    same_site = docs(spark, [boiler] * 4, dict.fromkeys(range(4), "one"))
    assert all(r.text == boiler for r in line_dedup.dedup(same_site).collect())
    short = docs(spark, ["x\nPrivacy Policy\r\n这是一个在许多网站上重复的长句子"] * 9, {i: f"site{i % 7}" for i in range(9)})
    assert all(r.text == "x" for r in line_dedup.dedup(short).where("doc_id > 0").collect())
    many = docs(spark, ["\n".join([boiler, *(f"line number {k}" for k in range(300))])] * 3)
    assert sorted(len(r.text) for r in line_dedup.dedup(many).collect())[:2] == [0, 0]
    assert line_dedup.dedup(edge).count() == 7 and line_dedup.dedup(edge.limit(0)).count() == 0
    assert line_dedup.dedup(edge).columns == edge.columns


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["doc", "body", "gone", "removed", "lines", "k1", "K2", "pos", "first", "a.b"]
    d = spark.createDataFrame([(i, "one line on many sites", f"s{i}", *(f"{n}{i}" for n in names)) for i in range(5)], ["doc_id", "text", "source", *names])
    out = line_dedup.dedup(d)
    assert out.columns == d.columns
    for r in out.collect():
        assert tuple(r)[3:] == tuple(f"{n}{r.doc_id}" for n in names) and r.text == ("" if r.doc_id else "one line on many sites")


# 3, 4, 6 ---------------------------------------------------------------------------------------------------------------------


def test_classifiers_on_odd_rows(spark, edge, labels):
    for r in language_id.report(edge).collect():
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 5)) and 0 <= r.score <= 1
    assert all(0 <= r.score <= 1 for r in quality.report(edge, labels).collect())
    assert all(0 <= r.score <= 1 for r in toxicity.report(edge, labels).collect())
    for empty in (language_id.report(edge.limit(0)), quality.report(edge.limit(0), labels), toxicity.report(edge.limit(0), labels.limit(0))):
        assert empty.count() == 0
    assert toxicity.keep_clean(edge, labels.limit(0)).count() == 7


SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = language_id.report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in lang)
    assert np.mean([r.lang == r.lang_pred for r in lang]) > 0.95
    good = quality.report(d, l).join(l, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in good]) > 0.93
    tox = toxicity.report(d, l).join(l, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in tox]) > 0.9 and not any(r.predicted and not r.toxic for r in tox)


def test_label_model_separates_classes():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.1
    votes = np.zeros((4000, 12), np.int8)
    for j in range(8):
        votes[:, j] = np.where(rng.random(4000) < np.where(y, 0.5, 0.001), 1, 0)
    votes[:, 8] = votes[:, 0]  # a copy: given the voter it hangs on, its vote says nothing
    votes[:, 9:] = np.where(votes[:, :8].any(1), 0, -1)[:, None]
    posterior, info = toxicity.label_model(votes, 0.1)
    assert ((posterior > 0.5) == y).mean() > 0.98
    child = next(j for j in (0, 8) if info["parent"][j] == 8 - j)
    added = math.log(info["chance"][1, 1, child] / info["chance"][0, 1, child])
    alone = math.log(info["chance"][1, 0, 1] / info["chance"][0, 0, 1])
    assert abs(added) < 0.5 * alone


def test_rare_insults_of_a_small_language_count(spark):
    """An insult in 10 of 3,000 labelled texts becomes a pattern, and its texts are found."""
    rng = random.Random(21)
    words = [f"mot{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(3000)]
    toxic = {i: "zuxor" if i < 40 else "blargon" for i in range(0, 3000, 4)}
    toxic = {i: w for i, w in toxic.items() if i < 200}
    texts = [f"{t} {toxic[i]} {toxic[i]}" if i in toxic else t for i, t in enumerate(texts)]
    lab = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(3000)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.report(docs(spark, texts), lab).collect()}
    assert all(rows[i].predicted == 1 for i in toxic) and sum(r.predicted for r in rows.values()) == len(toxic)


def test_long_tokens_are_read_to_their_end():
    f = quality.Features()
    a, b = f.row(b"aB" * 40 + b"1.,;" * 300), f.row(b"aB" * 40 + b"#?!-" * 300)
    assert not np.array_equal(a[: quality.SHAPES], b[: quality.SHAPES])
    assert np.array_equal(f.row(b"aaaa1111")[: quality.SHAPES], f.row(b"a1")[: quality.SHAPES])


# 5 --------------------------------------------------------------------------------------------------------------------------


def test_decontaminate(spark, edge):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (15, 22, 30, 41, 3)]
    filler = lambda n: " ".join(word() for _ in range(n))
    cut = " ".join(items[3].split()[2:])  # two words less at one end: still similar
    texts = [f"{filler(50)} {items[0]}. {filler(9)}", items[1].upper(), f"{filler(4)}\n{cut} {filler(30)}", filler(80), " ".join(items[2].split()[:12]), items[4], f"{items[0]} {filler(5)} {items[0]} {items[2]}"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.report(docs(spark, texts), bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 3), (5, 4), (6, 0), (6, 2)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()) == [3, 4]
    assert decontaminate.report(edge, bench).count() == 0 and decontaminate.clean(edge, bench.limit(0)).count() == 7
    assert decontaminate.report(edge.limit(0), bench).count() == 0


def test_decontaminate_at_the_threshold(spark):
    """Windows at similarity 0.8 exactly, whose fingerprints differ in up to 20 bits and more, are all found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    items = [[word() for _ in range(49)] for _ in range(400)]  # 45 shingles; another word in the middle leaves 40 of them
    texts = [" ".join([*w[:24], word(), *w[25:]]) for w in items]
    for w, t in zip(items[:20], texts, strict=False):
        p, q = ({tuple(x[i : i + 5]) for i in range(45)} for x in (w, t.split()))
        assert len(p & q) / len(p | q) == 0.8
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")
    rows = decontaminate.report(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(400)}
    assert max(r.distance for r in decontaminate.matches(docs(spark, texts), bench).collect()) > 16


def brute_matches(texts, items):
    """(text, item) with a window of the item's size, at any place, of weighted similarity 0.8."""
    norm = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    own = {k: grams(norm(t)) for k, t in items}
    kinds = {tuple(g) for g in own.values() if g}
    df = Counter(h for g in kinds for h in set(g))
    weight = lambda h: round(1e6 * math.log(1 + len(kinds) / df[h])) if df[h] else round(1e6 * math.log(1 + len(kinds)))
    total = lambda hs: sum(map(weight, hs))
    out = set()
    for d, t in texts:
        g = grams(norm(t))
        for k, item in own.items():
            if item and any(total(set(w) & set(item)) >= 0.8 * total(set(w) | set(item)) for w in (g[i : i + len(item)] for i in range(len(g)))):
                out.add((d, k))
    return out


def test_decontaminate_repeated_null_and_text_items(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    d = spark.createDataFrame([(None, f"so {a} end"), (None, "clean text of its own"), (1, b), (1, b), (2, c), (2, "other text here now ok")], "doc_id long, text string")
    bench = spark.createDataFrame([("q1", a), ("q1", a), (None, b), ("q2", a), ("q3", b.replace("b3", "x3")), ("q3", c)], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(d, bench).collect()}
    assert got == {(None, "q1"), (None, "q2"), (1, None), (2, "q3")}
    assert len(decontaminate.matches(d, bench).where("item = 'q1' and start = 1").collect()) == 1
    assert sorted(r.text for r in decontaminate.clean(d, bench).collect()) == ["clean text of its own", "other text here now ok"]
    named = decontaminate.clean(d.withColumn("T1", F.lit("kept")), bench)
    assert named.columns == ["doc_id", "text", "T1"] and {r.T1 for r in named.collect()} == {"kept"}


def test_decontaminate_against_all_windows(spark):
    """Every window of every document, brute force: cuts, insertions, shared and repeated shingles, other items' shingles."""
    rng = random.Random(17)
    pool = [f"w{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.choice((3, 6, 9, 14, 25)))] for _ in range(25)]
    items[3] = items[2][:8] + items[3]
    items[5] = ["again"] * 12
    texts = [(0, " ".join(["again"] * 40))]
    for d in range(1, 120):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(pool)] * rng.randint(0, 2)
        texts.append((d, " ".join([rng.choice(pool) for _ in range(rng.randint(0, 12))] + w + rng.choice(items)[2:] + [rng.choice(pool) for _ in range(3)])))
    named = [(k, " ".join(w)) for k, w in enumerate(items)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(named, "item_id int, text string")).collect()}
    want = brute_matches(texts, named)
    assert got == want


def test_decontamination_finds_nothing_without_its_index(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    d, bench = docs(spark, [f"so {item} end"]), spark.createDataFrame([(1, item)], "item_id int, text string")
    assert decontaminate.report(d, bench).count() == 1
    monkeypatch.setattr(decontaminate, "item_pairs", lambda printed, radius: printed.select("id", F.col("id").alias("item")).limit(0))
    assert decontaminate.report(d, bench).count() == 0


# 7 --------------------------------------------------------------------------------------------------------------------------


def bigrams(text):
    w = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return set(zip(w, w[1:], strict=False))


def dice(a, b):
    p, q = bigrams(a), bigrams(b)
    return 2 * len(p & q) / max(1, len(p) + len(q))


def test_license_scan(spark, edge):
    mit = license_scan.TEMPLATES["MIT"][2]
    texts = ["some text\nLicensed under the  APACHE license, version 2.0!\nmore", mit.replace(" to deal", "\nto deal"), "all rights are not reserved", mit.replace("copy", "clone", 1), "nothing"]
    texts += ["This package was written by the data team and is Licensed under the Apache License, Version 2.0. Please see the notes.", "one two\nthree Released\nunder the MIT\nLicense. four five\nsix seven"]
    found = {(r.doc_id, r.license) for r in license_scan.report(docs(spark, texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
        for name, own in license_scan.TEMPLATES.items():
            for x in own:
                n = len("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split())
                inside = [" ".join(words[k : k + n]) for k in range(len(words)) if k + 1 < len(words) and (words[k], words[k + 1]) in bigrams(x)]
                want |= {(i, name) for unit in [*t.split("\n"), t, *inside] if dice(unit, x) >= 0.8}
    assert found == want and (0, "Apache-2.0") in found and (1, "MIT") in found and (5, "Apache-2.0") in found and (6, "MIT") in found
    assert license_scan.report(edge).count() == 0 and license_scan.report(edge.limit(0)).count() == 0


# 8 --------------------------------------------------------------------------------------------------------------------------


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(nodes, 2):
        if (a ^ b).bit_count() <= 3:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, edge):
    got = [(r.key, r.fp & (1 << 64) - 1) for r in simhash_dedup.fingerprints(edge).collect()]
    assert got == [(r.doc_id, brute_fp(r.text)) for r in edge.collect()]


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_reach_all_within_radius(spark, tile):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:6]:  # chains and clouds of near fingerprints
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
            base = x if rng.random() < 0.5 else base
    nodes = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    from quartzite.llm.components import components

    got = {r.node: r.root for r in components(simhash_dedup.links(df, 3, tile)).collect()}
    want = brute_components([n & (1 << 64) - 1 for n in nodes])
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    full = {n & (1 << 64) - 1: got.get(n, n) & (1 << 64) - 1 for n in nodes}
    assert groups(full) == groups(want)


def test_op8(spark, edge):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, base, base.replace("w77 ", "other "), " ".join(f"v{i}" for i in range(100)), "", None, "one"]
    rows = {r.doc_id: r for r in simhash_dedup.report(docs(spark, texts)).collect()}
    assert all(int(rows[i].fingerprint, 16) == brute_fp(t) and len(rows[i].fingerprint) == 16 for i, t in enumerate(texts))
    fps = {brute_fp(t) for t in texts}
    comp = brute_components(sorted(fps))
    for i, t in enumerate(texts):
        assert rows[i].component_id == min(j for j, u in enumerate(texts) if comp[brute_fp(u)] == comp[brute_fp(t)])
    kept = simhash_dedup.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows.values()}) and kept.columns == docs(spark, []).columns
    assert simhash_dedup.report(edge).count() == 7 and simhash_dedup.report(edge.limit(0)).count() == 0
    assert [r.doc_id for r in simhash_dedup.keep_one(edge).where("doc_id = 3").collect()] == [3]


def test_texts_that_share_an_id_are_rows_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = spark.createDataFrame([(1, a, 0), (1, b, 1), (2, c, 2), (2, c, 3), (None, a, 4), (None, "x y z", 5), (None, "x y z", 6), (3, b, 7)], "doc_id long, text string, _row int")
    kept = simhash_dedup.keep_one(rows)
    assert kept.columns == rows.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (None, "x y z")], key=str)


# 9 --------------------------------------------------------------------------------------------------------------------------


def test_class_lm(spark, edge):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "a"]) + " " + rng.choice(["cat", "dog", "Bird"]) + " " + rng.choice(["ran", "sat"]) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["zebra zebra", None]
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in class_lm.report(d).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    counts = Counter(w for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(counts[t] > 0 for t in ts), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), abs_tol=1e-9)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert class_lm.report(edge).count() == 7 and class_lm.report(edge.limit(0)).count() == 0


def test_class_lm_splits_frequent_and_rare_alike(spark):
    """The base score doesn't depend on which words are units of their own."""
    d = docs(spark, [f"x{i % 7} y{i % 11} z{i}" for i in range(80)])
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    a = {r.key: r for r in class_lm.score(d, train, frequent=2).collect()}
    b = {r.key: r for r in class_lm.score(d, train, frequent=1000).collect()}
    assert all(math.isclose(a[k].base_score, b[k].base_score, abs_tol=1e-9) and a[k].n_known == b[k].n_known for k in a)


def test_class_lm_frequent_words_are_exact(spark):
    text = " ".join(["a"] * 400 + ["b"] * 30 + [f"x{i}" for i in range(100)])
    assert class_lm.frequent_words(spark.createDataFrame([(text, True)], "text string, train boolean"), 2) == ([b"a", b"b"], 530)


def test_class_lm_rare_words_get_classes_of_their_own(spark):
    """Nouns and verbs of one ending are told apart by their neighbours as if their endings told them apart."""

    def total(noun, verb):
        rng = random.Random(8)
        nouns, verbs = ["cat", "dog"] * 30 + [f"n{i}{noun}" for i in range(60)], ["ran", "sat"] * 30 + [f"v{i}{verb}" for i in range(60)]
        texts = [" ".join(f"the {rng.choice(nouns)} and he {rng.choice(verbs)} ." for _ in range(30)) for _ in range(40)]
        return sum(r.score for r in class_lm.score(docs(spark, texts), F.lit(True), frequent=8, classes=7).collect())

    assert math.isclose(total("zzz", "zzz"), total("aaa", "bbb"), rel_tol=0.005)


def brute_scores(texts, train, frequent, endings, classes, sweeps=6):
    """The scores of the model, by dictionaries and whole sequences."""
    seqs = [(t or "").encode().lower().split() + [b""] for t in texts]
    counts = Counter(w for s, on in zip(seqs, train, strict=True) if on for w in s)
    own = sorted(sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:frequent])
    total = len(own) + endings + 1
    unit = lambda w: total - 1 if not w else own.index(w) if w in own else len(own) + class_lm.ending_unit(w, endings)
    grams = np.zeros((total, total), np.int64)
    for s, on in zip(seqs, train, strict=True):
        for a, b in zip([b"", *s], s, strict=False):
            grams[unit(a), unit(b)] += on
    label = class_lm.exchange(grams, classes, sweeps)
    table = np.zeros((classes, classes))
    for a in range(total):
        for b in range(total):
            table[label[a], label[b]] += grams[a, b]
    near, free = class_lm.affinity(table), classes - 1
    around = {}
    for s, on in zip(seqs, train, strict=True):
        for i, w in enumerate(s):
            if on and w and w not in own:
                l, r = around.setdefault(w, (np.zeros(classes), np.zeros(classes)))
                l[label[unit(s[i - 1] if i else b"")]] += 1
                r[label[unit(s[i + 1])]] += 1
    cls = lambda w: int(np.argmax(around[w][0] @ near[:, :free] + around[w][1] @ near[:free].T)) if w in around else int(label[unit(w)])
    of = {w: cls(w) for s in seqs for w in s}
    final, types = np.zeros((classes, classes)), Counter(of[w] for w in counts)
    for s, on in zip(seqs, train, strict=True):
        for a, b in zip([b"", *s], s, strict=False):
            final[classes - 1 if not a else of[a], of[b]] += on
    n = sum(counts.values())
    share = (final.sum(0) + 0.5) / (n + 0.5 * classes)
    out = []
    for s in seqs:
        score = 0.0
        for a, b in zip([b"", *s], s, strict=False):
            i, j = classes - 1 if not a else of[a], of[b]
            score += math.log10((final[i, j] + 20 * share[j]) / (final[i].sum() + 20)) + math.log10((counts[b] + 0.5) / (final[:, j].sum() + 0.5 * (types[j] + 1)))
        out.append(score)
    return out


def test_class_lm_scores_are_those_of_the_model_in_any_layout(spark):
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefg')}{i}{rng.choice(['ing', 'ed', 'er', 's'])}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice((8, 60))]) for _ in range(rng.randint(0, 30))) for _ in range(70)] + [None, "unseen words", ""]
    d = docs(spark, texts)
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    want = brute_scores(texts, train, 10, 8, 7)
    layouts = []
    for parts, rows in ((1, 10_000), (5, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = class_lm.score(d.repartition(parts), F.crc32(F.col("doc_id").cast("string")) % 5 != 1, frequent=10, endings=8, classes=7)
            layouts.append({r.key: r.score for r in got.collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, w in enumerate(want):
        assert math.isclose(layouts[0][i], w, abs_tol=1e-6) and math.isclose(layouts[1][i], w, abs_tol=1e-6)


def test_exchange_finds_alternating_classes():
    grams = np.zeros((9, 9), np.int64)
    for a in range(4):
        for b in range(4, 8):
            grams[a, b] = grams[b, a] = 50
    label = class_lm.exchange(grams, 3, 10)
    assert len(set(label[:4])) == 1 and len(set(label[4:8])) == 1 and label[0] != label[4]


# 10 -------------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, own, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(4)
    pool = "aZé'sß Ⅷ１½́ÀİΣςǅ<|endoftext|>\x1c\x85 　don't 'LL!?١ĳŉſK\n"
    for text in ["".join(rng.choice(pool) for _ in range(40)) for _ in range(500)] + ["it's <|endoftext|>x I'LL", ""]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(6)

    def optimum(sizes, cap):
        best = len(sizes)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, cap - sizes[i]])

        place(0, [])
        return best

    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        bins, offsets, n = packing.best_fit_decreasing(np.array(sizes), 20)
        assert packing.lower_bound(np.array(sizes), 20) <= optimum(sizes, 20) <= n


def test_packing(spark, edge):
    out = packing.pack_documents(edge).collect()
    assert len({r.doc_id for r in out}) == 6 and sum(r.length for r in out if r.doc_id == 1) == 1
    parts = spark.createDataFrame([(i, 0, 1 + i * 37 % 90) for i in range(500)], "key long, piece int, length long")
    for rows in (out, packing.pack(parts, 100, group_rows=40).collect()):
        cap = 2048 if rows is out else 100
        seqs = {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in seqs.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= cap
    bound = packing.lower_bound(np.array([r.length for r in rows]), 100)
    # partitions of 40 pieces leave rooms too small for any exchange; with one partition the bound itself is met
    assert len(rows) == 500 and len(seqs) <= 1.05 * bound
    assert packing.pack(parts, 100).select("sequence_id").distinct().count() <= bound + 2
    assert packing.pack_documents(edge.limit(0)).count() == 0


def test_packing_merges_partitions(spark):
    """Ten partitions, each nearly at its own bound, end within three bins of the bound of the whole."""
    lengths = np.clip(np.random.default_rng(1).lognormal(5.5, 1.2, 20_000).astype(int), 1, 2048)
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "key long, length long")
    out = packing.pack(parts, group_rows=2000)
    assert out.select("sequence_id").distinct().count() <= packing.lower_bound(lengths, 2048) + 3
    assert out.count() == out.select("key").distinct().count() == 20_000


def test_packing_of_equal_rows(spark):
    """Rows that are equal in all columns are dealt apart, and no sequence is over-full however many bins there are."""
    parts = spark.range(150_000).select(F.lit(None).cast("long").alias("key"), F.lit(0).alias("piece"), F.when(F.col("id") < 100_000, 1500).otherwise(1400).cast("long").alias("length"), F.lit("x").alias("group"))
    out = packing.pack(parts)
    seqs = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    assert out.columns[:4] == ["key", "piece", "length", "group"]
    assert seqs.count() == 150_000 and seqs.where("n > 2048 or k > 1").count() == 0
    half = packing.pack(parts.withColumn("length", F.lit(1024).cast("long")), group_rows=1000)
    seqs = half.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k")).where("n = 2048 and k = 2")
    assert seqs.count() == 75_000


def test_packing_query_keeps_ids(spark, edge):
    """Pieces of the query, against the whole tokenizer: starts, lengths, checksums."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in edge.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(edge).collect()) == want


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and 0 < out.count() <= d.count()
        d = out
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in d.select("doc_id").collect()}
