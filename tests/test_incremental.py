"""The analysis store and baselines: what is analysed again, what a broken or half-written store costs, and older forms."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.operators import incremental

KIND = T.ArrayType(T.StructType([T.StructField("word", T.StringType())]))


@pytest.fixture
def store(spark, tmp_path):
    return incremental.Store(spark, f"file://{tmp_path}/store", KIND)


def run(store, files, config="a"):
    """Results by path, hits, and how many contents were analysed."""
    asked = []

    def analysis(lacking):
        asked.append(lacking.count())
        return lacking.where("content <> ''").select("content_key", F.transform(F.split("content", " "), lambda w: F.struct(w.alias("word"))).alias("results"))

    df = store.spark.createDataFrame(list(files.items()), "path string, content string")
    rows = incremental.analyse(df, store, config, analysis).collect()
    return {r.path: [x.word for x in r.results] for r in rows}, {r.path for r in rows if r.hit}, asked[0]


def test_only_what_changed_is_analysed(store):
    files = {"a": "one two", "b": "three", "c": "three", "d": None, "e": ""}
    want = {"a": ["one", "two"], "b": ["three"], "c": ["three"], "d": [], "e": []}
    assert run(store, files) == (want, set(), 3)
    assert run(store, files) == (want, set(files), 0)
    assert run(store, files, "another") == (want, set(), 3)
    files["a"] = "four"
    assert run(store, files) == ({**want, "a": ["four"]}, {"b", "c", "d", "e"}, 1)
    files["a"] = "one two"
    assert run(store, files) == (want, set(files), 0)
    keys = store.spark.createDataFrame([("three",)], "c string").select(incremental.content_key(F.col("c")).alias("content_key"), F.lit("a").alias("config_key"))
    store.compact(keys)
    assert len(store.generations()) == 1 and store.read().count() == 1
    assert run(store, files) == (want, {"b", "c"}, 2)


def test_a_broken_or_half_written_store_costs_only_time(store, tmp_path):
    files = {"a": "one two", "b": "three"}
    want = {"a": ["one", "two"], "b": ["three"]}
    run(store, files)
    folder = next((tmp_path / "store").iterdir())
    half = tmp_path / "store" / folder.name.replace("000000001", "000000002")
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")  # no marker: not there
    assert run(store, files) == (want, {"a", "b"}, 0)
    for part in folder.glob("*.parquet"):
        part.write_bytes(b"PAR1 broken")
        (folder / f".{part.name}.crc").unlink(missing_ok=True)
    got, hits, n = run(store, files)
    assert got == want and not hits and n == 2


def test_baselines_of_all_forms(spark, tmp_path):
    rows = [(1, 2**64 - 1, 7, ("r:x", "Major", "f.py", 3, "m")), (2, 5, None, ("r:y", "Dire", "g.py", 4, "n")), (3, 6, None, None)]
    folder = f"file://{tmp_path}/base"
    assert incremental.load_baseline(spark, folder) is None
    df = spark.createDataFrame([(a, str(b), c, s) for a, b, c, s in rows], "rule_file long, fingerprint string, line_hash long, summary struct<rule:string,severity:string,file:string,line:int,message:string>")
    incremental.save_baseline(df.limit(1), folder)
    incremental.save_baseline(df, folder)
    got = {(int(r.rule_file), int(r.fingerprint)): r for r in incremental.load_baseline(spark, folder).collect()}
    assert set(got) == {(1, 2**64 - 1), (2, 5), (3, 6)} and got[1, 2**64 - 1].summary.rule == "r:x" and got[2, 5].summary is None and got[3, 6].line_hash is None
    write = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    entry = {"rule_file": 1, "fingerprint": 2**64 - 1, "line_hash": None, "summary": {"rule": "r", "severity": "Minor", "file": "f", "line": 1, "message": "m"}}
    one = incremental.load_baseline(spark, write("new.json", json.dumps([entry]))).collect()
    assert int(one[0].fingerprint) == 2**64 - 1 and one[0].summary.severity == "Minor"
    assert incremental.load_baseline(spark, write("mid.json", json.dumps([{k: v for k, v in entry.items() if k != "summary"}]))).collect()[0].summary is None
    assert {int(r.fingerprint) for r in incremental.load_baseline(spark, write("old.json", "[1, 2, 18446744073709551615]")).collect()} == {1, 2, 2**64 - 1}
    for bad in ("{nothing", '[{"other": 1}]', '["x"]'):
        assert incremental.load_baseline(spark, write("bad.json", bad)) is None
    assert incremental.load_baseline(spark, f"file://{tmp_path}/none.json") is None
