"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir; where it is unset, a local master takes a folder of this machine)."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quartzite-"))
    return (shared or context.getCheckpointDir()).rstrip("/")


def _written(df: DataFrame) -> str:
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table, which computes it once where a checkpoint computes its last stage twice; how large it is, is
    known to the joins after it, and many small parts are read by few tasks."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


stored = cut


class Grown:
    """A table that grows part by part: each part is written once, and all are read as one."""

    FOLDERS = 24  # more folders than that are read and written as one

    def __init__(self, schema: T.StructType, spark: SparkSession) -> None:
        self.schema, self.spark, self.paths = schema, spark, []

    def add(self, part: DataFrame) -> DataFrame:
        """``part``, by names, as written."""
        if len(self.paths) == self.FOLDERS:
            self.paths = [_written(self.all())]
        self.paths.append(_written(part.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))))
        return self._read(self.paths[-1:])

    def take(self, other: Grown) -> None:
        """The last part of another table, where that wrote it."""
        if len(self.paths) == self.FOLDERS:
            self.paths = [_written(self.all())]
        self.paths.append(other.paths[-1])

    def all(self) -> DataFrame:
        return self._read(self.paths)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)


def folded(rows: DataFrame, key: str, order: list[Column], start: tuple, step: Callable[[tuple, tuple], tuple], schema: str) -> DataFrame:
    """The last state of each key: ``step`` takes the state and the other columns of a row, row by row in order. Keys stand one after the other in
    sorted partitions, so a task holds one state and one batch, however many keys there are or rows of one."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[k]) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, start
        for b in batches:
            out = []
            for at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begun and at != now:
                    out.append((now, *state))
                    state = start
                begun, now = True, at
                state = step(state, row)
            yield made(out)
        if begun:
            yield made([(now, *state)])

    others = [c for c in rows.columns if c != key]
    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, *others).mapInArrow(run, schema)
