"""Helpers shared by the training-data operators: shared scratch tables, names, guarded broadcasts, Arrow batch access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BROADCAST_ROWS = 100_000  # of a few longs each: under 10 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where it is unset, a local master takes a folder of this machine;
    a cluster has none that all can reach, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quartzite-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def guarded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if a count proves it small; beyond that, to be shuffled. ``df`` is best a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quartzite/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield view[ends[i] : ends[i + 1]].tobytes() if valid[i] else b""


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
