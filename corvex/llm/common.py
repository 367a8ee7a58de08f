"""Shared helpers: reading tables, sizing, checkpoints, Arrow maps by rows and by columns."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 256  # rows held as Python objects at a time
LIBC = ctypes.CDLL(None)
MOST_TASKS = 50_000
MAX_ID = (1 << 63) - 1  # stands for a null id where ids are ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Size of the data behind `df`, from its leaves' statistics; measured when they have none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total < 1 << 58:
        return total
    return int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir. Only a session within one machine gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvex-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def deal(df: DataFrame, chunks: int, key: str = "_cx_chunk") -> DataFrame:
    """`df` by chunk, a few chunks to a task, so that tasks do not grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(chunks // 2, MOST_TASKS)), key)


def release() -> None:
    """Hand freed memory back to the system: workers are kept from stage to stage, and what one stage left
    to its allocator would be missing in the next."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_column(
    df: DataFrame,
    inputs: list[str],
    carry: Iterable[str],
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[..., list[tuple]]],
    rows_at_once: int = SLICE,
) -> DataFrame:
    """Arrow map that leaves `carry` as it is and adds `fields` (name, DDL type).

    `make()` is called once per task and returns a function of the input columns, given as lists of at
    most SLICE values, to a list of tuples. A field that has the name of a carried column replaces it.
    """
    names = {n for n, _ in fields}
    kept = [c for c in carry if c not in names]
    src = df.select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"_cx_in{i}") for i, c in enumerate(inputs)]
    )
    out = T.StructType([*src.schema.fields[: len(kept)], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields]])
    k = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, types = make(), [f.type for f in arrow_schema(out)]
        target = pa.schema([pa.field(f.name, t) for f, t in zip(out.fields, types)])
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                found = fn(*[b.column(k + i).to_pylist() for i in range(len(inputs))])
                cols = list(zip(*found))
                new = [pa.array(c, type=t) for c, t in zip(cols, types[k:])]
                old = [b.column(i).cast(types[i]) for i in range(k)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=target)

    return src.mapInArrow(run, out)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those of start[1], and so on."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes in the column, one row at least."""
    x = batch.column(column)
    size = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)
    part = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(at, at[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def map_arrow(
    df: DataFrame, source: Column, carry: Iterable[str], fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], most: int
) -> DataFrame:
    """Arrow map over the column `source` in parts of about `most` bytes (elements, of an array) that leaves `carry` as
    it is and adds `fields` (name, DDL type); those that have the name of a carried column replace it."""
    names = {n for n, _ in fields}
    kept = [c for c in carry if c not in names]
    src = df.select(*[F.col(f"`{c}`") for c in kept], source.alias("_cx_in"))
    out = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, target = make(), arrow_schema(out)
        for whole in batches:
            for b in by_bytes(whole, len(kept), most):
                new = fn(b.column(len(kept)))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*b.columns[:-1], *new], target)], schema=target)
                new = None
                release()

    return src.mapInArrow(run, out)
