"""What the corpus operators share: table access, the shared folder, keyed hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a plain local session
    (tests), where the driver is the executor, may go without it and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vialattice-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    It goes with drop_path(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def place(names: Sequence[str], name: str) -> int:
    """Where a column is: the one of exactly this name, else the only one that differs by case."""
    if name in names:
        return list(names).index(name)
    found = [k for k, n in enumerate(names) if n.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"there is no column {name}, or more than one, among {', '.join(names)}")
    return found[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever others there are; names that differ by case don't clash."""
    at = [place(df.columns, n) for n in names]
    if len({n.lower() for n in df.columns}) == len(df.columns):
        return df.select(*(F.col(f"`{df.columns[k]}`").alias(n) for k, n in zip(at, names, strict=True)))
    numbered = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    return numbered.select(*(F.col(f"_{k}").alias(n) for k, n in zip(at, names, strict=True)))


def batches(iterator: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows, which bounds what a step holds at once."""
    for batch in iterator:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its memory back at the end: Python workers live on from stage to stage."""

    def tidy(stream: Iterator) -> Iterator:
        try:
            yield from run(stream)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def grouped(stream: Iterator[pa.RecordBatch], keys: Sequence[int]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal integer keys (columns by position)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in stream:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if last is not None and tuple(values[start]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(values[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(stream: Iterator[pa.RecordBatch], keys: Sequence[int], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that no run of equal integer keys crosses."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        values = np.stack([t.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield t.slice(0, cuts[-1]).combine_chunks()
            t = t.slice(cuts[-1])
        held, n = t.combine_chunks().to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def spread(near: np.ndarray) -> np.ndarray:
    """Least index that each index reaches over a symmetric boolean matrix."""
    out = np.full(len(near), -1)
    for k in range(len(near)):
        if out[k] < 0:
            reach = np.zeros(len(near), bool)
            reach[k], edge = True, np.array([k])
            while len(edge):
                grown = near[edge].any(axis=0) & ~reach
                reach |= grown
                edge = np.flatnonzero(grown)
            out[reach] = k
    return out
