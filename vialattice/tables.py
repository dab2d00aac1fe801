"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a plain local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vialattice-"))
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return given.get().rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's switch that removes a query's shuffle files at its end, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, tidy: bool = False) -> tuple[DataFrame, str]:
    """The table, written and read again, and its path; it goes with drop(), or else when the driver ends.

    ``tidy``: its shuffle files go at once, for steps whose shuffles are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    at, store = _at(spark, path)
    store.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        if path:
            at, store = _at(spark, path)
            store.delete(at, True)
