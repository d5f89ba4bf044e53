"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time when its shuffle partition is skewed.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Independent model fits share the cluster.
    "spark.scheduler.mode": "FAIR",
}


def build_session(
    app: str = "lumenbar", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """Session with the settings above; ``master`` is only given in tests and the benchmark."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data, as the session names it.

    It is set here only where the session has none (local tests).
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="lumenbar-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The frame as Parquet in the shared folder, for frames that are read repeatedly.

    Unlike a checkpoint it is compressed and read by column; ordered ``by`` a date, filters
    on that date skip row groups.
    """
    path = new_folder(df.sparkSession)
    rows = df if by is None else df.repartitionByRange(by).sortWithinPartitions(by)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate frames of one operation, as Parquet in a shared folder of its own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, new_folder(spark), 0

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Frames stored in the block are deleted behind it: what leaves it must not read them."""
    held = Scratch(spark)
    try:
        yield held
    finally:
        discard(spark, held.folder)


#: Spark deletes the shuffle files of a query or checkpoint (not of a write, in Spark 4.1) when
#: it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """For jobs of many steps, each of which checkpoints what it found."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
