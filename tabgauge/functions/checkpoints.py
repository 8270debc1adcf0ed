"""Where intermediate tables are kept when lineage has to be cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it in spark.checkpoint.dir.

    Only a session on one machine (a local master, as in tests) may go without the
    setting: it gets a folder of its own. On a cluster a missing setting is an error,
    because no folder of the driver's machine reaches the executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        folder = tempfile.mkdtemp(prefix="tabgauge-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{use_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are deleted as soon as it is written."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def settled(table: DataFrame, freed: bool = False) -> DataFrame:
    """The table, computed once, written as Parquet in the shared folder and read from there.

    Later steps read only the columns they need, and a lost executor costs them
    nothing that was computed before. ``freed``: its shuffle files are deleted at once, not
    whenever the driver collects its garbage.
    """
    spark = table.sparkSession
    path = scratch_path(spark)
    with shuffles_freed(spark) if freed else nullcontext():
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
