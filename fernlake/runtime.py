"""Session helpers: where shared files go and how a plan's lineage is cut.

Everything an executor may need again is written through Spark's own writers to
the folder named by ``spark.checkpoint.dir``, which every executor can read, so a
lost executor costs only the tasks that were running on it.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package wherever the driver was started.

    Clusters get it by ``--py-files``; there the path does no harm.
    """
    environment = spark.sparkContext.environment
    given = environment.get("PYTHONPATH", "")
    if ROOT not in given.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, given]))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where all tasks run on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fernlake-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Names this process's tables; what is left of them goes when it ends.
RUN = uuid.uuid4().hex
_roots: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    root = f"{shared_dir(spark)}/fernlake/{RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_leave, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _leave(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may be gone before
        drop_path(spark, root)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return the table read back and its path.

    Columnar and compressed, with exact sizes for the planner, and computed once
    (a checkpoint of an uncached frame stores uncompressed rows instead).
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: a table that grows with the input may be small as a
    compressed file and still be a hash table of a gigabyte in the driver. Skewed keys are still split."""
    return df.hint("merge")


class Scratch:
    """Tables that only live while a larger one is made from them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        made, path = materialize(df, label)
        self.paths.append(path)
        return made

    def drop(self) -> None:
        """Delete them all; what was made from them must be written by now.

        Executors keep the shuffle files of finished plans until the driver's collector has found the plans
        unused, which on a quiet driver may be long after; it is asked to look now.
        """
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
