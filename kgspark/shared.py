"""Reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, the folder that was set on the context; if there is none, and executors are threads of this
    process (local mode, as in tests), a new one that goes when the process ends. On a cluster that is an error: machines would not see each
    other's folders."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if not folder and held.isDefined():
        return held.get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kgspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
    if not held.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: later steps do not compute them again, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """Exchanged by keys that the next step needs together anyway, into as many parts as there are cores at least: small rows may be much work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Bytes of files for each part.
PART_BYTES = 2 << 20


def parts_of(df: DataFrame) -> int:
    """So many parts as parted() makes, and more where the files that are read are large: what a task holds does not grow with them."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [leaves.apply(k) for k in range(leaves.size())]
    size = sum(int(x.stats().sizeInBytes()) for x in read if x.getClass().getSimpleName() == "LogicalRelation")
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of few splits (a small file may be one) is spread over all cores by its keys; one of many stays as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 4 * cores else df
