"""What the operators of this subpackage share: reading tables, Arrow helpers, checkpoints, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import settled, shared_folder as shared_dir, table  # noqa: F401  for the operators

Batches = Iterator[pa.RecordBatch]

#: Rows of a side that may be broadcast (keys of 8 to 24 bytes); above, a shuffle join is used.
BROADCAST_ROWS = 2_000_000
#: Bytes of an Arrow batch where small_batches() is called; one row may be larger.
BATCH_BYTES = 2 << 20


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI with its scheme, as Spark's default file system has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there; survives the loss of executors."""
    return settled(df)


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """With the broadcast hint if it has few enough rows, else left to a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session from here on; a smaller limit of its own stays. Spark reads it when a plan runs, so it isn't put back.
    Of a batch there are several copies at once, in the executor and in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def over(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that the operators read; other columns cannot clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with some of its columns exchanged, in place."""
    names = batch.schema.names
    arrays = [columns[n].cast(batch.schema.field(i).type) if n in columns else batch.column(i) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
