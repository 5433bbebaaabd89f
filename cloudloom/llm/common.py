"""Shared plumbing of the text operators: tables, shared scratch, Arrow streams.

Every operator of the subpackage reads its inputs through Spark only, keeps
driver state bounded by a documented size, and writes intermediate tables below
``spark.checkpoint.dir`` so that lost executors never lose finished work.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where it names none and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="cloudloom-")
    return _OWN_DIR[app]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch and read it back: cuts lineage, survives executors.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def encoded(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``text`` (one row at least)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def grouped_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a gapless 0-based rank in each group, no task holding more than one bucket of a group.

    Rows are ordered by (bucket, order); ``bucket`` must be a function of the row.
    Groups are compared null-safe. The bucket counts are one row per group and bucket.
    """
    rows = df.withColumn("__b", bucket)
    sums = rows.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__gb"),
        F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"),
    )
    local = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)) - 1
    on = F.col("__b").eqNullSafe(F.col("__gb"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    both = rows.withColumn("__r", local).join(sums, on)
    return both.select(*df.columns, (F.col("__before") + F.col("__r")).cast("long").alias(name))


def _give_back() -> None:
    """Hand freed memory back to the system: workers live on idle, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers free what they no longer need at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)
