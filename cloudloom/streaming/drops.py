"""Scans that arrive as files in a drop folder: thinned and compared as they come.

State is one row per occupied cell; nothing is windowed by time, as points carry no
event time that late data could miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloudloom.operators.points import XYZ, radius_pairs

SCHEMA = "pid long, x double, y double, z double"


def arriving(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    """Parquet files of points as a stream, ``files_each`` to a batch at most."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def thinned(points: DataFrame, size: float) -> DataFrame:
    """The first point of every cell over the life of the stream; the state is keyed by cell."""
    cells = {f"c{n}": F.floor(F.col(n) / size) for n in XYZ}
    return points.withColumns(cells).dropDuplicates(["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def compared(points: DataFrame, reference: DataFrame, radius: float, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's distances to the nearest reference point within ``radius``, appended to ``out``.

    Stream and reference meet by grid cell; a point without a neighbour has a null
    distance. A batch that is run again after a failure overwrites its own folder.
    """

    def batch(rows: DataFrame, k: int) -> None:
        near = radius_pairs(rows, reference, radius).groupBy("pid").agg(F.sqrt(F.min("d2")).alias("moved"))
        rows.select("pid").join(near, "pid", "left").write.mode("overwrite").parquet(f"{out}/batch={k}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
