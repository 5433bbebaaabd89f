"""Camera and scanner poses, image indexes and saved projects."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBER = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, w): words of each line in the file's order, without comment signs."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace(F.trim("value"), "^#+", "").alias("value"))
    return text.select("line", F.filter(F.split("value", r"[\s,;]+"), lambda x: x != "").alias("w"))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """line, x, y, z and t (null if the file has no time): lines of numbers, three at least, of the least width.

    The last column is the time if it never falls, rises at all, and is one of five or more or
    larger than 1e5; else the first one if it never falls and rises.
    """
    rows = _lines(spark, path).where((F.size("w") >= 3) & F.forall("w", lambda x: x.rlike(NUMBER)))
    width = rows.agg(F.min(F.size("w"))).first()[0]
    if width is None:
        raise ValueError(f"{path}: no positions")
    rows = rows.select("line", F.transform(F.slice("w", 1, width), lambda x: x.cast("double")).alias("v"))
    ends = rows.select("line", F.col("v")[0].alias("a"), F.col("v")[width - 1].alias("b"))
    # a file of poses, one row a moment of one walk
    after = W.orderBy("line")
    steps = ends.select(*[(F.lead(c).over(after) - F.col(c)).alias(f"d{c}") for c in "ab"], "a", "b")
    facts = steps.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"d{c}").alias(f"low{c}") for c in "ab"], *[F.sum(f"d{c}").alias(f"rise{c}") for c in "ab"], F.max(F.abs("b")).alias("size")).first()
    grows = {c: facts["n"] > 2 and facts[f"low{c}"] >= 0 and facts[f"rise{c}"] > 0 for c in "ab"}
    first, t = 0, F.lit(None).cast("double")
    if width >= 4 and grows["b"] and (width >= 5 or facts["size"] > 1e5):
        t = F.col("v")[width - 1]
    elif width >= 4 and grows["a"]:
        first, t = 1, F.col("v")[0]
    return rows.select("line", *[F.col("v")[first + i].alias(c) for i, c in enumerate("xyz")], t.alias("t"))


def read_angles(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y, z, omega, phi, kappa in degrees: the first word that is no number, and the first six numbers of each line.

    Angles of which none exceeds a full turn of radians are radians.
    """
    rows = _lines(spark, path).where(F.size("w") >= 7)
    rows = rows.select("line", F.get(F.filter("w", lambda x: ~x.rlike(NUMBER)), F.lit(0)).alias("name"), F.transform(F.filter("w", lambda x: x.rlike(NUMBER)), lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("name").isNotNull() & (F.size("v") >= 6))
    turn = rows.agg(F.max(F.greatest(*[F.abs(F.col("v")[i]) for i in (3, 4, 5)])).alias("most"))
    both = rows.crossJoin(F.broadcast(turn))  # one row
    scale = F.when(F.col("most") <= 2 * math.pi + 0.01, 180 / math.pi).otherwise(1.0)
    return both.select("name", *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")], *[(F.col("v")[3 + i] * scale).alias(c) for i, c in enumerate(("omega", "phi", "kappa"))])


def image_keys(paths: DataFrame) -> DataFrame:
    """(key, path): the keys a path (with its folder) may be asked by: the relative path, folder and path, base name; lower case."""
    folder = F.regexp_extract("folder", r"([^/]+)/*$", 1)
    keys = F.array(F.lower("path"), F.lower(F.concat_ws("/", folder, "path")), F.lower(F.regexp_extract("path", r"([^/]+)$", 1)))
    return paths.select(F.explode(F.array_distinct(keys)).alias("key"), "folder", "path").distinct()


def image_index(paths: DataFrame) -> DataFrame:
    """(key, folder, path): the first file of every key, in order of folder and path."""
    return image_keys(paths).groupBy("key").agg(F.min(F.struct("folder", "path")).alias("m")).select("key", "m.folder", "m.path")


def image_candidates(paths: DataFrame) -> DataFrame:
    """(key, files): every file of every key."""
    return image_keys(paths).groupBy("key").agg(F.sort_array(F.collect_set(F.concat_ws("/", "folder", "path"))).alias("files"))


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a project (surfaces, storeys, faces, vertices ...) as Parquet below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
