"""Point cloud files as Spark data sources: delimited text, PLY, PCD and LAS.

``register(spark)`` makes the formats ``cloud-ply``, ``cloud-pcd`` and ``cloud-las``
known to ``spark.read``; ``read_text`` uses Spark's own text source. A reader plans
partitions by record ranges from the header alone; each task reads only its range and
gives Arrow batches. Files are opened through ``fsspec``-free plain paths, so they must
be on a file system that every executor mounts.

Columns: pid (record number), x, y, z, then those of r, g, b, nx, ny, nz, intensity, t
that the file has.

Text records take the first words of a line; blank lines are passed over, and a line with too
few words, or with one that is no number, is a record without a point: its pid is left out.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Scalar types of PLY headers, as NumPy codes.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Record layout of LAS point formats 0 to 3 and 6 to 8: where GPS time and RGB start (-1: not there).
LAS_FORMATS = {0: (-1, -1), 1: (20, -1), 2: (-1, 20), 3: (20, 28), 6: (22, -1), 7: (22, 30), 8: (22, 30)}
NAMES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b", "scalar_intensity": "intensity"}
KEPT = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "intensity", "t")


@dataclass(frozen=True)
class Table:
    """A file's records: where they start, their layout, and how many there are."""

    start: int
    dtype: np.dtype | None  # None: text
    names: tuple[str, ...]
    count: int
    scale: tuple[float, ...] = (1, 1, 1)
    offset: tuple[float, ...] = (0, 0, 0)


def ply_header(path: str) -> Table:
    """Where the vertices are; elements before them are passed over, a vertex has no list properties."""
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        order, elements = "", []
        while (line := f.readline()) and line.strip() != b"end_header":
            word = line.decode("ascii", "replace").split()
            if not word:
                continue
            if word[0] == "format":
                order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[word[1]]
            elif word[0] == "element":
                elements.append((word[1], int(word[2]), []))
            elif word[0] == "property":
                elements[-1][2].append(word[1:])
        for name, count, props in elements:
            if name == "vertex":
                break
            _pass_over(f, order, count, props)
        else:
            raise ValueError(f"{path}: no vertices")
        if any(x[0] == "list" for x in props):
            raise ValueError(f"{path}: a vertex has a list property")
        kept = [(NAMES.get(n, n), PLY_TYPES[k]) for k, n in props]
        dtype = np.dtype([(n, order + t) for n, t in kept]) if order else None
        return Table(f.tell(), dtype, tuple(n for n, _ in kept), count)


def _pass_over(f, order: str, count: int, props: list[list[str]]) -> None:
    """Skip an element's records; lists are read for their lengths alone."""
    if not order:
        for _ in range(count):
            f.readline()
        return
    width = lambda k: int(PLY_TYPES[k][1:])
    if all(x[0] != "list" for x in props):
        f.seek(count * sum(width(x[0]) for x in props), 1)
        return
    for _ in range(count):
        for x in props:
            n = int(np.frombuffer(f.read(width(x[1])), order + PLY_TYPES[x[1]])[0]) if x[0] == "list" else 1
            f.seek(n * width(x[2] if x[0] == "list" else x[0]), 1)


def pcd_header(path: str) -> Table:
    with open(path, "rb") as f:
        head: dict[str, list[str]] = {}
        while line := f.readline():
            word = line.decode("ascii", "replace").split()
            if word and word[0][0] != "#":
                head[word[0].upper()] = word[1:]
                if word[0].upper() == "DATA":
                    break
        names = [NAMES.get(n, n) for n in head["FIELDS"]]
        if head["DATA"][0] not in ("ascii", "binary"):
            raise ValueError(f"{path}: {head['DATA'][0]} data is not supported")
        kinds = ["<" + k.lower() + s for k, s in zip(head["TYPE"], head["SIZE"], strict=True)]
        count = int(head.get("POINTS", head.get("WIDTH", ["0"]))[0])
        dtype = np.dtype(list(zip(names, kinds, strict=True))) if head["DATA"][0] == "binary" else None
        return Table(f.tell(), dtype, tuple(names), count)


def las_header(path: str) -> Table:
    with open(path, "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path}: not a LAS file")
    start, kind, size = struct.unpack_from("<I", raw, 96)[0], raw[104] & 0x3F, struct.unpack_from("<H", raw, 105)[0]
    if raw[104] & 0x80:
        raise ValueError(f"{path}: compressed records need a codec that is not here")
    count = struct.unpack_from("<I", raw, 107)[0]
    if not count and raw[25] >= 4:
        count = struct.unpack_from("<Q", raw, 247)[0]
    time, rgb = LAS_FORMATS[kind]
    names, kinds, places = ["x", "y", "z", "intensity"], ["<i4", "<i4", "<i4", "<u2"], [0, 4, 8, 12]
    if time >= 0:
        names, kinds, places = [*names, "t"], [*kinds, "<f8"], [*places, time]
    if rgb >= 0:
        names, kinds, places = [*names, "r", "g", "b"], [*kinds, *["<u2"] * 3], [*places, rgb, rgb + 2, rgb + 4]
    dtype = np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": size})
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    return Table(start, dtype, tuple(names), count, scale, offset)


HEADERS = {"ply": ply_header, "pcd": pcd_header, "las": las_header}


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _columns(records: dict[str, np.ndarray], first: int, names: list[str]) -> pa.RecordBatch:
    n = len(records["x"])
    arrays = [pa.array(np.arange(first, first + n, dtype=np.int64))] + [pa.array(np.asarray(records[c]).astype(np.float64)) for c in names]
    return pa.RecordBatch.from_arrays(arrays, names=["pid", *names])


def _numbers(f: BinaryIO, n: int) -> list[float]:
    """The first ``n`` numbers of the next line that is not blank; a short line, or one with a word that is no number, is a point without a place (NaN)."""
    words: list[bytes] = []
    while not words:
        line = f.readline()
        if not line:
            break
        words = line.split()
    try:
        return [float(x) for x in words[:n]] if len(words) >= n else [math.nan] * n
    except ValueError:
        return [math.nan] * n


class CloudReader(DataSourceReader):
    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows = path, kind, rows

    def partitions(self) -> list[InputPartition]:
        table = HEADERS[self.kind](self.path)
        if table.dtype is None:
            return [Range(0, table.count)]
        return [Range(a, min(a + self.rows, table.count)) for a in range(0, max(1, table.count), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        table = HEADERS[self.kind](self.path)
        names = [c for c in KEPT if c in wanted(table)]
        with open(self.path, "rb") as f:
            f.seek(table.start)
            if table.dtype is None:
                for first in range(0, table.count, 65_536):
                    whole = np.array([_numbers(f, len(table.names)) for _ in range(min(65_536, table.count - first))], dtype=float).reshape(-1, len(table.names))
                    yield self._batch(table, {n: whole[:, i] for i, n in enumerate(table.names)}, first, names)
                return
            size = table.dtype.itemsize
            f.seek(partition.first * size, 1)
            for first in range(partition.first, partition.last, 65_536):
                n = min(65_536, partition.last - first)
                got = np.frombuffer(f.read(n * size), table.dtype)
                yield self._batch(table, {k: got[k] for k in table.names}, first, names)

    def _batch(self, table: Table, got: dict[str, np.ndarray], first: int, names: list[str]) -> pa.RecordBatch:
        for i, n in enumerate("xyz"):
            if table.scale != (1, 1, 1) or table.offset != (0, 0, 0):
                got[n] = got[n] * table.scale[i] + table.offset[i]
        if "rgb" in got:
            packed = got["rgb"].astype(np.float32).view(np.uint32) if got["rgb"].dtype.kind == "f" else got["rgb"].astype(np.uint32)
            got |= {"r": packed >> 16 & 255, "g": packed >> 8 & 255, "b": packed & 255}
        batch = _columns(got, first, names)
        # a scanner marks points without a return by NaN
        whole = np.isfinite(got["x"].astype(float)) & np.isfinite(got["y"].astype(float)) & np.isfinite(got["z"].astype(float))
        return batch if whole.all() else batch.filter(pa.array(whole))


def wanted(table: Table) -> set[str]:
    return set(table.names) | ({"r", "g", "b"} if "rgb" in table.names else set())


class CloudSource(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"cloud-{cls.kind}"

    def schema(self) -> str:
        table = HEADERS[self.kind](self.options["path"])
        return "pid long, " + ", ".join(f"{c} double" for c in KEPT if c in wanted(table))

    def reader(self, schema: StructType) -> DataSourceReader:
        return CloudReader(self.options["path"], self.kind, int(self.options.get("rows", 1_000_000)))


class PlySource(CloudSource):
    kind = "ply"


class PcdSource(CloudSource):
    kind = "pcd"


class LasSource(CloudSource):
    kind = "las"


def register(spark: SparkSession) -> None:
    for source in (PlySource, PcdSource, LasSource):
        spark.dataSource.register(source)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """xyz, pts, csv or asc text: 3 columns, 4 (and intensity), 6 (and colour) or 7 and more (intensity, colour).

    Lines that are no numbers (headers, counts) are left out; numbers are separated by
    white space, commas or semicolons. The commonest width tells the layout; narrower lines
    have nulls, and ``pid`` follows the order of the lines but has gaps.
    """
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,;]+").alias("w"))
    good = lines.where(F.forall("w", lambda x: x.rlike(f"^{number}$")) & (F.size("w") >= 3))
    width = good.agg(F.mode(F.size("w"))).first()[0] or 3
    names = ["x", "y", "z"] + (["intensity", "r", "g", "b"] if width >= 7 else ["r", "g", "b"] if width == 6 else ["intensity"] if width >= 4 else [])
    # a line narrower than most keeps what it has
    numbered = good.select(F.monotonically_increasing_id().alias("pid"), *[F.try_element_at("w", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)])
    return numbered


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """By the file's extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in HEADERS:
        register(spark)
        return spark.read.format(f"cloud-{kind}").load(path)
    if kind in ("xyz", "pts", "txt", "csv", "asc"):
        return read_text(spark, path)
    raise ValueError(f"no reader for .{kind}")


def header_facts(path: str) -> tuple[int | None, bool | None]:
    """(points, whether they have colour) from the header alone; None where a header does not tell."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in HEADERS:
        return None, None
    table = HEADERS[kind](path)
    return table.count, {"r", "g", "b"} <= wanted(table)


def grey_probe(cloud: DataFrame, rows: int = 4_000) -> bool:
    """Whether the first ``rows`` points (a probe, by pid) have no colour of their own: channels within a 100th of the peak."""
    first = cloud.orderBy("pid").limit(rows)
    peak, apart = first.agg(F.max(F.greatest("r", "g", "b")), F.max(F.greatest(F.abs(F.col("r") - F.col("g")), F.abs(F.col("g") - F.col("b"))))).first()
    return peak is None or apart <= max(2.0, peak / 100)
